"""Key stores, fingerprints, epochs with contents, decoding, bans, rates, running chats, and preparing a corpus."""

from __future__ import annotations

import json
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import bytepair as B
from corpusloom.functions import report
from corpusloom.functions import schedule as S
from corpusloom.operators import bpe_encode, bpe_train, corpus, epochs, evaluate, fingerprint, history, prepare, rates, windows
from corpusloom.sources import files, keystore, positional
from corpusloom.streaming import chat


def test_key_store(spark, tmp_path):
    path = str(tmp_path / "store")
    index = lambda texts: corpus.indexed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for batch, texts in enumerate((["a", "b", "b"], ["c"], [f"t{i}" for i in range(500)])):
        keystore.append(index(texts), path, batch, 16)
    new = ["a", "x", "x", "c", "t77", "t500", "y"]
    assert sorted(x.text for x in keystore.excluded(index(new), path, 16).collect()) == ["t500", "x", "x", "y"]
    assert keystore.stored_keys(spark, path).count() == 503
    # buckets without anything that passes their filters aren't read
    asked = index(["a"]).select(keystore.signed_key(F.col("sample_key")).alias("key")).withColumn("bucket", keystore._bucket(16))
    filters = spark.read.schema("bucket int, size long, bits binary, batch int").option("basePath", f"{path}/filters").parquet(f"{path}/filters")
    assert keystore._passing(asked, filters).count() == 1
    fresh = spark.range(3000).select(F.xxhash64("id").alias("key")).withColumn("bucket", keystore._bucket(16))
    assert keystore._passing(fresh, filters).count() < 300
    assert sorted(x.text for x in keystore.excluded(index(["new"]), path, 16).collect()) == ["new"]
    with pytest.raises(files.InvalidFile):
        keystore.append(index(["z"]), path, 1, 16)
    # a batch that broke off may be added again
    os.unlink(f"{path}/keys/batch=1/_SUCCESS")
    keystore.append(index(["c", "w"]), path, 1, 16)
    assert sorted(x.text for x in keystore.excluded(index(["c", "w", "z"]), path, 16).collect()) == ["z"]
    keys = spark.sql("SELECT CAST('18446744073709551615' AS DECIMAL(20,0)) AS k UNION ALL SELECT 5 UNION ALL SELECT NULL")
    assert {x[0] for x in keys.select(keystore.signed_key(F.col("k"))).collect()} == {-1, 5, None}


def test_fingerprints(spark):
    rows = [(i % 3, f"text {i % 40}", None if i % 7 else "u") for i in range(200)]
    df = spark.createDataFrame(rows, "part int, text string, url string")
    whole = fingerprint.fingerprint(df, ["text", "url"])
    for parts in (1, 7):
        assert fingerprint.fingerprint(df.orderBy(F.rand(3)).repartition(parts), ["text", "url"]) == whole
    sums = fingerprint.lane_sums(df, ["text", "url"], ["part"])
    assert fingerprint.fingerprints(fingerprint.merged(sums)).first().fingerprint == whole
    assert fingerprint.fingerprint(df.union(df.limit(1)), ["text", "url"]) != whole
    assert fingerprint.fingerprint(df.withColumn("url", F.coalesce("url", F.lit(""))), ["text", "url"]) != whole
    two = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    assert len({x[0] for x in two.select(fingerprint.row_digest("x", "y")).collect()}) == 2
    assert fingerprint.fingerprint(df.limit(0), ["text"]) == fingerprint.fingerprint(two.limit(0), ["x"])


def test_window_sums(spark, monkeypatch):
    """Sums without ids are those of the windows, for texts of all lengths and doc_ids that repeat."""
    r = np.random.RandomState(5)
    sizes = [0, 1, 6, 7, 8, 9, 300, 5000, 2, 0, 0, 17]
    for doc_ids in ([*range(len(sizes))], [3, 3, 3, None, 7, 7, 1, 9, 10, 11, 12, 12]):
        docs = [(k, bytes(r.randint(97, 123, n).tolist()).decode()) for k, n in zip(doc_ids, sizes)]
        found, total = windows.window_sums(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 8, (10, 256))
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        stream = [b for _, text in docs for b in (*text.encode(), 10, 256)]
        want = {w: sum(stream[8 * w : 8 * w + 9]) for w in range((len(stream) - 1) // 8)}
        assert total == len(stream) and sorted(tuple(x) for x in found.collect()) == sorted(want.items())
    assert windows.window_sums(spark.createDataFrame([], "doc_id long, text string"), 8, (10, 256))[1] == 0
    # a long text in pieces, in a column that begins within its buffer
    monkeypatch.setattr(windows, "SUMMED", 64)
    text = pa.array([b"zz", bytes(range(1, 201)), b"", b"abc"], pa.binary())[1:]
    stream = [*range(1, 201), 10, 256, 10, 256, *b"abc", 10, 256]
    sums = Counter()
    for window, part, n in windows._sums_within(np.array([16, 218, 220]), text, 8, (10, 256)):
        assert len(window) == len(part) == len(n)
        for w, x in zip(window.tolist(), part.tolist()):
            sums[w] += x
    stream = [0] * 16 + stream
    assert sums == {w: sum(stream[8 * w : 8 * w + 9]) for w in range(1, (len(stream) - 1) // 8 + 1)}


def test_epochs_are_dealt_by_place(spark):
    """Ranges of places are known: nothing runs twice to find them; and cursors are exact on either side of 64 bits."""
    rows, _ = epochs.batches(spark.range(97).withColumnRenamed("id", "window_id"), 97, 17, 194, ranges=4)
    assert "rangepartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [x[0] for x in rows.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").select("count").collect()] == [49, 49, 49, 47]
    for chunks in (3037000499, 3037000501, 10**12 + 39):
        epoch, at = S.epochs(17, chunks, 1)[0], [0, 1, 2, chunks // 3, chunks - 2, chunks - 1]
        places = [(c, (c * epoch.stride + epoch.start) % chunks) for c in at]
        got = spark.createDataFrame(places, "c long, w long").select("c", epochs.cursor_of(epoch, F.col("w")).alias("found")).collect()
        assert all(x.c == x.found for x in got)


@pytest.mark.parametrize("chunks", [1, 2, 10, 97])
def test_epochs_with_contents(spark, chunks):
    rows = spark.createDataFrame([(i, [i, i + 1]) for i in range(chunks)], "window_id long, ids array<int>")
    count = 2 * chunks + chunks // 2
    want = [(k, c, (c * e.stride + e.start) % chunks) for k, e in enumerate(S.epochs(17, chunks, 4)) for c in range(chunks)]
    whole, state = epochs.batches(rows, chunks, 17, count, batch=2, accumulation=3, ranges=3)
    got = [(x.epoch, x.cursor, x.window_id) for x in whole.collect()]
    assert got == want[:count] and state == epochs.State(2, chunks // 2)
    for x in whole.collect():
        place = x.epoch * chunks + x.cursor
        assert (x.update, x.microbatch, list(x.ids)) == (place // 6, place // 2, [x.window_id, x.window_id + 1])
    # a run that stops and goes on reads the same
    at, parts = epochs.State(), []
    for n in (max(1, chunks // 3), count - max(1, chunks // 3)):
        part, at = epochs.batches(rows, chunks, 17, n, at, 2, 3)
        parts += [(x.epoch, x.cursor, x.window_id) for x in part.collect()]
    assert parts == want[:count] and at == state
    with pytest.raises(ValueError):
        epochs.batches(rows, chunks, 17, 1, epochs.State(0, chunks))


def test_decoding(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdéü😀 ") for _ in range(r.randrange(2, 9))) for _ in range(1500)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(400)] + ["", "x" * 30_000]
    merges = bpe_train.train([t.encode() for t in texts], 1500)
    assert len(merges) == 1500
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = bpe_encode.decoded(bpe_encode.encoded(df, merges, framed=False, carried=["doc_id"]), merges)
    assert {x.doc_id: x.text for x in back.collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([([0xE9, 97, 256],), (None,), ([],), ([0xF0, 0x9F],)], "ids array<int>")
    assert [x.text for x in bpe_encode.decoded(odd, []).collect()] == ["�a", None, "", "�"]
    for bad in (257, -1):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe_encode.decoded(spark.createDataFrame([([bad],)], "ids array<int>"), []).collect()


def plain_bans(h, n, vocabulary):
    if n == 0 or len(h) < n - 1:
        return []
    found = h if n == 1 else [h[i + n - 1] for i in range(len(h) - n + 1) if h[i : i + n - 1] == h[len(h) - n + 1 :]]
    out = sorted({x for x in found if 0 <= x < vocabulary})
    return [] if len(out) == vocabulary else out


def test_bans(spark):
    r = random.Random(5)
    rows = [[r.randrange(4) for _ in range(r.randrange(14))] for _ in range(200)] + [[0, 1, 2, 3], [9, 0, 9], [-1, 2, -1], [7]]
    df = spark.createDataFrame([(x,) for x in rows], "h array<int>")
    for n in range(5):
        for vocabulary in (4, 10):
            got = df.select("h", history.banned_tokens(F.col("h"), n, vocabulary).alias("b")).collect()
            assert all(list(x.b) == plain_bans(list(x.h), n, vocabulary) for x in got), n
    with pytest.raises(ValueError):
        history.banned_tokens(F.col("h"), -1, 4)


def test_rates(spark):
    r = random.Random(2)
    rows, at = [], 0.0
    for i in range(60):
        at += r.choice([0.0, 0.5, 2.0])
        rows.append((i % 2, i, at, float(r.randrange(9))))
    df = spark.createDataFrame(rows, "k int, i int, at double, n double")
    got = {x.i: x.rate for x in rates.rolling_rates(df, ["k"], F.col("at"), ["i"], "n", 5).collect()}
    for k in (0, 1):
        own = [x for x in rows if x[0] == k]
        ring = rates.RateListener(5)
        for a, b in zip([None, *own], own):
            if a is None:
                assert got[b[1]] is None
                continue
            ring.add("q", b[3], b[2] - a[2])
            assert got[b[1]] == pytest.approx(ring.rate("q"))
    assert rates.RateListener().rate("none") == 0.0


def test_listener_hears_a_stream(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    listener = rates.RateListener()
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        import time

        end = time.time() + 20
        while not any(listener.rates.values()) and time.time() < end:
            time.sleep(0.2)
        assert listener.rates[str(query.id)] > 0
    finally:
        spark.streams.removeListener(listener)


def test_running_chats(spark, tmp_path):
    r = random.Random(9)
    turns = [(c, t, r.choice(["user", "assistant"]), r.choice(["hello there", None, "é the other", "on and on " * 9])) for c in range(6) for t in range(8)]
    turns[3] = (0, 3, "user", "/reset")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "conv_id long, turn long, role string, text string"
    seen: dict = {}
    try:
        for k, cut in enumerate(([0, 3, 8], [0, 8])):
            source, last = tmp_path / f"in{k}", {}
            for a, b in zip(cut, cut[1:]):
                spark.createDataFrame([x for x in turns if a <= x[1] < b], schema).coalesce(1).write.mode("append").parquet(str(source))
                query = chat.contexts(spark.readStream.schema(schema).parquet(str(source)), B.MERGES, 16)
                take = lambda df, _: last.update({x.conv_id: (x.n_tokens, list(x.context)) for x in df.collect()})  # noqa: B023, E731
                query.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination(120)
            seen[k] = last
    finally:
        spark.conf.unset(conf)
    table = bpe_encode.Merges(B.MERGES)
    import numpy as np

    for c in range(6):
        ids = [296]
        for _, _, role, text in sorted(x for x in turns if x[0] == c):
            if text == "/reset":
                ids = [296]
                continue
            data = np.frombuffer(f"{role}: {text or ''}\n".encode(), np.uint8)
            ids += table.encode(data, np.array([len(data)]))[0].tolist()
        assert seen[0][c] == seen[1][c] == (len(ids), ids[-32:])


def test_prepare(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "cat", "héron", "sat"]) for _ in range(r.randrange(1, 40))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "")], "doc_id long, text string").repartition(4)
    store, one, two = (str(tmp_path / x) for x in ("store", "one", "two"))
    made = prepare.prepare(df, one, ["doc_id"], merges=20, sample_bytes=2000, store=store, batch=0, entries=16)
    merges = files.load_tokenizer(f"{one}/tokenizer.json")
    assert made["documents"] == 120 and 0 < len(merges) <= 20
    docs = {s: [list(x.ids) for x in sorted(positional.token_documents(spark, positional.parts_of(f"{one}/tokens", s), 256 + len(merges)).collect())] for s in ("train", "validation")}
    words = B.vocabulary(merges)
    index = sorted(corpus.indexed(df).collect())
    for split, own in docs.items():
        want = [x.text + "\n" for x in index if x.is_validation == (split == "validation")]
        assert [b"".join(words[i] for i in d).decode() for d in own] == want
        assert made["tokens"][split] == sum(map(len, own))
    # the same again is not done again; other rows, a lost file or another tokenizer are
    stamp = os.path.getmtime(f"{one}/manifest.json")
    assert prepare.prepare(df.orderBy(F.rand()), one, ["doc_id"], merges=20, sample_bytes=2000, store=store, batch=0, entries=16) == json.loads(json.dumps(made))
    assert os.path.getmtime(f"{one}/manifest.json") == stamp
    # what broke off after the manifest is made up for; other rows can't take the same batch
    os.unlink(f"{store}/keys/batch=0/_SUCCESS")
    prepare.prepare(df, one, ["doc_id"], merges=20, sample_bytes=2000, store=store, batch=0, entries=16)
    assert keystore.has_batch(spark, store, 0) and keystore.stored_keys(spark, store).distinct().count() == len(set(texts))
    with pytest.raises(files.InvalidFile):
        prepare.prepare(df.limit(5), two, ["doc_id"], merges=20, sample_bytes=2000, store=store, batch=0)
    # a later corpus leaves out what the store has
    more = spark.createDataFrame([(1, texts[5]), (2, "something new"), (3, "and more")], "doc_id long, text string")
    later = prepare.prepare(more, two, ["doc_id"], tokenizer=merges, store=store)
    assert later["documents"] == 2
    assert prepare.shared_tokenizer([one, two]) == made["tokenizer"]
    files.save_tokenizer(merges[:-1], f"{two}/tokenizer.json")
    with pytest.raises(files.InvalidFile):
        prepare.shared_tokenizer([one, two])
    assert prepare.prepare(more, two, ["doc_id"], tokenizer=merges, store=store)["tokenizer"] == made["tokenizer"]


def test_reports(spark):
    rows = [(0.4, 0.0), (999.4, 5.0), (12345.6, 1.0), (1.0, 7300.0), (0.0, 5.0)]
    df = spark.createDataFrame(rows, "rate double, left double").select("left", report.rate_text(F.col("rate")).alias("r"), report.time_left(F.lit(10.0), F.col("left") + 10, F.lit(1.0)).alias("t"))
    assert [x.r for x in df.collect()] == ["0", "999", "12.3k", "1", "0"] and [x.t for x in df.collect()] == ["0s", "5s", "1s", "2h01m", "5s"]
    odd = spark.range(1).select(report.time_left(F.lit(0.0), F.lit(9.0), F.lit(1.0)).alias("a"), report.time_left(F.lit(1.0), F.lit(9.0), F.lit(0.0)).alias("b"), report.time_left(F.lit(1.0), F.lit(188.0), F.lit(1.0)).alias("c")).first()
    assert tuple(odd) == ("--", "--", "3m07s")
    urls = spark.createDataFrame([("HTTP://x",), ("https://",), ("/a/http://",), ("ftp://x",), (None,)], "u string")
    assert [x.a for x in urls.select(report.is_address(F.col("u")).alias("a")).collect()] == [True, True, False, False, False]


def test_copies(tmp_path):
    source, local = tmp_path / "a", str(tmp_path / "in" / "a")
    source.write_bytes(b"x" * 100)
    shard = {"path": "a", "size": 100}
    assert files.copied(shard, str(source), local) and not files.copied(shard, str(source), local)
    assert files.copied(shard, source.as_uri(), str(tmp_path / "in" / "b"))
    with pytest.raises(files.InvalidFile):
        files.copied({"path": "a", "size": 99}, str(source), str(tmp_path / "in" / "c"))
    assert sorted(os.listdir(tmp_path / "in")) == ["a", "b"]


def test_bigram_loss(spark):
    import math

    r = random.Random(8)
    rows = [(i, [r.randrange(5) for _ in range(9)]) for i in range(30)]
    df = spark.createDataFrame(rows, "window_id long, ids array<int>").repartition(4)
    counts: dict = {}
    for _, ids in rows:
        for pair in zip(ids, ids[1:]):
            counts[pair] = counts.get(pair, 0) + 1
    trained = evaluate.target_counts(df)
    assert {(x.left, x.right): x.n for x in trained.collect()} == counts
    picked = evaluate.validation_windows(df, 30, 7, 4, 9)
    want = [(c * e.stride + e.start) % 30 for e in S.epochs(7, 30, 2) for c in range(30)][:36]
    assert [x.window_id for x in picked.collect()] == want
    got = evaluate.bigram_loss(trained, picked, 6).first()
    losses = [-math.log((counts.get(p, 0) + 1) / (sum(n for (a, _), n in counts.items() if a == p[0]) + 6)) for w in want for p in zip(rows[w][1], rows[w][1][1:])]
    assert (got.windows, got.tokens) == (36, 36 * 8)
    assert got.loss == pytest.approx(sum(losses) / len(losses)) and got.perplexity == pytest.approx(math.exp(got.loss))


def test_resumed_runs(tmp_path):
    plan = evaluate.Plan(100, 1e-3, 1e-4, 10, 0.1, 1.0, 4, 2, 128)
    run, path = evaluate.Run(plan, 30, 5, epochs.State(1, 7)), str(tmp_path / "run.json")
    run.save(path)
    assert evaluate.Run.load(path) == run
    begun = run.resumed(plan, "d", "t")
    assert (begun.data, begun.tokenizer, begun.sampler) == ("d", "t", epochs.State(1, 7)) and begun.resumed(plan, "d", "t") == begun
    from dataclasses import replace

    for bad in ((plan, "e", "t"), (plan, "d", "u"), (replace(plan, batch=8), "d", "t")):
        with pytest.raises(files.InvalidFile):
            begun.resumed(*bad)
    with pytest.raises(files.InvalidFile, match="beyond"):
        replace(begun, step=101).resumed(plan, "d", "t")
    with pytest.raises(ValueError):
        run.resumed(plan, " ", "t")
    (tmp_path / "run.json").write_text("{}")
    with pytest.raises(files.InvalidFile):
        evaluate.Run.load(path)


def test_rates_are_rounded_as_their_sql_does(spark):
    import duckdb

    r = random.Random(5)
    rates = [0.5, 1.5, 2.5, 999.5, 1000.0, 1050.0, 1150.0, 1250.0, 1349.99, 1350.0, 1e16, 7e19, *(50.0 * k for k in range(20, 400)), *(k + 0.5 for k in range(50)), *(round(r.uniform(0, 10**r.randrange(1, 12)), 2) for _ in range(2000))]
    sums = [1.005, 2.675, 1.115, 0.125, -1.005, 1e17, *(k / 1000 for k in range(5, 9000, 10)), *(r.uniform(0, 1e9) for _ in range(500))]
    found = spark.createDataFrame([(x,) for x in rates], "x double").select("x", report.rate_text(F.col("x")).alias("y")).collect()
    c = duckdb.connect()
    text = c.execute("SELECT x, CASE WHEN x >= 1000 THEN printf('%.1fk', x / 1000) ELSE printf('%.0f', x) END FROM (SELECT unnest(?::DOUBLE[]) AS x)", [rates]).fetchall()
    assert [tuple(x) for x in found] == text
    found = spark.createDataFrame([(x,) for x in sums], "x double").select("x", report.rounded(F.col("x"), 2).alias("y")).collect()
    assert [tuple(x) for x in found] == c.execute("SELECT x, round(x, 2) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [sums]).fetchall()
