"""Operators on corpora: identities, byte pairs, mixtures, windows, schedules."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import bytepair as B
from corpusloom.functions import identity as I
from corpusloom.functions import schedule as S
from corpusloom.operators import bpe_encode, bpe_train, corpus, mixture, windows
from corpusloom.sources.shared import discard, stored


def test_identity_and_split(spark):
    rows = [(1, "http://a", "x"), (2, "", "text"), (3, None, "text"), (4, "u", None), (5, "u", ""), (6, None, "  ")]
    out = {x.doc_id: x for x in corpus.indexed(spark.createDataFrame(rows, "doc_id long, url string, text string")).collect()}
    assert set(out) == {1, 2, 3, 6}
    for i, url, text in rows:
        if i in out:
            h = hashlib.sha256((url or text).encode()).digest()
            assert out[i].is_validation == (int.from_bytes(h[:8], "little") % 10 == 0)
            assert int(out[i].sample_key) == int.from_bytes(h[8:16], "little")
            assert out[i].doc_bytes == len(text.encode()) + 1


def test_exclusion_keeps_repeats(spark):
    index = corpus.indexed(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    prior = corpus.indexed(spark.createDataFrame([(9, "b")], "doc_id long, text string"))
    assert sorted(x.doc_id for x in corpus.excluded(index, prior).collect()) == [1, 2]


def test_sample_cutoff():
    assert I.sample_cutoff(100, 10) == I.U64_MAX and I.sample_cutoff(0, 10) == 0
    assert I.sample_cutoff(9, 100) == int(0.1 * I.U64_MAX)


def greedy(text: bytes, merges) -> list[int]:
    ids = list(text)
    for k, pair in enumerate(merges):
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pair:
                out.append(256 + k)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def test_encode_and_decode(spark):
    texts = ["", "the the", "aaa", "é😀 the\n", "enanon"]
    chars = B.encode_chars(F.col("text"))
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", B.char_ids(chars).alias("ids"), B.decode_chars(chars).alias("back"))
    for x in df.collect():
        assert list(x.ids) == greedy(x.text.encode(), B.MERGES) and x.back == x.text


def test_encoding_by_sweeps(spark):
    """Merges in rising order, leftmost first, whatever their number and however texts repeat."""
    r = random.Random(12)
    for _ in range(60):
        texts = [bytes(r.choice(b"aab ") for _ in range(r.randrange(50))) for _ in range(r.randrange(1, 6))]
        merges = bpe_train.train([bytes(r.choice(b"aab ") for _ in range(300))], r.randrange(40))
        ids, ends = bpe_encode.Merges(merges).encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts]))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == [greedy(x, merges) for x in texts]
    docs = [("the cat sat on the mat " * 40, 1), (None, 2), ("", 3), ("é😀" * 9, None), ("a" * 100_001, 5)]
    merges = bpe_train.train([x.encode() for x, _ in docs if x], 300)
    df = spark.createDataFrame([(*x, "mine") for x in docs], "text string, doc_id long, ids string")
    rows = bpe_encode.encoded(df, merges).collect()
    words = B.vocabulary(merges)
    for x in rows:
        assert b"".join(words[i] for i in x.ids).decode() == ("" if x.text is None else x.text + "\n")
        assert x.text is None or len(x.text) > 10**4 or list(x.ids) == greedy((x.text + "\n").encode(), merges)
    assert bpe_encode.encoded(df.where("false"), merges).collect() == []
    with pytest.raises(ValueError):
        bpe_encode.Merges([(300, 1)])


def test_training_many_merges_is_quick():
    import time

    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(500)]
    text = " ".join(r.choice(words) for _ in range(180_000)).encode()[: 10**6]
    began = time.time()
    assert len(bpe_train.train([text], 300)) == 300
    assert time.time() - began < 60


def plain_train(docs, merges):
    docs, out = [list(d) for d in docs], []
    for k in range(merges):
        counts: dict = {}
        for d in docs:
            for pair in zip(d, d[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < 2:
            break
        out.append(best)
        for i, d in enumerate(docs):
            new, j = [], 0
            while j < len(d):
                if tuple(d[j : j + 2]) == best:
                    new.append(256 + k)
                    j += 2
                else:
                    new.append(d[j])
                    j += 1
            docs[i] = new
    return out


def test_training(spark):
    assert bpe_train.train([b"ab" * 100], 1) == [(97, 98)]
    assert B.vocabulary([(97, 98)])[256:] == [b"ab", b""]
    assert bpe_train.train([b"a", b"b", b"a", b"b"], 5) == []
    r = random.Random(1)
    for _ in range(40):
        docs = [bytes(r.choice(b"abc ") for _ in range(r.randrange(60))) for _ in range(4)]
        assert bpe_train.train(docs, 25) == plain_train(docs, 25)
    docs = ["the cat the hat\n", "aaaa aaa\n"]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    assert [(a, b) for a, b, _ in bpe_train.train_by_passes(df, 6)] == plain_train([d.encode() for d in docs], 6)
    assert bpe_train.train_sample(spark.createDataFrame([(d[:-1],) for d in docs], "text string"), 6) == plain_train([d.encode() for d in docs], 6)


def test_training_passes(spark):
    """Passes of several merges with kept counts come to the merges of one at a time."""
    import pyarrow as pa

    def passes(docs, merges):
        texts = pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array([1 + i % 3 for i in range(len(docs))], pa.int64())], ["text", "weight"])
        table, counts, out, sizes = list(bpe_train._begun(iter([texts]))), {}, [], []
        while len(out) < merges:
            for batch in table:
                for left, right, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    if left is not None:
                        counts[left, right] = counts.get((left, right), 0) + n
            assert all(n >= 0 for n in counts.values())
            ranked = sorted(((a, b, n) for (a, b), n in counts.items() if n), key=lambda x: (-x[2], x[0], x[1]))
            batch = bpe_train.known_merges(ranked)[: merges - len(out)]
            if not batch:
                break
            sizes.append(len(batch))
            chunks = [pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["ids", "weights"]) for x in table if x.num_rows and x.column(0).null_count == 0]
            table = list(bpe_train._applied([(a, b) for a, b, _ in batch], 256 + len(out))(iter(chunks)))
            out += batch
        return out, sizes

    r = random.Random(11)
    several = 0
    for k in range(60):
        docs = [bytes(r.choice(b"ab" if k % 3 == 0 else b"abcde fgh") for _ in range(r.randrange(80))) for _ in range(6)]
        out, sizes = passes(docs, 40)
        assert [(a, b) for a, b, _ in out] == plain_train([d for i, d in enumerate(docs) for _ in range(1 + i % 3)], 40)
        several += sum(n > 1 for n in sizes)
    assert several > 20
    assert bpe_train.known_merges([(1, 2, 9), (3, 4, 9), (2, 5, 8), (6, 7, 8)]) == [(1, 2, 9), (3, 4, 9)]
    assert bpe_train.known_merges([(1, 1, 9), (3, 4, 9)]) == [(1, 1, 9)] and bpe_train.known_merges([(1, 2, 1)]) == []
    ids = np.array([7, 256, 70_000, -1, 65_534], np.int32)
    assert bpe_train._unpacked(bpe_train._packed(ids, 70_001), 70_001).tolist() == ids.tolist()
    assert len(bpe_train._packed(ids[:2], 300)) == 4 and bpe_train._unpacked(bpe_train._packed(ids[[0, 3]], 300), 300).tolist() == [7, -1]
    # equal texts are kept once
    docs = ["the cat the hat", "aaaa aaa", None, "", "the cat the hat"] * 3
    df = spark.createDataFrame([(d, 1) for d in docs], "text string, weight int").repartition(3)
    got = bpe_train.train_by_passes(df, 12, framed=True)
    assert [(a, b) for a, b, _ in got] == plain_train([(d + "\n").encode() for d in docs if d is not None], 12)
    assert bpe_train.train_by_passes(df.where("false"), 3) == []


def plain_mix(sources, target):
    emitted, at, out, total = [0] * len(sources), [0] * len(sources), [], 0
    while total < target:
        i = min(range(len(sources)), key=lambda k: (emitted[k] / sources[k][0], k))
        if at[i] == len(sources[i][1]):
            raise ValueError
        doc, n = sources[i][1][at[i]]
        at[i] += 1
        out.append((doc, i, n, total))
        emitted[i] += n
        total += n
    return out


def test_mixture_is_the_greedy_order(spark):
    r = random.Random(2)
    for _ in range(3):
        sources, doc = [], 0
        for _ in range(3):
            docs = []
            for _ in range(30):
                docs.append((doc, r.randrange(1, 30)))
                doc += 1
            sources.append((r.choice([0.5, 1.0, 2.0]), docs))
        rows = [(d, i, w, n) for i, (w, docs) in enumerate(sources) for d, n in docs]
        df = spark.createDataFrame(rows, "doc_id long, source_index int, weight double, tokens long")
        assert sorted(map(tuple, mixture.mixed(df, 200).collect()), key=lambda x: x[3]) == plain_mix(sources, 200)
    with pytest.raises(Exception, match="ended before"):
        mixture.mixed(df, 10**6).collect()
    a, b = [(0, i, 3) for i in range(20)], [(1, 20 + i, 3) for i in range(20)]
    df = spark.createDataFrame([(d, s, 3.0 - 2 * s, n) for s, d, n in a + b], "doc_id long, source_index int, weight double, tokens long")
    got = {x.source_index: x.n for x in mixture.mixed(df, 24).groupBy("source_index").agg(F.sum("tokens").alias("n")).collect()}
    assert got == {0: 18, 1: 6}


def test_windows(spark):
    ids = list(range(81))
    docs = [(0, ids[:5]), (1, []), (5000, ids[5:70]), (5001, ids[70:])]
    out = {x.window_id: list(x.ids) for x in windows.context_windows(spark.createDataFrame(docs, "doc_id long, ids array<int>"), 8).collect()}
    assert out == {i: ids[8 * i : 8 * i + 9] for i in range(10)}


def test_windows_are_cut_anywhere():
    """Whole windows and pieces of stretches come to the windows of the stream, however it is cut."""
    r = random.Random(1)
    for _ in range(1500):
        c, n = r.randrange(1, 9), r.randrange(60)
        stream, whole, pieces = np.arange(n, dtype=np.int32), {}, {}

        def take(found, more):
            for w, row in zip(found[0].tolist(), found[1].tolist()):
                assert whole.setdefault(w, row) is row  # noqa: B023
            for w, at, ids in more:
                pieces.setdefault(w, []).append((at, ids.tolist()))  # noqa: B023

        cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(r.randrange(4)))})
        for a, b in zip(cuts, cuts[1:]):
            stretch, at = windows._Stretch(a, c), a
            while at < b:
                step = min(b, at + r.randrange(1, 12))
                stretch.add(stream[at:step])
                at = step
                if r.random() < 0.4 and at < b:
                    take(*stretch.cut(False))
            take(*stretch.cut(True))
        for w, own in pieces.items():
            ids = sum((x for _, x in sorted(own)), [])
            if len(ids) == c + 1:
                assert whole.setdefault(w, ids) is ids
        assert whole == {w: list(range(w * c, w * c + c + 1)) for w in range((n - 1) // c if n else 0)}


def test_random_and_epochs(spark):
    random_ = S.Pcg32(42)
    assert [random_.u32() for _ in range(4)] == [3718933621, 842511388, 3765488214, 3246029177]
    assert [(e.start, e.stride) for e in S.epochs(17, 10, 2)] == [(2, 7), (1, 1)]
    assert [(e.start, e.stride) for e in S.epochs(42, 1000, 2)] == [(204, 423), (502, 421)]
    epoch = S.epochs(17, 10, 1)[0]
    assert sorted(x[0] for x in spark.range(10).select(epoch.order(F.col("id"))).collect()) == list(range(10))
    with pytest.raises(ValueError):
        S.epochs(1, 0, 1)


def test_rates_and_budgets(spark):
    steps = [0, 4, 9, 55, 100, 150]
    got = [x[0] for x in spark.createDataFrame([(s,) for s in steps], "s long").select(S.learning_rate(F.col("s"), 100, 1.0, 0.1, 10)).collect()]
    assert got == pytest.approx([0.1, 0.5, 1.0, 0.55, 0.1, 0.1])
    assert S.updates(1025, 512) == 3 and S.epoch_tokens(101, 1.5) == 150
    assert [S.parameter_count(S.PRESET_VOCABULARY, c, w, n) for _, c, w, n, *_ in S.PRESETS] == [97934592, 219237376, 320007168]
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            S.learning_rate(F.col("s"), bad[0], 1.0, 0.1, bad[1])


def test_ids_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([([70000],)], "ids array<int>").select(corpus.checked_ids(F.col("ids"))).collect()


def test_tables_of_chunks_are_held_in_small_rows_and_row_groups(spark, monkeypatch):
    """Tasks hold several rows of a table, and a row group of it, in memory."""
    import pyarrow.parquet as pq

    tables = []
    kept = lambda *a, **b: tables.append(stored(*a, **b)) or tables[-1]
    monkeypatch.setattr(bpe_train, "stored", kept)
    monkeypatch.setattr(bpe_train, "discard", lambda *tables: None)
    r = random.Random(3)
    texts = [bytes(r.choices(b"aabcdefgh", k=20_000)).decode() for _ in range(400)]
    found = bpe_train.train_by_passes(spark.createDataFrame([(x,) for x in texts], "text string"), 2)
    assert found[0] == (97, 97, sum(len(re.findall("a(?=a)", x)) for x in texts)) and len(found) == 2
    chunks = [t for t in tables if "ids" in t.columns]
    assert len(chunks) == 2
    for table in chunks:
        assert table.agg(F.max(F.octet_length("ids"))).first()[0] <= 1 << 20
        for file in table.inputFiles():
            groups = pq.ParquetFile(file.removeprefix("file://")).metadata
            assert max(groups.row_group(k).total_byte_size for k in range(groups.num_row_groups)) <= 24 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    discard(*tables)


def test_ids_travel_to_their_windows_in_few_bytes(spark, monkeypatch):
    """The tables and shuffles on the way to windows take about a byte for a small id."""
    import os

    from corpusloom.operators import prefix

    tables = []
    monkeypatch.setattr(prefix, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    r = random.Random(4)
    docs = [(k, [r.choice([97, 98, 256, 70_000]) for _ in range(r.randrange(3000))]) for k in range(100)] + [(100, None), (101, [])]
    stream = [x for _, ids in docs for x in ids or []]
    found = windows.context_windows(spark.createDataFrame(docs, "doc_id long, ids array<int>"), 64).collect()
    assert {x.window_id: x.ids for x in found} == {k: stream[64 * k : 64 * k + 65] for k in range((len(stream) - 1) // 64)}
    assert dict(tables[0].dtypes)["ids"] == "binary"
    assert sum(os.path.getsize(x.removeprefix("file://")) for x in tables[0].inputFiles()) < 2 * len(stream)
    discard(*tables)
