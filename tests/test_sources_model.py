"""Files and their failures, growing corpora, and the small model."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.model import gpt
from corpusloom.sources import files
from corpusloom.streaming import ingest


def test_shards(tmp_path, spark):
    entries = [{"type": "file", "path": p, "size": 1} for p in ("b.parquet", "a.parquet", "a.txt")] + [{"type": "directory", "path": "c.parquet"}]
    assert [x["path"] for x in files.list_shards(entries)] == ["a.parquet", "b.parquet"]
    assert [x["path"] for x in files.list_shards(entries, 1)] == ["a.parquet"]
    with pytest.raises(files.InvalidFile):
        files.list_shards([])
    spark.createDataFrame([("x",), (None,)], "text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    shard = files.local_shards(str(tmp_path / "p"))[0]
    assert files.reusable(shard, shard["path"]) and not files.reusable(shard | {"size": 1}, shard["path"])
    assert [(x.text, x.url) for x in files.scan_shards(spark, [shard["path"]]).orderBy("row").collect()] == [("x", None), (None, None)]


def test_token_files(tmp_path, spark):
    docs = spark.createDataFrame([(1, [5, 9]), (0, [7, 65535, 9]), (2, [9])], "doc_id long, ids array<int>")
    path = str(tmp_path / "t.bin")
    assert files.write_tokens(docs, path) == 6
    assert np.fromfile(path, "<u2").tolist() == [7, 65535, 9, 5, 9, 9]
    back = files.documents_of(files.read_tokens(spark, path), 9)
    assert [list(x.ids) for x in back.orderBy("doc_id").collect()] == [[7, 65535, 9], [5, 9], [9]]
    with pytest.raises(Exception, match="inside a document"):
        files.documents_of(files.read_tokens(spark, path), 5).collect()
    with pytest.raises(files.InvalidFile):
        files.write_tokens(spark.createDataFrame([(0, [70000])], "doc_id long, ids array<int>"), path)
    assert os.path.getsize(path) == 12
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="even number"):
        files.read_tokens(spark, str(tmp_path / "odd.bin")).collect()


def test_tokenizer_files(tmp_path):
    path = str(tmp_path / "t.json")
    files.save_tokenizer([(97, 98), (256, 99)], path)
    assert files.load_tokenizer(path) == [(97, 98), (256, 99)]
    good = json.loads(open(path).read())
    for bad in ({"Version": 1}, {"Merges": [[97, 98]]}, {"Merges": [[300, 98, 256]], "EosTokenId": 257}, {"Merges": [[97, 98, 300]], "EosTokenId": 257}, {"EosTokenId": 7}):
        with open(path, "w") as f:
            json.dump(good | bad, f)
        with pytest.raises(files.InvalidFile):
            files.load_tokenizer(path)


def test_manifests(tmp_path):
    data, path = tmp_path / "d", str(tmp_path / "m.json")
    data.write_text("x")
    assert files.read_manifest(path) is None and not files.fresh(path, {}, {})
    files.write_manifest({"source": "s", "files": {"d": files.file_digest(str(data))}}, path)
    assert files.fresh(path, {"source": "s"}, {"d": str(data)})
    assert not files.fresh(path, {"source": "t"}, {"d": str(data)})
    data.write_text("y")
    assert not files.fresh(path, {"source": "s"}, {"d": str(data)})
    files.write_manifest({"source": "new"}, path)
    assert json.loads(open(f"{path}.bak").read())["source"] == "s"
    with pytest.raises(ZeroDivisionError), files.atomic(path):
        raise ZeroDivisionError
    assert files.read_manifest(path) == {"source": "new"} and sorted(os.listdir(tmp_path)) == ["d", "m.json", "m.json.bak"]


def test_mixture_spec():
    spec = {"Version": 1, "TrainTokens": 10, "validationtokens": 2, "SOURCES": [{"Name": "a", "path": "x", "weight": 1}, {"name": "b", "path": "y", "weight": 2}]}
    assert files.mixture_spec(json.dumps(spec))["sources"][1]["weight"] == 2.0
    for bad in ({"TrainTokens": 0}, {"SOURCES": []}, {"SOURCES": [{"name": "a", "path": "x", "weight": -1}]}, {"SOURCES": [{"name": "a", "path": "x", "weight": 1}, {"name": "A", "path": "z", "weight": 1}]}):
        with pytest.raises(files.InvalidFile):
            files.mixture_spec(json.dumps(spec | bad))


def test_ingest_resumes(tmp_path, spark):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write = lambda rows: spark.createDataFrame(rows, "text string, url string").coalesce(1).write.mode("append").parquet(source)
    write([("one", None), ("", "u"), (None, "v")])
    for extra in ([], [("two", "w")]):
        if extra:
            write(extra)
        ingest.ingest(spark, source, "text string, url string", target, checkpoint).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert len(rows) == 2 and all(x.ids[-1] == 296 for x in rows)


def test_decoding_in_parts(tmp_path, spark):
    text = "aé😀z"
    data = text.encode()
    rows = [("k", i, data[i : i + 1]) for i in range(len(data))]
    df = spark.createDataFrame(rows, "key string, part long, bytes binary")
    assert ingest.decode_chunks(df).first().text == text
    source = str(tmp_path / "in")
    for lo, hi in ((0, 3), (3, 9)):
        df.where((F.col("part") >= lo) & (F.col("part") < hi)).coalesce(1).write.mode("append").parquet(source)
    chunks = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.decoded(chunks).writeStream.format("memory").queryName("parts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    out = spark.table("parts").orderBy("part").collect()
    assert "".join(x.text for x in out) == text and [x.text for x in out[:3]] == ["a", "", "é"]


TINY = gpt.Config(12, 6, 8, 2, 2)


def test_gradients_are_numeric_ones():
    r = np.random.RandomState(0)
    p = {k: v + r.normal(0, 0.2, v.shape) for k, v in gpt.initial(TINY, 0).items()}
    ids, targets = r.randint(0, 12, (2, 6)), r.randint(-1, 12, (2, 6))
    _, grads = gpt.loss_and_gradients(p, TINY, ids, targets)
    assert set(grads) == set(p)
    for k in p:
        for _ in range(3):
            at = tuple(r.randint(0, s) for s in p[k].shape)
            was = p[k][at]
            values = []
            for step in (1e-5, -1e-5):
                p[k][at] = was + step
                values.append(gpt.loss_and_gradients(p, TINY, ids, targets)[0])
            p[k][at] = was
            assert grads[k][at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)


def test_training_and_checkpoints(tmp_path, spark):
    r = np.random.RandomState(1)
    rows = r.randint(0, 12, (8, 7))
    windows = spark.createDataFrame([(x.tolist(),) for x in rows], "ids array<int>").repartition(3)
    p, optimizer = gpt.initial(TINY, 1), gpt.AdamW()
    loss, grads = gpt.distributed_gradients(windows, p, TINY)
    alone, want = gpt.loss_and_gradients(p, TINY, rows[:, :-1], rows[:, 1:])
    assert loss == pytest.approx(alone) and all(np.allclose(grads[k], want[k]) for k in want)
    for _ in range(120):
        value, grads = gpt.loss_and_gradients(p, TINY, rows[:, :-1], rows[:, 1:])
        optimizer.step(p, gpt.clipped(grads, 1.0)[0], 1e-2)
    assert value < 0.5 * alone
    path = str(tmp_path / "c.bin")
    gpt.save(path, p, TINY, optimizer, step=120)
    q, config, resumed, state = gpt.load(path)
    assert config == TINY and state == {"step": 120} and resumed.t == 120
    assert all(np.allclose(p[k], q[k], atol=1e-6) for k in p)
    content = bytearray(open(path, "rb").read())
    content[-40] ^= 1
    open(path, "wb").write(content)
    with pytest.raises(files.InvalidFile):
        gpt.load(path)


def test_sampling():
    assert gpt.adjusted([4, -2, 3, 1], [0, 1, 0], 2.0).tolist() == [2, -4, 3, 1]
    assert np.flatnonzero(np.isneginf(gpt.adjusted([0.0] * 5, [1, 2, 3, 1, 2], 1.0, 3))).tolist() == [3]
    assert not np.isneginf(gpt.adjusted([0.0] * 2, [0, 1], 1.0, 1)).any()
    assert gpt.sampled(np.array([1.0, 3.0, 3.0]), 0.9, 0) == 1
    assert {gpt.sampled(np.array([1.0, 3.0, 3.0]), u, 1.0, 1) for u in np.linspace(0, 0.999, 50)} == {1, 2}
    shares = np.bincount([gpt.sampled(np.log([0.5, 0.3, 0.2]), u) for u in np.linspace(0, 0.9999, 1000)]) / 1000
    assert np.allclose(shares, [0.5, 0.3, 0.2], atol=0.01)
    with pytest.raises(ValueError):
        gpt.sampled(np.zeros(2), 0.5, float("nan"))
    clipped, norm = gpt.clipped({"a": np.array([3.0]), "b": np.array([4.0])}, 1.0)
    assert norm == 5 and clipped["a"][0] == pytest.approx(0.6) and clipped["b"][0] == pytest.approx(0.8)
    with pytest.raises(FloatingPointError):
        gpt.clipped({"a": np.array([np.nan])}, 1.0)
    out = list(gpt.generate(gpt.initial(TINY, 0), TINY, [1], 20, 0, seed=1))
    assert len(out) == 20 or out[-1] == 0


def test_gradients_go_through_wide_arrays_seldom():
    """A softmax over the vocabulary is one exponential between products, and stays finite where a plain one isn't."""
    import tracemalloc

    c = gpt.Config(512, 64, 16, 1, 2)
    p, r = gpt.initial(c, 0), np.random.RandomState(2)
    ids = r.randint(0, 512, (32, 65))
    tracemalloc.start()
    loss, _ = gpt.loss_and_gradients(p, c, ids[:, :-1], ids[:, 1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(loss - np.log(512)) < 0.1 and peak < 4 * 32 * 64 * 512 * 8
    large = {k: v * 2000 if k == "tok" else v for k, v in p.items()}
    loss, grads = gpt.loss_and_gradients(large, c, ids[:, :-1], ids[:, 1:])
    logits = gpt.forward(large, c, ids[:, :-1])
    top = logits.max(-1)
    plain = np.log(np.exp(logits - top[..., None]).sum(-1)) + top - np.take_along_axis(logits, ids[:, 1:, None], -1)[..., 0]
    assert np.isfinite(loss) and abs(loss / plain.mean() - 1) < 1e-9 and all(np.isfinite(g).all() for g in grads.values())


def test_gradients_in_32_bits(spark, monkeypatch):
    """A batch's numbers stay in the parameters' precision, and attention in spans of any size is the same."""
    c = gpt.Config(257, 100, 16, 2, 2)
    p, r = gpt.initial(c, 3), np.random.RandomState(4)
    ids = r.randint(0, 257, (20, 101))
    loss, want = gpt.loss_and_gradients(p, c, ids[:, :-1], ids[:, 1:])
    short = {k: v.astype(np.float32) for k, v in p.items()}
    value, grads = gpt.loss_and_gradients(short, c, ids[:, :-1], ids[:, 1:])
    assert all(g.dtype == np.float32 for k, g in grads.items() if k != "tok") and gpt._hidden(short, c, ids[:, :-1])[0].dtype == np.float32
    assert abs(value - loss) < 1e-6 and all(np.abs(grads[k] - want[k]).max() < 1e-6 for k in want)
    windows = spark.createDataFrame([(x.tolist(),) for x in ids], "ids array<int>").repartition(3)
    value, grads = gpt.distributed_gradients(windows, p, c, 4, np.float32)
    assert abs(value - loss) < 1e-6 and all(np.abs(grads[k] - want[k]).max() < 1e-7 for k in want)
    sharp = {k: v * 300 if k.endswith("qkv.w") else v for k, v in p.items()}
    steep, own = gpt.loss_and_gradients(sharp, c, ids[:, :-1], ids[:, 1:])
    monkeypatch.setattr(gpt, "SPAN", 1000)
    for weights, a, b in ((p, loss, want), (sharp, steep, own)):
        value, grads = gpt.loss_and_gradients(weights, c, ids[:, :-1], ids[:, 1:])
        assert np.isfinite(value) and abs(value - a) < 1e-9 and all(np.allclose(grads[k], b[k], rtol=1e-6, atol=1e-9) for k in want)
