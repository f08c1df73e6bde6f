"""Streams written in ranges and read back by place."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.sources import positional as P
from corpusloom.sources.files import InvalidFile


def documents():
    r = random.Random(4)
    texts = ["".join(r.choice("ab é\n") for _ in range(r.randrange(1, 60))) for _ in range(256)]
    return texts[:100] + ["x" * 100_000] + texts[100:]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    texts = documents()
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    path = str(tmp_path_factory.mktemp("streams") / "corpus")
    index = corpus.indexed(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    found = P.write_corpus(index, path, "doc_id", ranges=5)
    keys = {x.doc_id: x for x in index.collect()}
    return path, texts, found, keys


def single(texts, keys):
    body = b"".join(t.encode() + b"\n" for t in texts)
    entries = b"".join(len(t.encode() + b"\n").to_bytes(8, "little") + bytes([keys[i].is_validation]) + int(keys[i].sample_key).to_bytes(8, "little") for i, t in enumerate(texts))
    return body, entries


def test_bytes_are_those_of_one_writer(spark, written, tmp_path):
    path, texts, found, keys = written
    body, entries = single(texts, keys)
    assert found == {"rows": 257, "bytes": {"corpus": len(body), "index": 17 * 257}}
    for stream, want in (("corpus", body), ("index", entries)):
        parts = P.parts_of(path, stream)
        assert len(parts) > 1 and P._read(parts, 0, P.total(parts)) == want
        P.join_stream(spark, parts, str(tmp_path / stream))
        assert (tmp_path / stream).read_bytes() == want


@pytest.mark.parametrize("entries", [257, 65, 4])
def test_read_by_position(spark, written, entries):
    path, texts, _, keys = written
    df = P.read_indexed(spark, P.parts_of(path, "index"), P.parts_of(path, "corpus"), entries)
    assert df.rdd.getNumPartitions() == -(-257 // entries)
    rows = sorted(df.collect())
    assert [(x.position, bytes(x.content).decode()) for x in rows] == [(i, t + "\n") for i, t in enumerate(texts)]
    assert all((x.doc_bytes, x.is_validation, x.sample_key) == (keys[i].doc_bytes, keys[i].is_validation, keys[i].sample_key) for i, x in enumerate(rows))


def test_bad_indexes(spark, written, tmp_path):
    path, texts, _, keys = written
    body, entries = single(texts, keys)
    (tmp_path / "corpus").write_bytes(body)
    whole = P.parts_of(str(tmp_path / "corpus"))

    def read(data: bytes, corpus=whole):
        (tmp_path / "index").write_bytes(data)
        return P.read_indexed(spark, P.parts_of(str(tmp_path / "index")), corpus, 50).count()

    assert read(entries) == 257
    for bad in (entries[:-1], entries[:-17], entries + entries[:17]):
        with pytest.raises(InvalidFile):
            read(bad)
    for length in (0, -5, 2**31):
        with pytest.raises(Exception, match=f"a document of {length} bytes"):
            read(length.to_bytes(8, "little", signed=True) + entries[8:])
    (tmp_path / "none").write_bytes(b"")
    none = P.parts_of(str(tmp_path / "none"))
    assert P.read_indexed(spark, none, none).count() == 0
    with pytest.raises(InvalidFile):
        P.parts_of(str(tmp_path / "absent"))


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    path = tmp_path / "streams"
    rows = spark.range(0, 100, 1, 4)
    good = F.encode(F.col("id").cast("string"), "UTF-8")
    P.write_streams(rows.select(good.alias("a")), str(path))
    want = "".join(map(str, range(100))).encode()
    assert P._read(P.parts_of(str(path), "a"), 0, len(want)) == want
    bad = F.when(F.col("id") < 80, good).otherwise(F.raise_error(F.lit("dies")).cast("binary"))
    with pytest.raises(Exception, match="dies"):
        P.write_streams(rows.select(bad.alias("a")), str(path))
    assert os.listdir(tmp_path) == ["streams"]
    assert P._read(P.parts_of(str(path), "a"), 0, len(want)) == want
    # the last folder stays as .bak, and streams may be empty
    P.write_streams(rows.select(F.lit(None).cast("binary").alias("a")), str(path))
    assert P.parts_of(str(path), "a") == [] and sorted(os.listdir(tmp_path)) == ["streams", "streams.bak"]
    assert len(json.loads((tmp_path / "streams.bak" / "manifest.json").read_text())["streams"]["a"]) == 4
    with pytest.raises(Exception, match="out of range"):
        P.write_streams(spark.createDataFrame([([70000],)], "a array<int>"), str(tmp_path / "ids"))
    with pytest.raises(InvalidFile):
        P.parts_of(str(path), "b")


def test_token_documents(spark, tmp_path):
    r = random.Random(6)
    docs = [[r.randrange(300) for _ in range(r.choice([0, 1, 5, 40, 700]))] for _ in range(120)]
    docs = [[x if x != 256 else 9 for x in d] + [256] for d in docs]
    rows = spark.createDataFrame([(i, d, i % 10 == 0) for i, d in enumerate(docs)], "doc_id long, ids array<int>, v boolean").repartition(5)
    ordered = P.in_order(rows, "doc_id", ranges=4)
    P.write_streams(ordered.select(F.when(~F.col("v"), F.col("ids")).alias("train"), F.when(F.col("v"), F.col("ids")).alias("validation")), str(tmp_path / "tokens"))
    for stream, own in (("train", [d for i, d in enumerate(docs) if i % 10]), ("validation", docs[::10])):
        parts = P.parts_of(str(tmp_path / "tokens"), stream)
        assert P._read(parts, 0, P.total(parts)) == np.array(sum(own, []), "<u2").tobytes()
        for step in (999, 1 << 20):
            got = sorted(P.token_documents(spark, parts, 256, step).collect())
            assert [(x.doc_id, list(x.ids)) for x in got] == list(enumerate(own))
    few = [[256], [1, 2, 3, 256], [256], [7] * 9 + [256]]
    (tmp_path / "few").write_bytes(np.array(sum(few, []), "<u2").tobytes())
    for step in (2, 6):
        got = sorted(P.token_documents(spark, P.parts_of(str(tmp_path / "few")), 256, step).collect())
        assert [(x.doc_id, list(x.ids)) for x in got] == list(enumerate(few))
    for data in (b"\x01\x00\x02", b"\x01\x00", b"\x00\x01\x05\x00"):
        (tmp_path / "bad").write_bytes(data)
        with pytest.raises(InvalidFile):
            P.token_documents(spark, P.parts_of(str(tmp_path / "bad")), 256)


def test_tokens_of_three_gigabytes(spark, tmp_path):
    size, gap = 3 << 30, 3 << 20
    ends = [*range(gap, size, gap), size]
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(size)
        for end in ends:
            f.seek(end - 2)
            f.write((256).to_bytes(2, "little"))
    got = P.token_documents(spark, P.parts_of(str(tmp_path / "sparse")), 256, 64 << 20).select("doc_id", F.size("ids").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(i, (b - a) // 2) for i, (a, b) in enumerate(zip([0, *ends], ends))]
