"""Byte-level BPE, packing, sharding and exact search against libraries and brute force."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, packing, search, sharding


def odd_texts(n=120, seed=1):
    r = random.Random(seed)
    char = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), r.randrange(0x1F600, 0x1F650), 97, 98, 32, 10]))
    made = ["".join(char() for _ in range(r.randrange(60))) for _ in range(n)]
    return [None, "", " ", "\n\n  x", "'s don't", "ab" * 20000, "a" * 3000 + "é" * 500, "<|endoftext|> x", *made, made[0]]


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})


def test_rank_bitmap():
    bitmap, held, r = bpe.RankBitmap(70000), set(), random.Random(2)
    for _ in range(3000):
        rank = r.randrange(70000)
        if rank in held:
            held.remove(rank)
            bitmap.remove(rank)
        else:
            held.add(rank)
            bitmap.add(rank)
        assert bitmap.first() == min(held, default=-1)


def test_bpe_is_that_of_the_library(spark):
    texts, library = odd_texts(), tiktoken_encoding()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = {x.doc_id: x for x in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        assert list(out[i].ids) == library.encode_ordinary(t or "")
        assert bytes(out[i].decoded) == (t or "").encode()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(KeyError):
        bpe.load().decode([10**6])


def test_pieces_are_those_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts(40) + ["a <|endoftext|> b"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = collections.defaultdict(list)
    for x in packing.pieces(df, with_ids=True).collect():
        got[x.doc_id].append(x)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(got[i], key=lambda x: x.piece)
        assert [y for x in own for y in x.ids] == ids
        assert [x.piece for x in own] == list(range(len(own)))
        assert all(x.length == 1024 for x in own[1:]) and own[0].length <= 1024
        assert all(ids[x.start : x.start + x.length] == list(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in own)


def test_words_encode_as_in_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encode, ordinary = packing.Encoder(path), packing.Encoder(path, plain=True)
    library = tiktoken_encoding()
    r = random.Random(8)
    parts = [" ", "\n", "  ", "\t", "\x1c", "\x85", "\u3000", "a", "Bc", "'s", "é", "1", "23", "!", "😀", "<|endoftext|>", "'", "\u0300", "\x0b", "\u200b", "\xa0", ",", "."]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ordinary(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert bpe.load().encode(text).tolist() == library.encode_ordinary(text)


def test_configurations_are_the_fewest():
    # three of 3 and two of 5 fill ten alike; a 7 goes with a 3
    chosen = packing.configurations([7, 5, 3], [10, 6, 13], 10)
    assert sum(n for n, _ in chosen) == 14 and (10, [(0, 1), (2, 1)]) in chosen
    r = random.Random(5)
    for _ in range(20):
        sizes = sorted(r.sample(range(40, 120), 12), reverse=True)
        demand = [r.randrange(200, 400) for _ in sizes]
        chosen = packing.configurations(sizes, demand, 240)
        used = [sum(n * dict(held).get(k, 0) for n, held in chosen) for k in range(12)]
        assert all(u <= d for u, d in zip(used, demand)) and all(sum(sizes[k] * n for k, n in held) <= 240 for _, held in chosen)
        # no more than the bound by area and the rounding of twelve configurations allow
        left = sum(d - u for u, d in zip(used, demand))
        assert sum(n for n, _ in chosen) + left <= 1.06 * sum(s * d for s, d in zip(sizes, demand)) / 240 + 24


def held_lengths(classes):
    out = collections.Counter()
    for n, held in classes:
        for x in held:
            out[x] += n
    return out


def test_packing_holds_every_length():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 65): r.randrange(1, 9) for _ in range(r.randrange(20))}
        classes = packing.packed(counts, 64, [(r.choice([1, 3, 100]), r.choice([4, 8]))])
        assert held_lengths(classes) == collections.Counter(counts)
        assert all(n > 0 and sum(held) <= 64 for n, held in classes)
    with pytest.raises(ValueError):
        packing.packed({65: 1}, 64)


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [x for x in rooms if x >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_packing_needs_few_sequences():
    r = random.Random(4)
    for _ in range(3):
        counts = collections.Counter(min(1024, max(1, int(r.lognormvariate(6.2, 0.9)))) for _ in range(1500))
        n = sum(n for n, _ in packing.packed(counts))
        assert n <= best_fit(counts, 1024)


def test_places_are_gapless(spark):
    texts = odd_texts(60) + ["word " * 5000] * 3
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = packing.placed(packing.pieces(df, with_ids=True).withColumn("offset", F.lit("clash")))
    rows = made.collect()
    assert len(rows) == packing.pieces(df).count()
    by = collections.defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, list(x.ids)))
    for parts in by.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= 1024
    whole = {x.sequence_id: list(x.ids) for x in packing.sequences(made).collect()}
    assert whole == {k: [y for _, ids in sorted(v) for y in ids] for k, v in by.items()}
    assert packing.placed(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_shards(spark, tmp_path):
    rows = [(i % 40 if i % 9 else None, None if i % 11 == 0 else "text é " * (i % 30), i, "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, shard string")
    one = sharding.sharded(df, ["doc_id", "n"], 7)
    out = one.collect()
    assert sorted(x.n for x in out) == list(range(500))
    slots = collections.defaultdict(list)
    for x in out:
        slots[x.shard].append(x.slot)
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [x.n for x in sorted(out, key=lambda x: (x.slot, x.shard))] != list(range(500))
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, sharding.sharded(df, ["doc_id", "n"], 7).collect()), key=repr)
    sharding.write_shards(one, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and len(list((tmp_path / "out").glob("shard=*"))) == 7
    same = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    assert sorted(x.place for x in sharding.shuffled(same, ["doc_id"]).collect()) == list(range(50))
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], 3).collect() == []
    # the same places whatever the number of tasks
    want = sorted((x.n, x.place) for x in sharding.shuffled(df, ["doc_id", "n"], bucket_bytes=2000).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sharding.shuffled(df.repartition(9), ["doc_id", "n"], bucket_bytes=2000)
        assert sorted((x.n, x.place) for x in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fisher_yates(spark):
    rows = spark.range(12_000).select(sharding.fisher_yates(F.lit(4), 7, F.col("id")).alias("o")).collect()
    seen = collections.Counter(tuple(x.o) for x in rows)
    assert len(seen) == 24 and all(sorted(x) == [0, 1, 2, 3] for x in seen) and max(seen.values()) < 620 and min(seen.values()) > 380
    ones = spark.range(2).select(sharding.fisher_yates(F.lit(1), 7, F.col("id")).alias("o"), sharding.fisher_yates(F.lit(3000), 7, F.col("id")).alias("p")).collect()
    assert [list(x.o) for x in ones] == [[0], [0]] and all(sorted(x.p) == list(range(3000)) for x in ones) and ones[0].p != ones[1].p


def test_shuffle_is_uniform(spark):
    """Neighbours come apart, and places don't follow the order of the rows."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    place = {x.doc_id: x.place for x in sharding.shuffled(df, ["doc_id"], bucket_bytes=50_000).collect()}
    order = np.array([place[i] for i in range(4000)])
    assert sorted(order) == list(range(4000))
    assert abs(np.corrcoef(np.arange(4000), order)[0, 1]) < 0.06


def plain_top(rows, k=10):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = max(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_components_beyond_64_bits(spark):
    for x in (1e17, -1e17, 2.0**53):
        with pytest.raises(Exception, match="64 bits"):
            search.quantized(spark.createDataFrame([(1, [0.5, x])], "vec_id long, embedding array<double>")).collect()
    got = search.quantized(spark.createDataFrame([(1, [8e15, -0.5])], "vec_id long, embedding array<double>")).first()
    assert got.v == [8 * 10**15 * 1024, -512]


@pytest.mark.parametrize("seed", range(2))
def test_top_k_is_that_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "CANDIDATE_PART", 100)
    r = random.Random(seed)
    vector = lambda: [r.choice([r.gauss(0, 1), float(r.randrange(-2, 3)), 0.5]) for _ in range(6)]
    rows = [(i, vector()) for i in range(600)]
    for i in range(0, 200):
        rows[r.randrange(600)] = (r.randrange(600), rows[7][1])
    rows += [(None, vector()), (700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (800, [1.0, 2.0]), (705, [3e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    vectors = search.quantized(df)
    out = search.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
    assert sorted(tuple(x) for x in out.collect()) == plain_top(rows)


def test_top_k_of_few_rows(spark):
    vectors = search.quantized(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(x) for x in search.top_k(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    empty = vectors.where("vec_id > 5")
    assert search.top_k(empty, empty).collect() == []
    huge = search.quantized(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        search.top_k(huge, huge.where("vec_id = 0")).collect()
    # beyond what floats hold exactly, but not beyond 64 bits
    large = spark.createDataFrame([(0, [3 * 10**9 + 1, 7]), (1, [10**9 + 1, 5]), (2, [10**9 + 1, 6])], "vec_id long, v array<long>")
    got = search.top_k(large, large.where("vec_id = 0")).collect()
    assert [(x.vec_id, x.score) for x in got] == [(v, (3 * 10**9 + 1) * (10**9 + 1) + 7 * c) for v, c in ((2, 6), (1, 5))]


def test_rows_are_decoded_together():
    coder = bpe.load()
    texts = ["", "a b", "ü" * 50, "", "x1 y2\n" * 30]
    ids = [coder.encode(t) for t in texts]
    ends = np.cumsum([len(x) for x in ids])
    assert coder.decode_rows(np.concatenate(ids), ends) == [t.encode() for t in texts]
    assert coder.decode([]) == b"" and coder.decode_rows(np.zeros(0, np.int32), np.zeros(0, np.int64)) == []
    with pytest.raises(KeyError):
        coder.decode_rows(np.array([-1]), np.array([1]))
