"""Near duplicates and repeated text against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import minhash, run_index, suffix_dedup
from corpusloom.llm.components import components


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def weights_of(text):
    words = text.lower().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}


def weighted(docs):
    """Every text's shingles with the weights that the definition gives, by counting documents."""
    counts = [weights_of(x or "") for x in docs]
    frequency = collections.Counter(shingle for own in counts for shingle in own)

    def idf(shingle):
        grade = round(255 * np.log(frequency[shingle]) / np.log(len(docs)))
        return 1 - (1 - minhash.COMMON) / 255 * grade

    return [{k: (1 + np.log(n)) * idf(k) for k, n in own.items()} for own in counts]


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    least = sum(min(a.get(k, 0), b.get(k, 0)) for k in a)
    return least / (sum(a.values()) + sum(b.values()) - least)


def corpus(seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [text(r.randrange(20, 200)) for _ in range(60)]
    for base in docs[:15]:
        words = base.split()
        for _ in range(r.randrange(1, 5)):
            copy = list(words)
            for _ in range(max(1, len(copy) // 100)):
                copy[r.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
    shared = text(30)
    docs += [shared + " " + text(12) for _ in range(25)]
    return docs + [docs[3], docs[3], docs[70]]


def test_similarity_and_samples_agree():
    docs = corpus()
    doc, h, n = minhash.shingles(docs)
    counts = np.zeros((minhash.DEPTH, 1 << minhash.WIDTH_BITS), np.int64)
    for row in range(minhash.DEPTH):
        np.add.at(counts[row], minhash._places(h, row), 1)
    known = minhash.graded(counts, len(docs))
    weight = known.weights(h, n)
    assert known.least == 1 and len(np.unique(known.idf(h))) > 5
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    sets = [(h[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
    plain = weighted(docs)
    drawn = minhash.samples(doc, h, weight, len(docs))
    off = []
    for a in range(0, len(docs), 3):
        for b in range(a):
            sim = minhash.similarity(sets[a], sets[b])
            assert sim == pytest.approx(plain_similarity(plain[a], plain[b]), abs=2e-3)  # a few shingles share all places
            off.append((drawn[a] == drawn[b]).mean() - sim)
            assert abs(off[-1]) < 0.3  # a share of 56 draws
    assert abs(np.mean(off)) < 0.01


def test_a_sketch_keeps_common_shingles_apart_from_chance():
    """With many shingles to a place, those in a tenth of the documents have the grade that counting gives."""
    r = np.random.RandomState(3)
    documents, width = 20000, 1 << minhash.WIDTH_BITS
    common = r.randint(0, 1 << minhash.HASH_BITS, 50).astype(np.uint64)
    counts = np.stack([r.poisson(60, width) for _ in range(minhash.DEPTH)])
    for row in range(minhash.DEPTH):
        np.add.at(counts[row], minhash._places(common, row), documents // 10)
    known = minhash.graded(counts, documents)
    want = 1 - (1 - minhash.COMMON) * np.log(documents / 10 / known.least) / np.log(documents / known.least)
    assert np.abs(known.idf(common) - want).max() < 0.01
    rare = r.randint(0, 1 << minhash.HASH_BITS, 5000).astype(np.uint64)
    assert (known.idf(rare) == 1).mean() > 0.99


def test_samples_follow_the_weights():
    """Of equal shingles with other weights, the share of equal samples is the weighted similarity."""
    h = np.sort(np.random.RandomState(0).randint(1, 2**minhash.HASH_BITS, 400).astype(np.uint64))
    one, two = np.ones(400, np.float32), np.full(400, 2.0, np.float32)
    pick = lambda w: minhash.samples(np.zeros(400, np.int64), h, w, 1)
    shares = []
    for seed in range(6):
        shares.append(np.mean(minhash.samples(np.zeros(400, np.int64), h, one, 1, seed) == minhash.samples(np.zeros(400, np.int64), h, two, 1, seed)))
    assert abs(np.mean(shares) - 0.5) < 0.12
    assert (pick(one) == pick(one)).all()


def classes_of(docs, threshold=0.8):
    """The least place of each text's class, by checking all pairs."""
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, words = weighted(docs), [(x or "").lower().split() for x in docs]
    for a in range(len(docs)):
        for b in range(a):
            if words[a] == words[b] or plain_similarity(sets[a], sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(docs))]


def edited(seed=7):
    """Large groups of copies whose similarities lie around the threshold, and chains of copies of copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    out = []
    for size, most in ((120, 6), (60, 9)):
        base = [word() for _ in range(100)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(most + 1)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = [word()]
            out.append(" ".join(copy))
    for _ in range(10):
        copy = [word() for _ in range(60)]
        for _ in range(6):
            copy[r.randrange(60)] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("docs", [corpus() + [None, "", "  ", "one two", "one  TWO", "long " * 30000], edited()])
def test_classes_are_those_of_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, class_id int")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}
    want = classes_of(docs)
    assert got == dict(enumerate(want))
    assert 3 < len(set(want)) < len(docs)


def test_rows_with_one_id_or_none_are_judged_apart(spark):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, b), (9, b + " tail"), (7, c), (None, d), (None, d + " end"), (None, text())]
    df = spark.createDataFrame([(*x, i, "f") for i, x in enumerate(rows)], "doc_id long, text string, row int, file string")
    found = minhash.near_duplicates(df).collect()
    assert sorted((x.doc_id, x.class_id) for x in found if x.doc_id) == [(5, 5), (5, 5), (7, 7), (9, 5)]
    assert len({x.class_number for x in found}) == 5
    kept = minhash.representatives(df)
    assert kept.columns == df.columns
    first = sorted(x.row for x in kept.collect())
    # of rows without ids a digest of all columns decides
    assert first in ([0, 1, 3, 4, 6], [0, 1, 3, 5, 6])
    for parts in (1, 2, 5):
        assert sorted(x.row for x in minhash.representatives(df.orderBy(F.rand(parts)).repartition(parts)).collect()) == first
    assert minhash.representatives(df.where("false")).collect() == []


def test_links_hold_their_texts_together(spark):
    docs = edited(9)
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    found = minhash.linked(minhash.located(df, "id", "text"))
    sims = [x.sim for x in found.links.collect()]
    assert sims and min(sims) >= 0.8
    assert found.rows.count() == len(docs) and found.nodes.count() == len(set(docs))


def test_crowded_buckets_are_exact(spark):
    """Copies of a text, each with its own edits, that mostly aren't near to each other."""
    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for k in range(r.choice([1, 2, 4, 6])):
            words[r.randrange(120)] = f"x{i}_{k}"
        docs.append(" ".join(words))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    want = classes_of(docs)
    assert got == dict(enumerate(want)) and 5 < len(set(want)) < 55


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (None, "a b c d e f g"), (None, "other words stand here now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((x.doc_id, x.class_id) for x in minhash.near_duplicates(df).collect())
    assert got == collections.Counter([(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (None, None)])
    kept = minhash.representatives(df).collect()
    assert len(kept) == 3 and sum(x.doc_id == 1 for x in kept) == 1


def test_match_lengths():
    r = random.Random(2)
    for _ in range(150):
        n, letters = r.randrange(0, 50), r.choice([1, 2, 3, 200])
        text = np.array([r.randrange(letters) for _ in range(n)], np.uint8)
        b = text.tobytes()

        def common(i, j):
            k = 0
            while max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert run_index.match_lengths(text).tolist() == want
        index = run_index.RunIndex(text)
        assert index.text().tolist() == text.tolist()
        assert n < 2 or index.matches(n // 2, n).tolist() == want[n // 2 :]


def test_an_index_of_copies_has_few_runs():
    r = random.Random(6)
    base = [r.randrange(97, 123) for _ in range(2000)]
    copies = []
    for _ in range(30):
        copies += [*base, 255]
        base[r.randrange(2000)] = r.randrange(97, 123)
    index = run_index.RunIndex(np.array(copies, np.uint8))
    assert len(index.symbols) < 2 * 2000 + 30 * 40 and index.lengths.sum() == len(copies) + 1
    assert len(index.above[0]) <= len(index.symbols) + 1


def plain_removal(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(45)
    docs = [text(r.randrange(1, 150)) for _ in range(30)]
    docs += [text(20) + passage + text(r.randrange(30)) for _ in range(8)]
    docs += [line + "\n" + text(30) for _ in range(12)] + [line, line, docs[2]]
    docs += ["abcde" * 300, "xy" * 250, text(60) + " again " + passage[:250] + passage[:250], "z" * 199, "z" * 200, "q" * 201, "0" * 5000]
    return [*docs, None, ""]


@pytest.mark.parametrize("crowd", [4096, 2])
def test_removal_is_that_of_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = repeated_texts()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, row int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.without_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal([(t or "").encode() for t in texts], 200)


def test_long_texts_are_cut_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PART", 1000)
    r = random.Random(6)
    text = bytes(r.randrange(97, 101) for _ in range(7000))
    seen = []
    for group in suffix_dedup._parts(np.array([0, len(text)]), 200):
        own = np.concatenate([np.frombuffer(text[a:b], np.uint8) for _, a, b in group])
        sizes = np.array([b - a for _, a, b in group])
        _, part, start, end, _ = suffix_dedup.segments(own, sizes)
        shift = np.array([a for _, a, _ in group])[part] - (np.cumsum(sizes) - sizes)[part]
        seen += [p for s, e in zip(start + shift, end + shift) for p in range(s, e - 199)]
    assert sorted(seen) == list(range(len(text) - 199))


def test_removal_of_odd_rows(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "é" * 3 + "".join(chr(97 + i * i % 23) + str(i) for i in range(80))
    rows = [(None, text), (None, text), (1, None)]
    out = suffix_dedup.trimmed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(5)))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted((x.doc_id or 0, x.text or "", x.kept) for x in out.collect()) == [(0, "", 5), (0, "", 5), (1, "", 5)]
