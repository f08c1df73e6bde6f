"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, bands, and exact checks.

A document is a weighted set of shingles, runs of five words. Its samples come from improved consistent
weighted sampling: each sample is a shingle with a quantised weight, and two documents share a sample with
the probability of their weighted Jaccard similarity. Samples make bands; documents that share a band are
candidates. What they come to is decided by the weighted Jaccard similarity of their whole shingle sets.

Equal texts are one node from the start, whatever their ids. In each band's bucket every node is held against
one of them, its head: the one that shares most buckets with others. That is linear in the bucket. A node that
doesn't end up in its head's class is held against the head's other nodes, where these bounds leave out only
what can't be similar. One minus the similarity is a metric, so the distances of both to the head may not
differ by more than the threshold allows. And what two nodes have in common lies in the head, where neither
has more of it than it shares with the head, or outside, where it is also in a second node. So every pair that
shares a bucket is either checked, in one class by way of others, or shown to be apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_groups, kept_in_worker, located, materialize, mix, small_batches, text_bytes, word_hashes
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Bits of a shingle's hash; the others number the texts of a batch while shingles are sorted.
HASH_BITS = 52
#: Rows of the table of random draws. A shingle's hash picks its row; of shingles that share one, the least
#: hash stands for all, in every document alike, so shares of equal samples stay those of similarities.
DRAW_BITS = 16
#: A count-min sketch holds the document frequencies: rows, and bits of a row's places.
DEPTH, WIDTH_BITS = 3, 17
#: Counters in a row of the table that sums the sketch.
_SLICE = 64
#: The IDF of a shingle falls with the logarithm of its document frequency: from 1, in one document, to COMMON,
#: in all of them. A steeper one would push the copies of a large group apart: what they share is common, and
#: what sets them apart is rare.
COMMON = 0.8
_CHUNK = 1 << 12


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, hash and count of each distinct shingle, by text and hash; up to 4,096 texts.

    Words are lower-cased. A text of fewer than WORDS words is one shingle, without words it has none.
    """
    import pyarrow as pa

    data, offsets = text_bytes(pa.array([text.lower() for text in texts], pa.large_string()))
    words, _, _, at = word_hashes(data, offsets)
    n, m = np.diff(at), len(words)
    power = np.uint64(0x9E3779B97F4A7C55)
    h = np.zeros(max(m - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        h = h * power + words[k : k + len(h)]
    # a place starts a shingle if its text has four more words
    ends = np.repeat(at[1:], n)[: len(h)] if m else at[:0]
    whole = np.flatnonzero(np.arange(len(h)) + WORDS <= ends)
    doc, h = np.repeat(np.arange(len(texts), dtype=np.uint64), n)[whole], h[whole]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        less = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            some = n[short] > k
            less[some] = less[some] * power + words[at[short[some]] + k]
        doc, h = np.append(doc, short.astype(np.uint64)), np.append(h, less)
    bits = np.uint64(HASH_BITS)
    key = doc << bits | mix(h) >> (np.uint64(64) - bits)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found = key[first]
    return (found >> bits).astype(np.int64), found & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(first, len(key)))


def _places(h: np.ndarray, row: int) -> np.ndarray:
    """The place of each hash in a row of the sketch."""
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[row]
    return (h * np.uint64(odd) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Frequencies:
    """The IDF of shingles, from a count-min sketch of how many documents hold each.

    ``grades`` has DEPTH rows of bytes; a shingle's grade is the least of its places'. Grade 0 is the IDF 1,
    grade 255 COMMON, evenly between. A place counts its shingle's documents and those of others that fall on
    it; the mean of the latter is taken off, and what stays below four of their standard deviations (``least``
    documents) has grade 0. In small corpora hardly any places are shared, and frequencies are exact; with s
    shingles to a document, ``least`` is a share of 4 * sqrt(s / (documents * 2**WIDTH_BITS)) of them, so that
    grades come closer to the true ones as a corpus grows.
    """

    grades: np.ndarray
    least: float

    def idf(self, h: np.ndarray) -> np.ndarray:
        grade = self.grades[0][_places(h, 0)]
        for row in range(1, DEPTH):
            grade = np.minimum(grade, self.grades[row][_places(h, row)])
        return (1 - (1 - COMMON) / 255 * grade).astype(np.float32)

    def weights(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        """TF-IDF: one plus the logarithm of the count, times the IDF."""
        out = self.idf(h)
        many = np.flatnonzero(count > 1)
        out[many] *= (1 + np.log(count[many])).astype(np.float32)
        return out


def graded(counts: np.ndarray, documents: int) -> Frequencies:
    """The grades of a sketch with ``counts`` of shape (DEPTH, 2**WIDTH_BITS)."""
    chance = np.median(counts, axis=1, keepdims=True)
    least = float(1 + 4 * np.sqrt(chance.max(initial=0)))
    if documents <= least:
        return Frequencies(np.zeros(counts.shape, np.uint8), least)
    share = np.log(np.clip((counts - chance) / least, 1, None)) / np.log(documents / least)
    return Frequencies(np.rint(255 * np.clip(share, 0, 1)).astype(np.uint8), least)


def frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """How common shingles are among all rows. Tasks count, and sums of a fixed size reach the driver."""
    width = 1 << WIDTH_BITS
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept_in_worker(("minhash",), dict)
        counts, seen = np.zeros((DEPTH, width), np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for _, texts in in_groups([text or "" for text in batch.column(0).to_pylist()]):
                _, h, _ = shingles(texts)
                for row in range(DEPTH):
                    counts[row] += np.bincount(_places(h, row), minlength=width)
        if seen:
            rows = counts.reshape(-1, _SLICE)
            some = np.flatnonzero(rows.any(axis=1))
            head = np.zeros((1, _SLICE), np.int64)
            head[0, 0] = seen
            rows, at = np.concatenate([rows[some], head]), np.append(some, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(_SLICE))], names)

    names = ["slice", *(f"c{i}" for i in range(_SLICE))]
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    counts, documents = np.zeros((DEPTH * width // _SLICE, _SLICE), np.int64), 0
    for row in rows.groupBy("slice").agg(*(F.sum(c).alias(c) for c in names[1:])).collect():
        if row["slice"] < 0:
            documents = row["c0"]
        else:
            counts[row["slice"]] = row[1:]
    return graded(counts.reshape(DEPTH, width), documents)


def _draws(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kept_in_worker(("minhash", samples, seed), lambda: _drawn(samples, seed))


def _drawn(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta, and at weight 1 the keys, by row of the table and sample.

    Keys are integers in the order of the floats they stand for, above the number of their row.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    shape = (1 << DRAW_BITS, samples)
    # the sum of two exponentials is Gamma(2, 1)
    r, c = (sum(random.standard_exponential(shape, np.float32) for _ in range(2)) for _ in range(2))
    beta = random.random(shape, np.float32)
    return r, beta, _ordered(np.log(c) + r * beta - r, np.arange(1 << DRAW_BITS, dtype=np.uint64))


def _ordered(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    bits = key.view(np.uint32)
    sign = bits >> np.uint32(31) == 1
    return np.where(sign, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(DRAW_BITS) | row[:, None]


def _floats(key: np.ndarray) -> np.ndarray:
    bits = (key >> np.uint64(DRAW_BITS)).astype(np.uint32)
    return np.where(bits >> np.uint32(31) == 1, bits & np.uint32(0x7FFFFFFF), ~bits).view(np.float32)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, seed: int = 4) -> np.ndarray:
    """The samples of each text, as hashes of shingle and quantised weight; ``docs`` rows, 0 without shingles.

    With r, c ~ Gamma(2, 1) and beta uniform, a shingle of weight w has t = floor(ln w / r + beta) and the key
    ln c - r * (t - beta + 1); the least key wins. At weight 1, t is 0, and the key comes from the table.
    """
    k = BANDS * ROWS
    r, beta, base = _draws(k, seed)
    out = np.zeros((docs, k), np.uint64)
    if not len(h):
        return out
    none = np.uint64(2**64 - 1)
    best = np.full((docs, k), none, np.uint64)
    row = (h >> np.uint64(HASH_BITS - DRAW_BITS)).astype(np.int64)
    log = np.log(weight)
    held = np.empty((min(len(h), _CHUNK), k), np.uint64)
    for lo in range(0, len(h), _CHUNK):
        own = row[lo : lo + _CHUNK]
        key = np.take(base, own, axis=0, out=held[: len(own)], mode="clip")
        odd = np.flatnonzero(log[lo : lo + _CHUNK])
        if len(odd):
            at = own[odd]
            t = np.floor(log[lo + odd][:, None] / r[at] + beta[at])
            key[odd] = _ordered(_floats(key[odd]) - r[at] * t, at.astype(np.uint64))
        near = doc[lo : lo + _CHUNK]
        starts = np.flatnonzero(np.diff(near, prepend=-1))
        least = np.minimum.reduceat(key, starts, axis=0)
        best[near[starts]] = np.minimum(best[near[starts]], least)
    # the first shingle of the row that won: hashes are in order, and so are their rows
    some = np.flatnonzero(best[:, 0] != none)
    won = (best[some] & np.uint64((1 << DRAW_BITS) - 1)).astype(np.int64)
    at = np.searchsorted(doc << DRAW_BITS | row, some[:, None] << DRAW_BITS | won)
    sample = np.broadcast_to(np.arange(k), at.shape)
    t = np.floor(log[at] / r[won, sample] + beta[won, sample]).astype(np.int64).astype(np.uint64)
    out[some] = mix(h[at] ^ (t * np.uint64(0xC2B2AE3D27D4EB4F)))
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """A key for each band of samples."""
    h = np.zeros((len(drawn), BANDS), np.uint64)
    h += np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C55) + drawn[:, k::ROWS][:, :BANDS])
    return h.view(np.int64)


def in_common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """What two sorted weighted sets have in common, and which members of ``b`` are not in ``a``."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, np.arange(len(b[0]))
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    return float(np.minimum(a[1][at[both]], b[1][both]).sum(dtype=np.float64)), np.flatnonzero(~both)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets; 0 if one is empty."""
    both, _ = in_common(a, b)
    return both / (_whole(a) + _whole(b) - both) if both else 0.0


def _whole(x: tuple[np.ndarray, np.ndarray]) -> float:
    return float(x[1].sum(dtype=np.float64))


def weighted_sets(texts: list[str], known: Frequencies) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted shingles of each text with their weights."""
    for _, group in in_groups(texts):
        doc, h, count = shingles(group)
        weight = known.weights(h, count)
        at = np.searchsorted(doc, np.arange(len(group) + 1))
        for i, j in zip(at[:-1], at[1:]):
            yield h[i:j], weight[i:j]


def _signed(own: DataFrame, known: Frequencies) -> DataFrame:
    """file, row, id, ``key`` (of the sequence of words) and ``bands`` of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = [text or "" for text in batch.column(3).to_pylist()]
            keys, some = np.zeros((len(texts), BANDS), np.int64), np.zeros(len(texts), bool)
            for begin, group in in_groups(texts):
                doc, h, count = shingles(group)
                keys[begin : begin + len(group)] = bands(samples(doc, h, known.weights(h, count), len(group)))
                some[begin + doc] = True
            words = [xxhash.xxh3_128_digest(b" ".join(text.lower().encode().split())) for text in texts]
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary()), pa.ListArray.from_arrays(offsets, keys[some].ravel())], schema.names)

    schema = T.StructType([*(own.schema[c] for c in ("file", "row", "id")), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return own.select("file", "row", "id", "text").mapInArrow(run, schema)


def _side_by_side(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a``, ``b`` and their texts; ``texts`` has node and text."""
    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")


def _sets_of(batch, known: Frequencies) -> tuple[list[int], list[int], dict]:
    """a, b and the weighted set of each node of a batch of rows from ``_side_by_side``."""
    a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    texts = dict(zip(a, batch.column(2).to_pylist()))
    texts.update(zip(b, batch.column(3).to_pylist()))
    return a, b, dict(zip(texts, weighted_sets([text or "" for text in texts.values()], known)))


def _checked(pairs: DataFrame, texts: DataFrame, known: Frequencies) -> DataFrame:
    """``a``, ``b``, ``sim``, ``both`` (weight in common), and ``whole``, the weight of b, of each pair of nodes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept_in_worker(("minhash",), dict)
        for batch in batches:
            a, b, sets = _sets_of(batch, known)
            weight = {x: _whole(own) for x, own in sets.items()}
            both = np.array([in_common(sets[x], sets[y])[0] for x, y in zip(a, b)], float)
            left, right = (np.array([weight[x] for x in side], float) for side in (a, b))
            sim = both / np.where(both > 0, left + right - both, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x) for x in (sim, both, right))], ["a", "b", "sim", "both", "whole"])

    return _side_by_side(pairs, texts).mapInArrow(run, "a long, b long, sim double, both double, whole double")


def _alone(pairs: DataFrame, texts: DataFrame, known: Frequencies) -> DataFrame:
    """``a``, ``b``, ``alone``: the weight of those shingles of b that neither a nor another partner of a has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept_in_worker(("minhash",), dict)
        for batch in batches:
            a, b, sets = _sets_of(batch, known)
            for x, y in zip(a, b):
                own = sets[y]
                _, out = in_common(sets[x], own)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), x)), pa.array(np.full(len(out), y)), pa.array(own[0][out].view(np.int64)), pa.array(own[1][out])], ["a", "b", "token", "weight"])

    rows = _side_by_side(pairs, texts).mapInArrow(run, "a long, b long, token long, weight float")
    single = rows.groupBy("a", "token").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"), F.min("weight").alias("weight")).where("n = 1")
    return single.groupBy("a", "b").agg(F.sum(F.col("weight").cast("double")).alias("alone"))


@dataclass(frozen=True)
class NearDuplicates:
    """``rows``: file, row, id, class_number and class_id of every row. ``links``: a, b, sim of distinct texts.

    A class is a component of links. class_number tells classes apart; class_id is the least id in the class,
    null if it has none. The links are those that were checked: between the central text of a bucket and others
    in it, and such others as make classes meet; a and b are nodes, as are the ``nodes`` by key.
    """

    rows: DataFrame
    links: DataFrame
    nodes: DataFrame


def linked(own: DataFrame, threshold: float = SIMILARITY) -> NearDuplicates:
    """Near duplicates among the rows of ``own``, which has file, row, id and text, as ``located`` gives them."""
    small_batches(own.sparkSession)
    own = own.select("file", "row", "id", F.col("text").cast("string").alias("text"))
    known = frequencies(own)
    signed = materialize(_signed(own, known))
    # one node for each sequence of words; its number holds from here on, since it is written
    nodes = signed.groupBy("key").agg(F.min("id").alias("least_id"), F.min(F.struct("file", "row")).alias("place"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    held = nodes.select("node", F.explode("bands").alias("band"))
    buckets = held.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(held.join(buckets, "band"))
    central = shared.join(shared.groupBy("node").agg(F.sum("n").alias("near")), "node")
    heads = central.groupBy("band").agg(F.min(F.struct((-F.col("near")).alias("near"), "node"))["node"].alias("a"))
    pairs = materialize(shared.join(heads, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    asked = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("place.*", "node")
    # both sides grow with the input, so neither is broadcast
    texts = materialize(own.select("file", "row", "text").join(asked.hint("merge"), ["file", "row"]).select("node", "text"))
    discard(shared)
    sims = materialize(_checked(pairs, texts, known))
    links = sims.where(F.col("sim") >= threshold).select("a", "b", "sim")
    labels = components(links)
    own_label = labels.select(F.col("node").alias("b"), "label")
    head_label = labels.select(F.col("node").alias("a"), F.col("label").alias("head_label"))
    placed = sims.join(own_label, "b", "left").join(head_label, "a", "left")
    placed = placed.select("a", "b", "sim", "both", "whole", F.coalesce("label", "b").alias("label"), F.coalesce("head_label", "a").alias("head_label"))
    placed = materialize(placed)
    apart = F.col("label") != F.col("head_label")
    open_ = placed.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(apart).alias("apart")).where("n > 1 AND apart > 0").select("a")
    left = materialize(placed.join(open_, "a", "left_semi"))
    if not left.isEmpty():
        least = threshold - 1e-6
        left = left.join(_alone(left, texts, known), ["a", "b"], "left").withColumn("out", F.col("whole") - F.col("both") - F.coalesce("alone", F.lit(0.0)))
        # a node needs this much in common with any that it links to
        rows = materialize(left.where(F.col("both") + F.col("out") >= least * F.col("whole")))
        side = lambda df, x: df.select("a", *(F.col(c).alias(f"{x}_{c}") for c in ("b", "label", "head_label", "sim", "both", "out", "whole")))
        met = side(rows.where(apart), "x").join(side(rows, "y"), "a")
        enough = F.least("x_both", "y_both") + F.least("x_out", "y_out") >= least / (1 + least) * (F.col("x_whole") + F.col("y_whole"))
        close = (F.col("x_label") != F.col("y_label")) & (F.abs(F.col("x_sim") - F.col("y_sim")) <= 1 - least)
        # once where both are apart from the head
        once = (F.col("x_b") < F.col("y_b")) | (F.col("y_label") == F.col("y_head_label"))
        met = met.where(close & enough & once).select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()
        found = materialize(_checked(met, texts, known).where(F.col("sim") >= threshold).select("a", "b", "sim"))
        discard(rows)
        before = labels
        labels = components(before.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found.select("a", "b")))
        discard(before)
        links = links.union(found)
    discard(pairs, texts, placed, left)
    named = nodes.select("key", "node", "least_id").join(labels, "node", "left").withColumn("class_number", F.coalesce("label", "node"))
    classes = named.groupBy("class_number").agg(F.min("least_id").alias("class_id"))
    named = named.select("key", "class_number").join(classes, "class_number")
    rows = signed.select("file", "row", "id", "key").join(named, "key").select("file", "row", "id", "class_number", "class_id")
    return NearDuplicates(rows, links, nodes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``id_col``, ``class_id`` (the least id of its class) and ``class_number`` (of the class) of every row.

    Classes are the components of the links between texts whose weighted Jaccard similarity is at least
    ``threshold``. Texts with the same words in the same order are one class whatever their length, those
    without words (null, empty, blank) among them. Rows are judged one by one: ids may repeat, and rows with
    one id may be in several classes. A class of rows without ids has the class_id null, but a class_number
    of its own. Other columns are ignored. An empty table gives an empty result.
    """
    found = linked(located(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold).rows
    return found.select(F.col("id").alias(id_col), "class_id", "class_number")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, and among equals that of the least digest.

    Rows without an id come after all others. The digest is of all columns, so that the choice doesn't depend on
    where rows are stored; rows equal in all columns are interchangeable. Different rows that share an id are told
    apart.
    """
    held = located(docs, F.struct(*(F.col(c) for c in docs.columns)).alias("own"))
    digest = F.xxhash64(F.to_json("own", {"ignoreNullFields": "false"}))
    order = F.struct(F.col("own")[id_col].isNull().alias("none"), F.col("own")[id_col].alias("id"), digest.alias("digest"))
    rows = linked(held.select("file", "row", order.alias("id"), F.col("own")[text_col].alias("text")), threshold).rows
    kept = rows.groupBy("class_number").agg(F.min(F.struct("id", "file", "row")).alias("first")).select("first.file", "first.row")
    return held.join(kept, ["file", "row"], "left_semi").select(*(F.col("own")[c].alias(c) for c in docs.columns))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The class of every document."""
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
