"""Learning byte-pair merges: over all rows with counts that are kept, or on a bounded sample in one task.

Over all rows, documents are chunks of tokens, which travel as bytes. The pairs are counted once. After that a pass
replaces the pairs of some merges in the chunks, and what comes out of the tasks is only how the counts change around
the places that were replaced. Counts are never taken anew.

A pass takes as many merges as are known from the counts before it. In the order of the counts, the next pair is the
next merge as long as no merge of the pass shares a place with it: no merge ends with its first token, and none begins
with its second. Its own count is then unchanged. What a merge (a, b) newly makes, (x, ab) or (ab, y), occurs no more
often than (x, a) or (b, y) did, which come later in that order; and where it ties, the new token has the greater id,
so that it comes later too. After a pair of one token with itself a pass ends, since such pairs overlap themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import discard, small_batches, stored

#: Bytes of text in a chunk; a longer text is a chunk of its own. A chunk is a row, of which tasks hold several.
CHUNK = 256 << 10
#: Bytes of a row group of chunks.
GROUP = 16 << 20
#: Changes of pair counts that a task holds before it sums them.
PENDING = 1 << 19
#: Most merges of a pass.
BATCH = 256
_ROWS = "ids binary, weights binary, left int, right int, n long"
_NAMES = ["ids", "weights", "left", "right", "n"]


def _packed(ids: np.ndarray, size: int) -> bytes:
    """Ids below ``size``, and -1, in two bytes each, or four where two can't tell them apart."""
    return ids.astype("<u2" if size <= 0xFFFF else "<i4").tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    ids = np.frombuffer(data, "<u2" if size <= 0xFFFF else "<i4").astype(np.int32)
    if size <= 0xFFFF:
        ids[ids == 0xFFFF] = -1
    return ids


def _chunk_row(ids: np.ndarray, weights: np.ndarray, size: int):
    import pyarrow as pa

    none = pa.nulls(1, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([_packed(ids, size)], pa.binary()), pa.array([weights.astype("<i8").tobytes()], pa.binary()), none, none, pa.nulls(1, pa.int64())], _NAMES)


class _Changes:
    """Changes of pair counts, summed in a task."""

    def __init__(self):
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((left.astype(np.int64) << 32 | right, np.asarray(n, np.int64)))
        self.size += len(n)
        if self.size >= max(PENDING, len(self.keys)):
            self._sum()

    def _sum(self) -> None:
        every, place = np.unique(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, place, np.concatenate([self.sums, *(n for _, n in self.waiting)]))
        self.keys, self.sums = every, sums
        self.waiting, self.size = [], 0

    def rows(self):
        import pyarrow as pa

        self._sum()
        some = np.flatnonzero(self.sums)
        keys, none = self.keys[some], pa.nulls(len(some), pa.binary())
        return pa.RecordBatch.from_arrays([none, none, pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(self.sums[some])], _NAMES)


def _begun(batches: Iterator) -> Iterator:
    """Chunks of texts with their weights, and the counts of their pairs of bytes. -1 ends a text in a chunk."""
    changes, parts, weights, size = _Changes(), [], [], 0

    def chunk():
        ids, own = np.concatenate(parts), np.array(weights, np.int64)
        inside = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        texts = np.searchsorted(np.flatnonzero(ids < 0), inside)
        key = ids[inside] << 8 | ids[inside + 1]
        n = np.zeros(1 << 16, np.int64)
        np.add.at(n, key, own[texts])
        found = np.flatnonzero(n)
        changes.add(found >> 8, found & 255, n[found])
        return _chunk_row(ids, own, 256)

    for batch in batches:
        for text, weight in zip(batch.column(0), batch.column(1).to_pylist()):
            data = text.as_py()
            parts += [np.frombuffer(data, np.uint8).astype(np.int32), np.full(1, -1, np.int32)]
            weights.append(weight)
            size += len(data)
            if size >= CHUNK:
                yield chunk()
                parts, weights, size = [], [], 0
    if parts:
        yield chunk()
    yield changes.rows()


def replaced(ids: np.ndarray, weights: np.ndarray, merges: list[tuple[int, int]], first: int, changes: _Changes) -> np.ndarray:
    """``ids`` of a chunk with ``merges``, which share no places, replaced by ``first`` and the ids after it."""
    size = first + len(merges)
    keys = np.array([a * size + b for a, b in merges], np.int64)
    by = np.argsort(keys)
    begins = np.zeros(size + 1, bool)
    begins[[a for a, _ in merges]] = True
    at = np.flatnonzero(begins[ids[:-1]])
    key = ids[at].astype(np.int64) * size + ids[at + 1]
    place = np.minimum(np.searchsorted(keys[by], key), len(merges) - 1)
    hit = keys[by][place] == key
    at, which = at[hit], by[place[hit]]
    a, b = merges[-1]
    if a == b and len(at):
        # in a run of one token every second place begins a pair
        twin = np.flatnonzero(which == len(merges) - 1)
        own = at[twin]
        turn = np.arange(len(own))
        turn -= np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1] + 1), turn, 0)) if len(own) else 0
        keep = np.ones(len(at), bool)
        keep[twin[turn % 2 == 1]] = False
        at, which = at[keep], which[keep]
    if not len(at):
        return ids
    weight = weights[np.searchsorted(np.flatnonzero(ids < 0), at)]

    def around(ids: np.ndarray, places: list[np.ndarray], sign: int) -> None:
        """The pairs that begin at ``places``, each of them once."""
        p, one = np.unique(np.concatenate(places), return_index=True)
        good = (p >= 0) & (p < len(ids) - 1)
        p, one = p[good], one[good]
        good = (ids[p] >= 0) & (ids[p + 1] >= 0)
        p, one = p[good], one[good]
        changes.add(ids[p], ids[p + 1], sign * weight[one % len(weight)])

    around(ids, [at - 1, at, at + 1], -1)
    out = ids.copy()
    out[at] = first + which
    out = np.delete(out, at + 1)
    now = at - np.arange(len(at))
    around(out, [now - 1, now], 1)
    return out


def _applied(merges: list[tuple[int, int]], first: int):
    def run(batches: Iterator) -> Iterator:
        changes = _Changes()
        for batch in batches:
            for ids, weights in zip(batch.column(0), batch.column(1)):
                ids, weights = _unpacked(ids.as_py(), first), np.frombuffer(weights.as_py(), "<i8")
                yield _chunk_row(replaced(ids, weights, merges, first, changes), weights, first + len(merges))
        yield changes.rows()

    return run


def known_merges(ranked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The merges that are certain: a prefix of ``ranked``, (left, right, count) in the order of merging."""
    out, begins, ends = [], set(), set()
    for a, b, n in ranked:
        if n < 2 or a in ends or b in begins:
            break
        out.append((a, b, n))
        begins.add(a)
        ends.add(b)
        if a == b:
            break
    return out


def train_by_passes(texts: DataFrame, merges: int, text_col: str = "text", framed: bool = False) -> list[tuple[int, int, int]]:
    """(left, right, count) of each merge, learnt from all rows; with ``framed`` from texts with their newlines.

    Ties go to the least pair. It stops early when no pair occurs twice. Equal texts are kept once, with their number as
    weight; null texts count for nothing. Besides the merges, only the leading pairs of a pass reach the driver.
    """
    text = F.concat(F.col(text_col).cast("string"), F.lit("\n")) if framed else F.col(text_col).cast("string")
    rows = texts.select(text.cast("binary").alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    # a table holds the chunks after a pass, and how the pass changed the counts
    small_batches(texts.sparkSession)
    table = stored(rows.mapInArrow(_begun, _ROWS), GROUP)
    counts, out = None, []
    while len(out) < merges:
        changes = table.select("left", "right", "n").where("left IS NOT NULL")
        new = stored((changes if counts is None else counts.unionByName(changes)).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
        discard(*([] if counts is None else [counts]))
        counts = new
        ranked = counts.orderBy(F.desc("n"), "left", "right").limit(BATCH).collect()
        batch = known_merges([tuple(x) for x in ranked])[: merges - len(out)]
        if not batch:
            break
        first = 256 + len(out)
        out += batch
        if len(out) < merges:
            new = stored(table.where("ids IS NOT NULL").select("ids", "weights").mapInArrow(_applied([(a, b) for a, b, _ in batch], first), _ROWS), GROUP)
            discard(table)
            table = new
    discard(table, *([] if counts is None else [counts]))
    return out


def train(documents: list[bytes], merges: int, progress=None) -> list[tuple[int, int]]:
    """Merges of a sample that fits in memory; pair counts are kept up to date around each merge."""
    after, before, token, at = [], [], [], 0
    for text in documents:
        for k, b in enumerate(text):
            token.append(b)
            before.append(at - 1 if k else -1)
            after.append(at + 1 if k + 1 < len(text) else -1)
            at += 1
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, right in enumerate(after):
        if right >= 0:
            where[token[i], token[right]].add(i)
    heap = [(-len(sites), pair) for pair, sites in where.items()]
    heapify(heap)
    out: list[tuple[int, int]] = []
    while heap and len(out) < merges:
        n, pair = heappop(heap)
        sites = where.get(pair, ())
        if -n != len(sites):
            if sites:
                heappush(heap, (-len(sites), pair))
            continue
        if len(sites) < 2:
            break
        new, changed = 256 + len(out), set()
        for i in sorted(where.pop(pair)):
            right = after[i]
            if right < 0 or (token[i], token[right]) != pair:
                continue
            left, far = before[i], after[right]
            for x, y in ((left, i), (right, far)):
                if x >= 0 and y >= 0:
                    where[token[x], token[y]].discard(x)
                    changed.add((token[x], token[y]))
            token[i], token[right], after[i] = new, -1, far
            if far >= 0:
                before[far] = i
                where[new, token[far]].add(i)
                changed.add((new, token[far]))
            if left >= 0:
                where[token[left], new].add(left)
                changed.add((token[left], new))
        out.append(pair)
        for x in changed:
            if x != pair and where.get(x):
                heappush(heap, (-len(where[x]), x))
        if progress:
            progress(len(out), merges)
    return out


def train_sample(sample: DataFrame, merges: int, text_col: str = "text") -> list[tuple[int, int]]:
    """Merges of the rows of ``sample``, each with its newline, learnt by one task on the executors.

    The sample must fit in one task; ``tokenizer_sample`` bounds its bytes.
    """

    def run(table):
        import pyarrow as pa

        found = train([(text + "\n").encode() for text in table["_text"].to_pylist()], merges)
        return pa.table({"rank": pa.array(range(len(found)), pa.int32()), "left": pa.array([x for x, _ in found], pa.int32()), "right": pa.array([y for _, y in found], pa.int32())})

    rows = sample.select(F.col(text_col).alias("_text"), F.lit(1).alias("_one")).groupBy("_one").applyInArrow(run, "rank int, left int, right int").collect()
    return [(row.left, row.right) for row in sorted(rows)]
