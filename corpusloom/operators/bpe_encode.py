"""Encoding with a vocabulary of any size: merges of bytes, applied in the order in which they were learnt.

A batch of texts is one array of tokens in which no pair crosses the end of a text. The merges are swept once, in
rising order. A merge's places wait in a bucket; taking a bucket replaces all of them at once, and the pairs that
this makes have later merges, since they hold a newer token. So the work follows the replacements, not the number
of merges, and every step is over whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.shared import small_batches

#: Bytes of text that are swept at once; a longer text is swept alone.
SWEPT = 1 << 20
#: Bytes that fill a task.
SPLIT = 128 << 20


class Merges:
    """Encoder for ``merges``, pairs of ids: 0 to 255 are bytes, merge k makes the id 256 + k."""

    def __init__(self, merges: Sequence[tuple[int, int]]):
        self.pairs = [(int(a), int(b)) for a, b in merges]
        for k, pair in enumerate(self.pairs):
            if not all(0 <= x < 256 + k for x in pair):
                raise ValueError(f"merge {k} names an unknown id")
        self.size = np.int64(256 + len(self.pairs))
        keys = np.array([a * int(self.size) + b for a, b in self.pairs], np.int64)
        # of a pair that is listed twice the first merge counts
        self.keys, self.ranks = np.unique(keys, return_index=True) if len(keys) else (keys, keys)
        self.from_byte = np.full(1 << 16, -1, np.int64)
        for rank, (a, b) in reversed(list(enumerate(self.pairs))):
            if a < 256 and b < 256:
                self.from_byte[a << 8 | b] = rank

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts, and where those of each text end; ``ends`` says where their bytes do."""
        n = len(data)
        token = np.append(data.astype(np.int64), -1)
        if n > 1 and self.pairs:
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            cut = np.unique(ends[(ends > 0) & (ends < n)])
            after[cut - 1], before[cut], after[n - 1] = n, -1, n
            self._sweep(data, token, after, before, cut)
        kept = np.flatnonzero(token[:n] >= 0)
        return token[kept], np.searchsorted(kept, ends)

    def _sweep(self, data: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray, cut: np.ndarray) -> None:
        n = len(data)
        buckets: dict[int, list[np.ndarray]] = {}

        def put(at: np.ndarray, rank: np.ndarray) -> list[int]:
            """Places into their buckets; the buckets that are new."""
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return []
            at, rank = at[some], rank[some]
            if len(at) > 1:
                by = np.argsort(rank, kind="stable")
                at, rank = at[by], rank[by]
            edges = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            fresh = []
            for a, b in zip(edges, edges[1:]):
                own = int(rank[a])
                if own in buckets:
                    buckets[own].append(at[a:b])
                else:
                    buckets[own] = [at[a:b]]
                    fresh.append(own)
            return fresh

        first = self.from_byte[data[:-1].astype(np.int64) << 8 | data[1:]]
        first[cut - 1] = -1
        waiting = put(np.arange(n - 1), first)
        heapify(waiting)
        while waiting:
            rank = heappop(waiting)
            left, right = self.pairs[rank]
            at = np.unique(np.concatenate(buckets.pop(rank)))
            # some have changed since they were put there
            at = at[token[at] == left]
            at = at[token[after[at]] == right]
            if left == right and len(at) > 1:
                # in a run of one token every second place begins a pair
                joins = np.append(False, after[at[:-1]] == at[1:])
                turn = np.arange(len(at)) - np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
                at = at[turn % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            token[at], token[gone], after[at] = 256 + rank, -1, far
            inside = far < n
            before[far[inside]] = at[inside]
            near = before[at]
            new = np.concatenate([at[inside], near[near >= 0]])
            for fresh in put(new, self._rank(token[new], token[after[new]])):
                heappush(waiting, fresh)


def _bytes(column, framed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and ends of the texts of an Arrow column, some at a time; with ``framed`` each with its newline."""
    group, size = [], 0
    end = b"\n" if framed else b""
    for text in column.to_pylist():
        own = text.encode() + end if text is not None else b""
        if group and size + len(own) > SWEPT:
            yield np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(x) for x in group])
            group, size = [], 0
        group.append(own)
        size += len(own)
    if group:
        yield np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(x) for x in group])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is too small to fill a task on each; a larger one stays as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * SPLIT
    return df.repartition(cores) if small else df


def encoded(docs: DataFrame, merges: Sequence[tuple[int, int]], text_col: str = "text", framed: bool = True, ids_col: str = "ids", carried: list[str] | None = None) -> DataFrame:
    """``docs`` with the ids of each text, with ``framed`` of the text and its newline; a null text has none.

    Only the columns in ``carried`` go along, if given: the text travels once more if it is among them.
    ``merges`` are what ``train_by_passes``, ``train_sample`` or ``load_tokenizer`` give; tasks carry them.
    """
    small_batches(docs.sparkSession)
    merges = list(merges)
    names = [c for c in (docs.columns if carried is None else carried) if c != ids_col]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Merges(merges)
        for batch in batches:
            swept = (table.encode(data, ends) for data, ends in _bytes(batch.column(batch.num_columns - 1), framed))
            parts = [(ids.astype(np.int32), ends) for ids, ends in swept]
            ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int32)
            sizes = np.concatenate([np.diff(x, prepend=0) for _, x in parts]) if parts else np.zeros(0, np.int64)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema.names)

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(*names, F.col(text_col).cast("string").alias("_encoded")).mapInArrow(run, schema)


def pair_counts(texts: DataFrame, merges: Sequence[tuple[int, int]], text_col: str = "text", framed: bool = False) -> DataFrame:
    """``left``, ``right`` and ``n``: adjacent tokens once ``merges`` are applied, overlapping pairs included.

    Each task sums its own pairs first.
    """
    small_batches(texts.sparkSession)
    merges = list(merges)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, keys, counts = Merges(merges), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for data, ends in _bytes(batch.column(0), framed):
                ids, stops = table.encode(data, ends)
                inside = np.ones(max(len(ids) - 1, 0), bool)
                inside[stops[(stops > 0) & (stops < len(ids))] - 1] = False
                key = (ids[:-1] * table.size + ids[1:])[inside]
                if table.size <= 1024:
                    own = np.bincount(key, minlength=1)
                    found = np.flatnonzero(own)
                    own = own[found]
                else:
                    found, own = np.unique(key, return_counts=True)
                every, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
                total = np.zeros(len(every), np.int64)
                np.add.at(total, place, np.concatenate([counts, own]))
                keys, counts = every, total
        yield pa.RecordBatch.from_arrays([pa.array((keys // table.size).astype(np.int32)), pa.array((keys % table.size).astype(np.int32)), pa.array(counts)], ["left", "right", "n"])

    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "left int, right int, n long")
    return rows.groupBy("left", "right").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Decoder for ``merges``: the bytes of all ids, one after another, and where each begins."""

    def __init__(self, merges: Sequence[tuple[int, int]]):
        words = [bytes([b]) for b in range(256)]
        for k, (a, b) in enumerate(merges):
            if not (0 <= a < len(words) and 0 <= b < len(words)):
                raise ValueError(f"merge {k} names an unknown id")
            words.append(words[a] + words[b])
        words.append(b"")  # the end of a document
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of concatenated rows of ids, and where those of each row end; an unknown id is an error."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes)):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        after = np.cumsum(sizes)
        # each byte's place in the vocabulary: its word's begin plus its place in the word
        places = np.arange(after[-1] if len(after) else 0) + np.repeat(self.begins[ids] - (after - sizes), sizes)
        return self.data[places], np.append(0, after)[ends]


def decoded(df: DataFrame, merges: Sequence[tuple[int, int]], ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of each row's ids instead of them; null ids give null.

    Bytes that aren't UTF-8 become the replacement character, the end token the empty string; an unknown id fails.
    """
    small_batches(df.sparkSession)
    merges = list(merges)
    names = [c for c in df.columns if c not in (ids_col, text_col)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Vocabulary(merges)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = []
            for begin in range(0, len(column), 64):
                rows = column.slice(begin, 64)
                ids, ends = np.asarray(rows.flatten(), np.int64), np.cumsum([len(x) if x.is_valid else 0 for x in rows])
                data, stops = words.decode(ids, ends)
                whole = data.tobytes()
                for x, a, b in zip(rows, [0, *stops[:-1].tolist()], stops.tolist()):
                    texts.append(whole[a:b].decode("utf-8", "replace") if x.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(text_col, T.StringType())])
    return df.select(*names, F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(run, schema)
