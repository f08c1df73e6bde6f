"""Byte-level BPE encoding and decoding by merge ranks.

Encoding keeps the parts of a pre-token in a linked list. The adjacent pairs wait in one bucket per
merge rank; a hierarchical bitmap over the ranks says which buckets hold anything, so the next rank is
found by a find-first-set on each level. A merge leaves the entries of its neighbours in place; an entry
whose pair has changed since is stale and is skipped when it comes up. The work is near linear in the
bytes, also for one pre-token of many megabytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ByWords, Kept, kept_in_worker, small_batches

#: Words kept with their ids in a worker; pairs of parts kept with their ranks.
CACHE_ENTRIES, PAIR_ENTRIES = 1_000_000, 1_000_000
#: Ids that are decoded at once; a longer row is decoded alone.
STRETCH = 1 << 18


class RankBitmap:
    """A set of ranks: words of 256 bits, and above them one bit for each word that isn't empty."""

    def __init__(self, size: int):
        self.words = [0] * ((size + 255) // 256)
        self.top = 0

    def add(self, rank: int) -> None:
        self.words[rank >> 8] |= BIT[rank & 255]
        self.top |= 1 << (rank >> 8)

    def remove(self, rank: int) -> None:
        self.words[rank >> 8] ^= BIT[rank & 255]
        if not self.words[rank >> 8]:
            self.top ^= 1 << (rank >> 8)

    def first(self) -> int:
        """The least rank, by a find-first-set on each level; -1 if there is none."""
        top = self.top
        if not top:
            return -1
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        return (at << 8) + (word & -word).bit_length() - 1


BIT = [1 << i for i in range(256)]


class _Pairs(dict):
    """Rank of two adjacent parts by left * 2**20 + right, or -1; worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        found = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        if len(self) >= PAIR_ENTRIES:
            self.clear()
        self[key] = found
        return found


class RankedBpe:
    """Encoder and decoder for the vocabulary ``ranks``: bytes to rank; every single byte has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.double = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        # all tokens' bytes, and where those of each id are; a length of -1 where there is no token
        self.data = np.frombuffer(b"".join(self.tokens.values()), np.uint8)
        self.lengths, self.begins = np.full(max(self.tokens) + 1, -1, np.int64), np.zeros(max(self.tokens) + 1, np.int64)
        own = np.array([len(token) for token in self.tokens.values()], np.int64)
        self.lengths[list(self.tokens)], self.begins[list(self.tokens)] = own, np.cumsum(own) - own
        self.bitmap = RankBitmap(max(ranks.values()) + 1)
        self.pairs = _Pairs(ranks, self.tokens)
        piece = lambda text: np.array(self.encode_piece(text.encode()), np.int32).tobytes()
        packed, split = Kept(piece, CACHE_ENTRIES), regex.compile(pattern).findall
        whole = lambda text: b"".join(map(packed.__getitem__, split(text)))
        # other patterns may join what the public one keeps apart
        self.coded = ByWords(piece, whole, CACHE_ENTRIES) if pattern == public_tokenizers.PATTERN else whole

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: least rank first, leftmost among equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, pairs, buckets = len(piece), self.pairs, {}
        # the bitmap's two levels; its methods are written out here, since they are most of the work
        words, top = self.bitmap.words, 0
        part = [self.single[b] for b in piece]
        part.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        double = self.double
        for at, rank in enumerate([double[a][b] for a, b in zip(piece, piece[1:])]):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(at)  # in order, so a heap
                else:
                    buckets[rank] = [at]
                    words[rank >> 8] |= BIT[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            # find-first-set on each level
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = (high << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                at = bucket[0]
                del buckets[rank]
                words[high] = word = word ^ low
                if not word:
                    top &= top - 1
            else:
                at = heappop(bucket)
            left, right = part[at], after[at]
            if left < 0 or right >= n or pairs[(left << 20) + part[right]] != rank:
                continue  # stale
            part[at], part[right] = rank, -1
            after[at] = right = after[right]
            before[right] = at
            if right < n and (new := pairs[(rank << 20) + part[right]]) >= 0:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    words[new >> 8] |= BIT[new & 255]
                    top |= 1 << (new >> 8)
            at = before[at]
            if at >= 0 and (new := pairs[(part[at] << 20) + rank]) >= 0:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    words[new >> 8] |= BIT[new & 255]
                    top |= 1 << (new >> 8)
        return [x for x in part if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.coded(text), np.int32)

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; an id without a token raises KeyError."""
        return self.decode_rows(np.asarray(ids, np.int64), np.array([len(ids)]))[0]

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of concatenated rows of ids, by where each row ends."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and self.lengths[ids].min() >= 0):
            raise KeyError("an id has no token")
        lengths = self.lengths[ids]
        after = np.append(0, np.cumsum(lengths))
        # each byte's place among all tokens': its token's begin plus its place in the token
        places = np.repeat(self.begins[ids] - after[:-1], lengths)
        places += np.arange(after[-1])
        data, stops = self.data[places].tobytes(), after[ends].tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]


def load(path: str | None = None, pattern: str | None = None) -> RankedBpe:
    """The encoder of a rank file; by default the public multilingual one and its pattern."""
    return kept_in_worker(("bpe", path, pattern), lambda: _load(path, pattern))


def _load(path: str | None, pattern: str | None) -> RankedBpe:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return RankedBpe(ranks, pattern or public_tokenizers.PATTERN)


def _carried(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType, True)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; a null text has no ids.

    The rank file is read on the executors from ``ranks_path`` (default: the installed public file), so it
    must be installed there. Special tokens have no meaning here. Rows repeat as they come, ids may be null;
    other columns are ignored, so their names can't clash. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(ranks_path)
        for batch in batches:
            rows = [bpe.encode(text or "") for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(row) for row in rows], out=offsets[1:])
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], [id_col, "ids"])

    schema = T.StructType([_carried(df, id_col), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (binary): the bytes the ids stand for; null ids have none.

    An unknown id fails the query, since no bytes stand for it.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe = load(ranks_path)
        for batch in batches:
            ids = batch.column(1)
            values, ends = np.asarray(ids.flatten()), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)), dtype=np.int64)
            decoded, row, at = [], 0, 0
            while row < len(ends):
                stop = max(row + 1, int(np.searchsorted(ends, at + STRETCH, "right")))
                decoded += bpe.decode_rows(values[at : ends[stop - 1]], ends[row:stop] - at)
                row, at = stop, int(ends[stop - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    schema = T.StructType([_carried(df, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as counts and digests."""
    from .common import read

    coded = decode(encode(read(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
