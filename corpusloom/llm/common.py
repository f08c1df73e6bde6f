"""Shared helpers of the training-data operators: shared storage, batch sizes, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import _STORED, _remove, discard, shared_dir, small_batches, stored  # noqa: F401

__all__ = ["discard", "materialize", "shared_dir"]
materialize = stored

#: Bytes that separate words: the blank and \t..\r.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def contained(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; the other tables that were stored on the way are deleted."""
    before = set(_STORED)
    out = materialize(make())
    for path in set(_STORED) - before - {out._stored}:
        _remove(path)
    return out


def located(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df``, with ``file`` and ``row``: where each row stands in the files it is read from.

    A frame that isn't read straight from files is written to the shared folder first.
    """

    def placed(of: DataFrame) -> DataFrame:
        place = of.metadataColumn("_metadata")
        return of.select(*columns, F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))

    try:
        return placed(df)
    except AnalysisException:
        return placed(materialize(df))


def in_groups(texts: list[str], chars: int = 1 << 17) -> Iterator[tuple[int, list[str]]]:
    """``texts`` in groups of about ``chars`` characters, each with the place of its first text.

    Arrays over a group stay small; a text that is longer is a group of its own.
    """
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


_HELD: dict = {}


def kept_in_worker(key: tuple, make):
    """What a Python worker keeps between tasks: the tables of one operator at a time.

    Workers serve one stage after another; without this, each would keep the tables of all of them.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class Kept(dict):
    """What ``make`` gives for a string, kept for strings of up to ``chars`` characters.

    Beyond ``entries`` of them the store starts anew.
    """

    def __init__(self, make: Callable[[str], bytes], entries: int, chars: int = 48):
        self.make, self.entries, self.chars = make, entries, chars

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) <= self.chars:
            if len(self) >= self.entries:
                self.clear()
            self[text] = found
        return found


class _Words(Kept):
    """What stands for a word with ``blank`` before it. A word with a mark after it is put together anew each time."""

    def __init__(self, blank: str, piece: Callable[[str], bytes], whole: Callable[[str], bytes], marks: Kept, entries: int):
        super().__init__(lambda word: piece(blank + word) if word.isalpha() else whole(blank + word), entries)
        self.marks = marks

    def __missing__(self, word: str) -> bytes:
        if word[-1] in ",.;:!?" and word[:-1].isalpha():
            return self[word[:-1]] + self.marks[word[-1]]
        return super().__missing__(word)


class ByWords:
    """Encodes texts word by word, for byte-level encoders that cut texts by the public pattern.

    The pattern never joins what stands on either side of a blank or a line feed between two characters that
    aren't white space: a blank begins a new piece, and a line feed is a piece of its own. So words with the
    blank before them can be encoded alone and kept. ``piece`` encodes one piece of the pattern, ``whole`` any text;
    texts with other white space go to the latter.
    """

    def __init__(self, piece: Callable[[str], bytes], whole: Callable[[str], bytes], entries: int):
        marks = Kept(piece, 4096)
        self.whole, self.feed = whole, marks["\n"]
        self.first, self.later = _Words("", piece, whole, marks, entries // 8), _Words(" ", piece, whole, marks, entries)

    def __call__(self, text: str) -> bytes:
        out = []
        for line in text.split("\n"):
            # what isn't printable may be other white space
            if not line or line[0] == " " or line[-1] == " " or "  " in line or not line.isprintable():
                return self.whole(text)
            head, *tail = line.split(" ")
            out.append(self.first[head])
            out.extend(map(self.later.__getitem__, tail))
            out.append(self.feed)
        out.pop()
        return b"".join(out)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, concatenated, and n + 1 offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C55
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of concatenated texts: 64-bit hashes, first bytes, ends, and n + 1 word offsets by text.

    A word is a longest run of bytes that are no separators inside one text.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEPARATOR[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut[1:] - 1] = inside[cut[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    length = ends - starts
    power = _powers(int(length.max()) + 1)
    place = np.arange(n, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, n)))[: n - starts[0]] if starts[0] == 0 else None
    if place is None:
        place = np.zeros(n, np.int64)
        place[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
    place[~inside] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * power[place]
    value[~inside] = 0
    h = np.add.reduceat(value, starts)
    h = mix(h ^ (length.astype(np.uint64) << np.uint64(40)))
    return h, starts, ends, np.searchsorted(starts, offsets)


def byte_runs(data: bytes, table: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """Maximal runs of the bytes that ``table`` (256 bytes, for ``bytes.translate``) doesn't turn into blanks.

    They come as translated, in lists from about ``step`` bytes each, so that a long text needs little memory.
    """
    data, at = data.translate(table), 0
    while at < len(data):
        end = data.find(b" ", at + step)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def salted(rows: DataFrame, few: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row for each ``key``, when few keys hold most rows.

    Each row of ``few`` goes to as many places as there are shuffle partitions, and rows go to one of them by a
    hash of ``spread``, so that no task gets all rows of a key.
    """
    places = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(places)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")
