"""Removing text that repeats: every byte covered by a long enough string that also starts anywhere else.

All windows of LENGTH bytes of all texts must be compared. A window's key is the least hash of the short
grams in it, so equal windows have equal keys. Neighbouring windows with one key form a segment; every window
lies in exactly one segment, and a segment is little longer than a window. Segments whose key occurs once
hold no repeated window. Of the others, equal segments are counted as one; a segment that occurs twice or
more is repeated as a whole. What is left are different segments that share a key, such as the ends of shared
passages and the surroundings of edits: their bytes meet in buckets, where a run-length index
(``run_index``) streams match lengths over them and marks long matches.

Segments that share a key in very large numbers aren't brought together: their single windows are counted by
hash instead, which gives the same answer in any number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, materialize, mix, small_batches, text_bytes
from .run_index import match_lengths

LENGTH = 200
#: Bytes of the grams that are hashed.
GRAM = 24
#: Bytes of segments in an index, on average.
BUCKET_BYTES = 1 << 20
#: Different segments with one key from which on single windows are counted.
CROWD = 4096
#: Bytes that are cut into segments at once; longer texts are cut in parts that overlap.
_CHUNK, _PART = 1 << 17, 1 << 22
_TABLE = np.random.RandomState(5).randint(1, 2**62, 256).astype(np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, text, start, end and ``twice`` of the segments of concatenated texts.

    ``start`` and ``end`` are places in the whole of ``data``. ``twice`` is false only where no window can
    occur twice inside the segment.
    """
    n, width = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool)
    h, size, power = _TABLE[data], 1, 0x9E3779B97F4A7C55
    kept = {}
    while size < GRAM:
        kept[size] = h
        if size * 2 > GRAM:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2
    rest = GRAM - size
    if rest:
        # the last part may overlap the first: only equality counts
        h = h[: n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93) + h[rest : rest + n - GRAM + 1]
    h = mix(h)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    place = (least & _PLACE).astype(np.int64)
    key = h[place]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    long = lengths >= length
    valid = np.zeros(n + 1, np.int8)
    valid[begins[long]] += 1
    valid[ends[long] - length + 1] -= 1
    valid = np.cumsum(valid[: len(key)]).astype(bool)
    edge = np.ones(len(key), bool)
    edge[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    edge[begins[long]] = True
    start = np.flatnonzero(valid & edge)
    last = np.ones(len(key), bool)
    last[:-1] = edge[1:] | ~valid[1:]
    stop = np.flatnonzero(valid & last)
    return key[start], np.searchsorted(ends, start, "right"), start, stop + length, place[start] != place[stop]


def _parts(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, first byte, last) that are cut at once."""
    group, size = [], 0
    for text in range(len(offsets) - 1):
        begin, end = int(offsets[text]), int(offsets[text + 1])
        while end - begin >= length:
            stop = min(end, begin + _PART)
            group.append((text, begin, stop))
            size += stop - begin
            if size >= _CHUNK:
                yield group
                group, size = [], 0
            if stop == end:
                break
            begin = stop - length + 1
    if group:
        yield group


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """file, row, key, digest, start, end, twice of every segment; places count from the text's first byte."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        kept_in_worker(("suffix_dedup",), dict)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            made = []
            for group in _parts(offsets, length):
                own = np.concatenate([data[a:b] for _, a, b in group])
                sizes = np.array([b - a for _, a, b in group])
                key, part, start, end, twice = segments(own, sizes, length)
                view = memoryview(own.tobytes())
                found = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
                text = np.array([t for t, _, _ in group])[part]
                # from places in the group to places in the text
                shift = np.array([a for _, a, _ in group])[part] - (np.cumsum(sizes) - sizes)[part] - offsets[text]
                made.append((text, key.view(np.int64), found.view(np.int64), start + shift, end + shift, twice))
            if not made:
                continue
            text, key, found, start, end, twice = (np.concatenate(x) for x in zip(*made))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(found), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(twice)],
                ["file", "row", "key", "digest", "start", "end", "twice"],
            )

    return docs.mapInArrow(run, "file long, row long, key long, digest long, start int, end int, twice boolean")


def _compressed(docs: DataFrame, id_cols: list[str]) -> DataFrame:
    """``docs`` with its text's bytes as zstandard frames, which halves what a shuffle moves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [compress((text or "").encode()) for text in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [*batch.schema.names[:-1], "packed"])

    kept = docs.select("file", "row", *id_cols, "text")
    return kept.mapInArrow(run, kept.drop("text").withColumn("packed", F.lit(b"")).schema)


def _bytes_of(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of wanted segments: key, digest, crowd, bytes."""
    wanted = requests.groupBy("file", "row").agg(F.collect_list(F.struct("key", "digest", "start", "end", "crowd")).alias("wanted"))
    rows = wanted.join(texts, ["file", "row"]).select("wanted", "packed")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            key, digest, crowd, own = [], [], [], []
            for wanted, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = expand(packed)
                for x in wanted:
                    key.append(x["key"])
                    digest.append(x["digest"])
                    crowd.append(x["crowd"])
                    own.append(text[x["start"] : x["end"]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(crowd, pa.bool_()), pa.array(own, pa.binary())], ["key", "digest", "crowd", "bytes"])

    return rows.mapInArrow(run, "key long, digest long, crowd boolean, bytes binary")


def _indexed(length: int):
    """Repeated ranges of the segments of one bucket, from a run-length index over all of them."""

    def run(table):
        import pyarrow as pa

        own = table["bytes"].combine_chunks()
        offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        data = np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        # a byte that UTF-8 lacks stands after each segment
        at = np.repeat(np.arange(len(size)), size)
        text = np.full(len(data) + len(size), 0xFF, np.uint8)
        text[np.arange(len(data)) + at] = data
        found = match_lengths(text)[np.arange(len(data)) + at]
        inside = offsets[1:][at] - np.arange(len(data))
        hit = np.flatnonzero(np.minimum(found, inside) >= length)
        begin, end, seg = _ranges(hit - offsets[at[hit]], at[hit], length)
        seg = pa.array(seg)
        return pa.table({"key": table["key"].take(seg), "digest": table["digest"].take(seg), "from": pa.array(begin.astype(np.int32)), "to": pa.array(end.astype(np.int32))})

    return run


def _ranges(start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of covered bytes, from the starts of windows in order, within each group."""
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last] + length, group[first]


def _crowded(own: DataFrame, length: int) -> DataFrame:
    """Repeated ranges of segments, by counting each window by its hash."""

    def windows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows, start, window = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                view = memoryview(text)
                for at in range(len(text) - length + 1):
                    rows.append(i)
                    start.append(at)
                    window.append(digest(view[at : at + length]))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start, pa.int32()), pa.array(window, pa.binary())], ["key", "digest", "from", "window"])

    every = own.select("key", "digest", "bytes").mapInArrow(windows, "key long, digest long, from int, window binary")
    often = every.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return every.join(often, "window", "left_semi").select("key", "digest", "from", (F.col("from") + length).alias("to"))


def keyed_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``file`` and ``row``: where its row stands in the files it is read from.

    A frame that isn't read straight from files is written to the shared folder first.
    """
    from pyspark.errors import AnalysisException

    names = [c for c in df.columns if c not in ("file", "row")]
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.select(*names, *place)
    except AnalysisException:
        return materialize(df.select(*names)).select(*names, *place)


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """``ranges`` of each text that has any, by file and row, and ``texts``: what was read, compressed.

    ``docs`` has file, row, text and any other columns, which stay with the texts.
    """
    small_batches(docs.sparkSession)
    texts = _compressed(docs, [c for c in docs.columns if c not in ("file", "row", "text")])
    every = materialize(_cut(docs.select("file", "row", F.col("text").cast("string")), length))
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice").select("key")
    shared = materialize(every.join(keys, "key", "left_semi"))
    one = F.min(F.struct("file", "row", "start", "end")).alias("one")
    different = materialize(shared.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), one).select("key", "digest", "n", "twice", "one.*"))
    kinds = different.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any"))
    asked = different.join(kinds, "key").where("kinds > 1 OR any").withColumn("crowd", F.col("kinds") > CROWD)
    own = materialize(_bytes_of(asked, texts))
    total = own.where("NOT crowd").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES), min(math.ceil(total / (BUCKET_BYTES / 16)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    indexed = own.where("NOT crowd").groupBy(bucket).applyInArrow(_indexed(length), "key long, digest long, from int, to int")
    found = indexed.union(_crowded(own.where("crowd"), length))
    found = found.groupBy("key", "digest").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("end") - F.col("start")).alias("to")))
    marked = different.join(found, ["key", "digest"], "left").select("key", "digest", F.when(F.col("n") > 1, whole).otherwise(F.col("ranges")).alias("ranges")).where("ranges IS NOT NULL")
    hits = shared.join(marked, ["key", "digest"]).select("file", "row", F.transform("ranges", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to"))).alias("ranges"))
    return hits.groupBy("file", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), texts


def _kept(text: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """Bytes that stay, bytes that go, and the runs that these are in."""
    kept, end, removed, spans = [], 0, 0, 0
    for begin, stop in sorted((x["from"], x["to"]) for x in ranges or ()):
        if begin > end or not spans:
            kept.append(text[end:begin])
            spans += 1
            removed += stop - begin
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    kept.append(text[end:])
    return b"".join(kept), removed, spans


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` with kept (binary: the bytes that stay; with ``as_text`` their whole characters), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else as well, in its own text
    too. Matches stay inside texts; a null text is empty. Rows may repeat, ids may be null. Columns named
    file, row, text (other than ``text_col``) or like the results are dropped.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans", "packed", "ranges", "file", "row")
    others = [c for c in docs.columns if c not in made and c not in (text_col, "text")]
    keyed = keyed_rows(docs.select(*others, F.col(text_col).alias("text")))
    ranges, texts = repeated_ranges(keyed.select("file", "row", *others, "text"), length)
    rows = texts.join(ranges, ["file", "row"], "left").select(*others, "packed", "ranges")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            k = batch.num_columns
            before = [expand(x) for x in batch.column(k - 2).to_pylist()]
            done = [_kept(text, own) for text, own in zip(before, batch.column(k - 1).to_pylist())]
            kept = pa.array([x[0].decode(errors="ignore") for x in done], pa.string()) if as_text else pa.array([x[0] for x in done], pa.binary())
            columns = [kept, *(pa.array(x, pa.int64()) for x in (list(map(len, before)), [x[1] for x in done], [x[2] for x in done]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: k - 2], *columns], schema.names)

    schema = rows.drop("packed", "ranges").withColumn("kept", F.lit("" if as_text else b"")).withColumns({c: F.lit(0).cast("long") for c in ("n_bytes", "n_removed", "n_spans")}).schema
    return rows.mapInArrow(run, schema)


def trimmed(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text. Characters that lose a part of their bytes go whole.

    Every row stays; a null text stays null.
    """
    others = [c for c in docs.columns if c != text_col]
    safe = {c: f"_own{i}" for i, c in enumerate(others)}
    own = docs.select(F.col(text_col).isNull().alias("_null"), *(F.col(c).alias(safe[c]) for c in others), F.col(text_col).alias("text"))
    done = without_repeats(own, "text", length, as_text=True)
    # decoded where it is cut: a second step in Python would keep a second worker for each task
    text = F.when(~F.col("_null"), F.col("kept")).alias(text_col)
    out = done.select(text, *(F.col(v).alias(k) for k, v in safe.items()))
    return out.select(*docs.columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document, as counts and a digest."""
    from .common import read

    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
