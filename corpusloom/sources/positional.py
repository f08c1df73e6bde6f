"""Byte streams whose order counts: written in ranges by many tasks, and read back by place.

``write_streams`` writes the binary columns of an ordered frame as streams, one range file for each task. A Spark data
source does it in two phases: tasks write into a staging folder, and only when all are done does the driver list their
files, with the offsets that their sizes add up to, and move the folder into place. A task that dies leaves nothing that
the list names.

``read_indexed`` reads a corpus by its index of entries of 17 bytes: each range of entries is summed by a task, the sums
say where each range begins in the corpus, and tasks then read their own bytes only. ``token_documents`` reads streams of
16-bit tokens in byte ranges: a range gives its whole documents as they are; what belongs to a document that goes on
before or after the range is put together in a shuffle of those pieces alone.

Paths may be local or URIs that Arrow's file systems open; the driver and all executors must see them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.sources.files import InvalidFile

#: An index entry: bytes of the document with its newline, whether it is for validation, and its sample key.
ENTRY = np.dtype([("bytes", "<i8"), ("validation", "u1"), ("key", "<u8")])
#: Entries of a task, and bytes of a task's range of tokens.
ENTRIES, RANGE = 1 << 20, 128 << 20
#: Bytes that are read at once.
_BLOCK = 4 << 20
_LIST = "manifest.json"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass(frozen=True)
class Part:
    """A file that holds ``size`` bytes of a stream from ``offset`` on."""

    file: str
    offset: int
    size: int


def parts_of(path: str, stream: str | None = None) -> list[Part]:
    """The files of a stream that ``write_streams`` wrote to ``path``, or the one file at ``path``."""
    files, place = _filesystem(path)
    if stream is None:
        found = files.get_file_info(place)
        if not found.is_file:
            raise InvalidFile(f"there is no file {path}")
        return [Part(path, 0, found.size)]
    with files.open_input_stream(f"{place}/{_LIST}") as f:
        listed = json.loads(f.read())["streams"]
    if stream not in listed:
        raise InvalidFile(f"there is no stream {stream} in {path}")
    return [Part(f"{path}/{x['file']}", x["offset"], x["bytes"]) for x in listed[stream]]


def total(parts: list[Part]) -> int:
    return sum(x.size for x in parts)


def _within(parts: list[Part], begin: int, end: int) -> list[Part]:
    """The parts that hold bytes from ``begin`` to ``end``."""
    return [x for x in parts if x.offset < end and begin < x.offset + x.size]


def _read(parts: list[Part], begin: int, end: int) -> bytes:
    out = []
    for part in _within(parts, begin, end):
        files, place = _filesystem(part.file)
        a, b = max(begin, part.offset), min(end, part.offset + part.size)
        with files.open_input_file(place) as f:
            out.append(f.read_at(b - a, a - part.offset))
    data = b"".join(out)
    if len(data) != end - begin:
        raise InvalidFile(f"bytes {begin} to {end} are not there")
    return data


# writing


@dataclass
class _Written(WriterCommitMessage):
    task: int
    rows: int
    files: dict[str, tuple[str, int]]


class _StreamWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names = path, names
        files, place = _filesystem(path)
        if not overwrite and files.get_file_info(place).type.name != "NotFound":
            raise InvalidFile(f"{path} is there already")
        self.staging = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
        # made here and not by tasks: one that still runs when the write is given up can't bring the folder back
        for name in names:
            files.create_dir(f"{place.rstrip('/')}{self.staging[len(path.rstrip('/')) :]}/{name}", recursive=True)

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        context = TaskContext.get()
        files, place = _filesystem(self.staging)
        # a name for each attempt, so that two attempts of a task don't meet
        name = f"{context.partitionId():08d}-{context.taskAttemptId()}"
        out, sizes, rows = {}, dict.fromkeys(self.names, 0), 0
        try:
            for batch in iterator:
                rows += batch.num_rows
                for stream, column in zip(self.names, batch.columns):
                    column = column.drop_null()
                    if pa.types.is_list(column.type):
                        ids = np.asarray(column.flatten())
                        if len(ids) and not (0 <= ids.min() and ids.max() < 65536):
                            raise InvalidFile("a token id is out of range")
                        data = ids.astype("<u2").tobytes()
                    else:
                        data = b"".join(pc.cast(column, pa.large_binary()).to_pylist())
                    if data:
                        if stream not in out:
                            out[stream] = files.open_output_stream(f"{place}/{stream}/{name}")
                        out[stream].write(data)
                        sizes[stream] += len(data)
        finally:
            for f in out.values():
                f.close()
        return _Written(context.partitionId(), rows, {s: (f"{s}/{name}", sizes[s]) for s in out})

    def commit(self, messages):
        from pyarrow import fs

        files, place = _filesystem(self.staging)
        listed: dict[str, list] = {name: [] for name in self.names}
        at = dict.fromkeys(self.names, 0)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for stream, (file, size) in m.files.items():
                listed[stream].append({"file": file, "offset": at[stream], "bytes": size})
                at[stream] += size
        wanted = {f"{place}/{x['file']}" for own in listed.values() for x in own}
        for found in files.get_file_info(fs.FileSelector(place, recursive=True)):
            if found.is_file and found.path not in wanted:
                files.delete_file(found.path)
        with files.open_output_stream(f"{place}/{_LIST}") as f:
            f.write(json.dumps({"rows": sum(m.rows for m in messages if m is not None), "bytes": at, "streams": listed}).encode())
        _, target = _filesystem(self.path)
        if files.get_file_info(target).type.name != "NotFound":
            if files.get_file_info(f"{target}.bak").type.name != "NotFound":
                files.delete_dir(f"{target}.bak")
            files.move(target, f"{target}.bak")
        files.move(place, target)

    def abort(self, messages):
        files, place = _filesystem(self.staging)
        for _ in range(3):
            # tasks that are being stopped may still add a file meanwhile
            try:
                if files.get_file_info(place).type.name != "NotFound":
                    files.delete_dir(place)
                return
            except OSError:
                time.sleep(0.5)


class OrderedStreams(DataSource):
    """Sink of ``write_streams``."""

    @classmethod
    def name(cls):
        return "ordered_streams"

    def writer(self, schema, overwrite):
        return _StreamWriter(self.options["path"], schema.names, overwrite)


def write_streams(ordered: DataFrame, path: str) -> dict:
    """Write each column of ``ordered`` as a stream: its values one after another, in the order of rows.

    Columns are binary, or arrays of ids, which are written as 16-bit integers, little end first; an id beyond that is
    an error. Nulls and empty values add nothing. ``ordered`` must be in order across its partitions and within them, as
    ``in_order`` leaves it. The folder at ``path`` appears when all is written, and the one before it becomes ``.bak``.
    Returns rows and the bytes of each stream.
    """
    spark = ordered.sparkSession
    spark.dataSource.register(OrderedStreams)
    ordered.write.format("ordered_streams").mode("overwrite").save(path)
    files, place = _filesystem(path)
    with files.open_input_stream(f"{place}/{_LIST}") as f:
        found = json.loads(f.read())
    return {"rows": found["rows"], "bytes": found["bytes"]}


def in_order(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``df`` sorted in ranges, as many as Spark finds fit if none are given.

    Steps that keep rows where they are, such as encoding, may follow.
    """
    spread = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def entry(doc_bytes, is_validation, sample_key):
    """An index entry as binary, from a long, a boolean and a DECIMAL(20, 0)."""
    # the eight bytes of an integer, little end first, from its hex digits
    turned = lambda x: F.concat(*(F.substring(F.lpad(x, 16, "0"), 2 * k + 1, 2) for k in reversed(range(8))))
    key = F.conv(sample_key.cast("string"), 10, 16)
    return F.unhex(F.concat(turned(F.hex(doc_bytes)), F.when(is_validation, "01").otherwise("00"), turned(key)))


def write_corpus(index: DataFrame, path: str, *order: str, ranges: int | None = None) -> dict:
    """Write documents in order as streams ``corpus`` (texts with their newlines) and ``index``.

    ``index`` is what ``operators.corpus.indexed`` makes, with the columns in ``order``.
    """
    rows = in_order(index.select(*order, "text", "doc_bytes", "is_validation", "sample_key"), *order, ranges=ranges)
    content = F.concat(F.col("text"), F.lit("\n")).cast("binary")
    return write_streams(rows.select(content.alias("corpus"), entry(F.col("doc_bytes"), F.col("is_validation"), F.col("sample_key")).alias("index")), path)


# reading a corpus by its index

_SCHEMA = "position long, doc_bytes long, is_validation boolean, sample_key decimal(20,0), content binary"


class IndexedCorpus(DataSource):
    """Source of ``read_indexed``, which plans it."""

    @classmethod
    def name(cls):
        return "indexed_corpus"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _IndexedReader(json.loads(self.options["plan"]))


class _IndexedReader(DataSourceReader):
    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self):
        index, corpus = ([Part(*x) for x in self.plan[k]] for k in ("index", "corpus"))
        size, out = ENTRY.itemsize, []
        for first, count, begin, end in self.plan["ranges"]:
            own = _within(index, first * size, (first + count) * size)
            out.append(InputPartition((own, _within(corpus, begin, end), first, count, begin)))
        return out

    def read(self, partition):
        import pyarrow as pa

        index, corpus, first, count, at = partition.value
        entries = np.frombuffer(_read(index, first * ENTRY.itemsize, (first + count) * ENTRY.itemsize), ENTRY)
        ends = np.cumsum(entries["bytes"])
        k = 0
        while k < count:
            begin = int(ends[k - 1]) if k else 0
            stop = max(k + 1, min(int(np.searchsorted(ends, begin + _BLOCK, "right")), k + 4096))
            own = entries[k:stop]
            data = _read(corpus, at + begin, at + int(ends[stop - 1]))
            offsets = np.append(0, ends[k:stop] - begin).astype(np.int64)
            content = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
            keys = pa.array([str(x) for x in own["key"].tolist()]).cast(pa.decimal128(20, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + k, first + stop)), pa.array(own["bytes"].astype(np.int64)), pa.array(own["validation"] != 0), keys, content], ["position", "doc_bytes", "is_validation", "sample_key", "content"])
            k = stop


def read_indexed(spark: SparkSession, index: list[Part], corpus: list[Part], entries: int = ENTRIES) -> DataFrame:
    """``position``, ``doc_bytes``, ``is_validation``, ``sample_key`` and ``content`` of all documents of a corpus.

    A task reads ``entries`` entries and their bytes. Fails if the index isn't whole entries, if a length is not
    positive or beyond 31 bits, or if the lengths don't add up to the corpus. One sum for each range reaches the driver.
    """
    size = total(index)
    if size % ENTRY.itemsize:
        raise InvalidFile(f"an index has entries of {ENTRY.itemsize} bytes")
    n = size // ENTRY.itemsize
    ranges = -(-n // entries)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, last = k * entries, min(n, (k + 1) * entries)
                lengths = np.frombuffer(_read(index, first * ENTRY.itemsize, last * ENTRY.itemsize), ENTRY)["bytes"]
                bad = lengths[(lengths <= 0) | (lengths >= 2**31)]
                if len(bad):
                    raise InvalidFile(f"a document of {bad[0]} bytes")
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(lengths.sum())])], ["range", "bytes"])

    sums = spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInArrow(run, "range long, bytes long").collect() if n else []
    plan, at = [], 0
    for k, own in sorted(map(tuple, sums)):
        plan.append([k * entries, min(n, (k + 1) * entries) - k * entries, at, at + own])
        at += own
    if at != total(corpus):
        raise InvalidFile(f"the index covers {at} of {total(corpus)} bytes")
    if not plan:
        return spark.createDataFrame([], _SCHEMA)
    spark.dataSource.register(IndexedCorpus)
    listed = {"ranges": plan} | {k: [[x.file, x.offset, x.size] for x in parts] for k, parts in (("index", index), ("corpus", corpus))}
    return spark.read.format("indexed_corpus").option("plan", json.dumps(listed)).load()


# reading tokens


class TokenRanges(DataSource):
    """Source of ``token_documents``, which plans it."""

    @classmethod
    def name(cls):
        return "token_ranges"

    def schema(self):
        return "range long, ends long" if self.options["count"] == "true" else "range long, place long, whole boolean, ids array<int>"

    def reader(self, schema):
        return _TokenReader(json.loads(self.options["plan"]), self.options["count"] == "true")


class _TokenReader(DataSourceReader):
    """Of each range of tokens the documents in it, and first and last what may be parts of documents.

    ``place`` counts the ends before a piece within its range. A piece is whole if it begins after an end in the
    range, or at the first token, and has its own.
    """

    def __init__(self, plan: dict, count: bool):
        self.plan, self.count = plan, count

    def partitions(self):
        parts, step, size = [Part(*x) for x in self.plan["parts"]], self.plan["step"], self.plan["size"]
        return [InputPartition((k, _within(parts, at, min(at + step, size)), at, min(at + step, size))) for k, at in enumerate(range(0, size, step))]

    def read(self, partition):
        import pyarrow as pa

        k, parts, begin, end = partition.value
        eos, held, place, ends = self.plan["eos"], np.zeros(0, np.int32), 0, 0
        names = ["range", "place", "whole", "ids"]

        def pieces(ids, stops, whole):
            offsets = np.append(0, stops).astype(np.int32)
            n = len(stops)
            flags = np.ones(n, bool)
            flags[0] = whole
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.arange(place, place + n)), pa.array(flags), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names)

        for at in range(begin, end, _BLOCK):
            ids = np.frombuffer(_read(parts, at, min(at + _BLOCK, end)), "<u2")
            if self.count:
                ends += int(np.count_nonzero(ids == eos))
                continue
            ids = np.concatenate([held, ids.astype(np.int32)])
            stops = np.flatnonzero(ids[len(held) :] == eos) + len(held) + 1
            if len(stops):
                yield pieces(ids[: stops[-1]], stops, bool(place or k == 0))
                place += len(stops)
                held = ids[stops[-1] :]
            else:
                held = ids
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([ends])], ["range", "ends"])
        elif len(held):
            yield pieces(held, np.array([len(held)]), False)


def token_documents(spark: SparkSession, parts: list[Part], eos: int, step: int = RANGE) -> DataFrame:
    """``doc_id`` (from 0, in order) and ``ids``, with its end, of each document of a stream of 16-bit tokens.

    A task reads ``step`` bytes; no document needs to fit into a range. Fails if the stream has an odd number of bytes
    or under two tokens, or ends inside a document.
    """
    size = total(parts)
    if size % 2 or size < 4:
        raise InvalidFile("a token file needs an even number of bytes and two tokens")
    if int.from_bytes(_read(parts, size - 2, size), "little") != eos:
        raise InvalidFile("a token file ends inside a document")
    step += step % 2
    spark.dataSource.register(TokenRanges)
    plan = json.dumps({"parts": [[x.file, x.offset, x.size] for x in parts], "step": step, "size": size, "eos": eos})
    source = spark.read.format("token_ranges").option("plan", plan)
    counts = source.option("count", "true").load()
    # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("ends").over(before), F.lit(0))).select("range", "before")
    pieces = source.option("count", "false").load().join(counts, "range").withColumn("doc_id", F.col("before") + F.col("place"))
    cut = pieces.where("NOT whole").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("range", "ids"))).alias("parts"))
    cut = cut.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return pieces.where("whole").select("doc_id", "ids").unionByName(cut)


def join_stream(spark: SparkSession, parts: list[Part], target: str) -> None:
    """One local file with the bytes of a stream, each range put into its place by a task; it appears when whole.

    ``target`` must be on a file system that the driver and all executors mount.
    """
    from corpusloom.sources.files import atomic

    with atomic(target) as part:
        with open(part, "wb") as f:
            f.truncate(total(parts))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in batch.column(0).to_pylist():
                    own = parts[i]
                    with open(part, "r+b") as f:
                        f.seek(own.offset)
                        for at in range(own.offset, own.offset + own.size, _BLOCK):
                            f.write(_read([own], at, min(at + _BLOCK, own.offset + own.size)))
                    yield pa.RecordBatch.from_arrays([pa.array([own.size])], ["bytes"])

        if parts:
            spark.range(0, len(parts), 1, min(len(parts), 10_000)).mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()
