"""Packing documents into sequences of a fixed number of tokens, by linear grouping and best fit.

The work on all documents is tokenizing, counting lengths, and looking up places. The packing itself needs
the histogram of the lengths alone, which has as many rows as a sequence has tokens, whatever the corpus:

1. Large lengths, in falling order, are cut into groups of equal cardinality, and each is rounded up to the
   greatest of its group, so that no more sizes than groups remain.
2. Configurations, multisets of these sizes that fill a sequence, are optimised: a linear programme asks for
   the fewest sequences that hold all, and its columns are priced by a knapsack, so that only configurations
   that help are ever looked at. Few sizes make it small. Each is used as often as its whole part says.
3. The rounded sizes give way to the actual lengths of their groups.
4. Small lengths, and the few large ones that whole parts leave over, go where they fit best, longest first,
   then into new sequences.

The outcome says how many sequences hold which lengths. The n-th document of a length takes the n-th place
for that length.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ByWords, Kept, kept_in_worker, materialize, small_batches

CAPACITY, END_ID = 1024, 2
#: How many groups the large lengths make, and from which part of the capacity down lengths are small. All are
#: tried, and the one with the fewest sequences is taken.
SETTINGS = ((64, 2), (64, 3), (32, 4))
#: Columns that are priced at most; with fewer than the best ones, the programme's outcome is still a packing.
COLUMNS = 600
#: Words kept with their ids in a worker.
CACHE_ENTRIES = 600_000


def byte_letters() -> dict[str, str]:
    """The printable character that byte-level vocabularies write for each byte, given as a Latin-1 character.

    Printable bytes stand for themselves; the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(others)}


#: What a byte-level pre-tokenizer makes of "a b'll 1".
BYTE_LEVEL = [("a", (0, 1)), ("Ġb", (1, 3)), ("'ll", (3, 6)), ("Ġ1", (6, 8))]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, as the tokenizer file gives them.

    Without special tokens being added; their strings in a text are their ids, unless ``plain``.
    """

    def __init__(self, path: str, plain: bool = False):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain
        self.added = () if plain else tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
        self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        model, pattern = tokenizer.model, regex.compile(public_tokenizers.PATTERN)
        if json.loads(tokenizer.to_str())["normalizer"] is None and tokenizer.pre_tokenizer.pre_tokenize_str("a b'll 1") == BYTE_LEVEL:
            # the model's own form of one piece: a character for each byte
            letters = {ord(k): v for k, v in byte_letters().items()}
            piece = lambda text: np.array([x.id for x in model.tokenize(text.encode().decode("latin-1").translate(letters))], "<u4").tobytes()
            pieces = Kept(piece, CACHE_ENTRIES)
            self.by_words = ByWords(piece, lambda text: b"".join(map(pieces.__getitem__, pattern.findall(text))), CACHE_ENTRIES)
        else:
            self.by_words = self.encode

    def __call__(self, text: str) -> bytes:
        return self.encode(text) if any(x in text for x in self.added) else self.by_words(text)


def encoder(path: str | None = None) -> Encoder:
    import public_tokenizers

    return kept_in_worker(("packing", path), lambda: Encoder(path or public_tokenizers.path("byte_bpe_50k.json")))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``id_col``, piece, start, length, ids_crc32, and ``ids`` if asked for.

    A document is its text's ids and END_ID; a null text is empty. Only a longer one than ``capacity`` is
    cut, into pieces of ``capacity`` but for the first, which takes the rest. Rows are cut one by one: ids
    may repeat or be null; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + end
                n = len(data) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(cuts) - 1):
                    own = data[4 * cuts[k] : 4 * cuts[k + 1]]
                    rows.append(row)
                    number.append(k)
                    start.append(cuts[k])
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    names = schema.names
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality over lengths in falling order: (greatest length, [(length, count)]).

    Neighbours with the same greatest length are one group.
    """
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                room = each
                if not (out and out[-1][0] == length):
                    out.append((length, []))
            take = min(left, room)
            members = out[-1][1]
            if members and members[-1][0] == length:
                members[-1] = (length, members[-1][1] + take)
            else:
                members.append((length, take))
            left -= take
            room -= take
    return out


def _best_column(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration that is worth most: its worth, and how many of each size it holds."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        total = worth[room - sizes[fits]] + value[fits]
        best = int(total.argmax())
        if total[best] > worth[room - 1]:
            worth[room], chosen[room] = total[best], fits[best]
        else:
            worth[room] = worth[room - 1]
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            column[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(worth[capacity]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, columns: int = COLUMNS) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often to use which configuration: [(times, [(place in sizes, how many)])].

    The basic solution of the linear programme of fewest sequences that hold ``demand``, by column generation;
    times are its whole parts, so some of the demand may be left. Nothing is used beyond the demand.
    """
    m = len(sizes)
    if not m:
        return []
    size = np.array(sizes, np.int64)
    each = (capacity // size).astype(float)
    basis, inverse = np.diag(each), np.diag(1 / each)
    # a little more of each breaks ties, so that no two bases are equally good
    want = np.array(demand, float)
    want += (np.arange(m) + 1) * 1e-7 * want.max()
    for turn in range(columns):
        worth, column = _best_column(size, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-9:
            break
        direction, now = inverse @ column, inverse @ want
        ratio = np.where(direction > 1e-9, now / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if turn % 100 == 99:
            inverse = np.linalg.inv(basis)  # what rounding has added up
    often = np.linalg.solve(basis, np.array(demand, float))
    left, found = list(demand), []
    for j in np.argsort(-often, kind="stable").tolist():
        held = [(k, int(n)) for k, n in enumerate(np.rint(basis[:, j])) if n > 0]
        times = min([math.floor(often[j] + 1e-6), *(left[k] // n for k, n in held)])
        if times > 0:
            found.append((times, held))
            for k, n in held:
                left[k] -= n * times
    return found


def packed(counts: dict[int, int], capacity: int = CAPACITY, settings=SETTINGS) -> list[tuple[int, tuple[int, ...]]]:
    """The outcome of ``grouped_packing`` for that one of the settings that needs the fewest sequences."""
    tried = (grouped_packing(counts, capacity, groups, small) for groups, small in settings)
    return min(tried, key=lambda classes: sum(n for n, _ in classes))


def grouped_packing(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths that each of them holds), for ``counts`` by length.

    Lengths are from 1 to ``capacity``. The outcome depends on the counts alone.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    counts = {length: n for length, n in counts.items() if n}
    limit = capacity // small
    found = grouped({x: n for x, n in counts.items() if x > limit}, groups)
    sizes, queues = [x for x, _ in found], [list(reversed(members)) for _, members in found]
    demand = [sum(n for _, n in members) for _, members in found]
    classes: list[tuple[int, tuple[int, ...]]] = []
    rest = {x: n for x, n in counts.items() if x <= limit}
    for times, chosen in configurations(sizes, demand, capacity):
        slots = [k for k, n in chosen for _ in range(n)]
        # each slot takes the next actual lengths of its group
        runs = []
        for k in slots:
            need, run = times, []
            while need:
                length, n = queues[k].pop()
                take = min(n, need)
                run.append([length, take])
                need -= take
                if n > take:
                    queues[k].append((length, n - take))
            runs.append(run[::-1])
        while times:
            n = min(run[-1][1] for run in runs)
            classes.append((n, tuple(run[-1][0] for run in runs)))
            times -= n
            for run in runs:
                run[-1][1] -= n
                if not run[-1][1]:
                    run.pop()
    for queue in queues:
        for length, n in queue:
            rest[length] = rest.get(length, 0) + n
    return _best_fit(classes, rest, capacity)


def _best_fit(classes: list[tuple[int, tuple[int, ...]]], counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``classes`` with the lengths in ``counts``, longest first, each where it leaves the least room."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, held in classes:
        by_room.setdefault(capacity - sum(held), []).append((n, held))
    rooms = sorted(by_room)

    def put(room: int, entry: tuple[int, tuple[int, ...]]) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        by_room[room].append(entry)

    for length in sorted(counts, reverse=True):
        need = counts[length]
        while need:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, held = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, n, held = capacity, need, ()
            # the sequence that a length has joined stays the tightest as long as one more fits
            each = room // length
            full = min(n, need // each)
            if full:
                put(room - each * length, (full, held + (length,) * each))
                need -= full * each
                n -= full
            if n and need and need < each:
                put(room - need * length, (1, held + (length,) * need))
                n -= 1
                need = 0
            if n and held:
                put(room, (n, held))
    return [entry for room in rooms for entry in by_room[room]]


def places(classes: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, sequence, copies, offset): the places of the first-th up to the end-th of a length."""
    out, used, sequence = [], {}, 0
    for n, held in classes:
        offset = 0
        for length in sorted(set(held), reverse=True):
            copies = held.count(length)
            first = used.get(length, 0)
            used[length] = first + n * copies
            out.append((length, first, used[length], sequence, copies, offset))
            offset += copies * length
        sequence += n
    return out


def placed(made: DataFrame, capacity: int = CAPACITY, settings=SETTINGS) -> DataFrame:
    """``made``, rows with a ``length`` from 1 to ``capacity``, with ``sequence_id`` and ``offset``.

    Every row has its place; the places of a sequence follow without gaps from 0. Which of several rows of
    one length takes which place goes by where they stand in the files of the table that is written here.
    An empty table gives an empty result; columns with these names are replaced.
    """
    spark = made.sparkSession
    held = materialize(made.drop("sequence_id", "offset"))
    names = held.columns
    held = held.select(F.struct(*names).alias("_row"), F.col("length").alias("_length"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    by_file = held.groupBy("_length", "_file").agg(F.count(F.lit(1)).alias("_n"))
    counts = {row["_length"]: row.n for row in by_file.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    table = places(packed(counts, capacity, settings))
    earlier = Window.partitionBy("_length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = by_file.select("_length", "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_length", "_file").orderBy("_index"))
    ordinal = held.withColumn("_within", within).join(before, ["_length", "_file"]).withColumn("_at", F.col("_before") + F.col("_within") - 1)
    # its size follows from the capacity and the groups, not from the corpus
    table = F.broadcast(spark.createDataFrame(table, "_l long, _first long, _end long, _sequence long, _copies long, _offset long"))
    on = (F.col("_length") == F.col("_l")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))
    step = F.col("_at") - F.col("_first")
    sequence = F.col("_sequence") + F.floor(step / F.col("_copies")).cast("long")
    return ordinal.join(table, on).select(*(F.col("_row")[c].alias(c) for c in names), sequence.alias("sequence_id"), (F.col("_offset") + step % F.col("_copies") * F.col("_length")).alias("offset"))


def sequences(placed_ids: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids``: the sequences themselves, from placed pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    from .common import read

    return placed(pieces(read(spark, sf_dir, "documents")))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
