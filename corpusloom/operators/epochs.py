"""Training batches with their contents, from any point of any epoch on.

A sampler's state is its epoch and its cursor. An epoch visits window (cursor * stride + start) mod chunks; the stride has
an inverse modulo the number of windows, so each window finds its own cursor, and one shuffle by ranges of places,
which are known before any row is read, brings the windows of a stretch into order. Nothing is looked up, and a resumed
run reads what an unbroken one would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import schedule as S


#: Windows in a range, unless a number of ranges is given.
RANGE = 1 << 17


@dataclass(frozen=True)
class State:
    """The next window that a sampler gives: its epoch and its place in the epoch."""

    epoch: int = 0
    cursor: int = 0

    def after(self, windows: int, chunks: int) -> State:
        at = self.epoch * chunks + self.cursor + windows
        return State(at // chunks, at % chunks)


def cursor_of(epoch: S.Epoch, window: Column) -> Column:
    """When an epoch visits a window: the inverse of ``Epoch.order``."""
    if epoch.chunks == 1:
        return F.lit(0).cast("long")
    inverse = pow(epoch.stride, -1, epoch.chunks)
    away = F.pmod(window - F.lit(epoch.start), F.lit(epoch.chunks))
    if epoch.chunks**2 < 1 << 63:
        return away.cast("long") * F.lit(inverse).cast("long") % F.lit(epoch.chunks)
    away = away.cast("decimal(19,0)")
    return (away * F.lit(inverse).cast("decimal(19,0)") % F.lit(epoch.chunks)).cast("long")


def batches(windows: DataFrame, chunks: int, seed: int, count: int, state: State = State(), batch: int = 4, accumulation: int = 4, ranges: int | None = None) -> tuple[DataFrame, State]:
    """The next ``count`` windows of a sampler with their contents, and the state after them.

    ``windows`` has window_id (0 to chunks - 1) and other columns, which stay. Adds ``epoch``, ``cursor``, ``update`` and
    ``microbatch``, counted from the first epoch on. Rows are in the order of the sampler across partitions and within.
    A stretch may span epochs; a window comes once in each.
    """
    if not 0 <= state.cursor < chunks or count < 1:
        raise ValueError("the cursor must be within the epoch, and some windows be asked for")
    first = state.epoch * chunks + state.cursor
    spans = S.epochs(seed, chunks, (first + count - 1) // chunks + 1)
    # a window is read once for all epochs
    visits = F.array(*(F.struct(F.lit(k).alias("epoch"), cursor_of(spans[k], F.col("window_id")).alias("cursor")) for k in range(state.epoch, len(spans))))
    place = F.col("epoch").cast("long") * F.lit(chunks) + F.col("cursor")
    rows = windows.select("*", F.inline(visits)).where((place >= first) & (place < first + count))
    ranges = min(ranges or -(-count // RANGE), count)
    # every place of the stretch is taken once, so equal ranges of places have equally many rows
    spread = rows.repartitionById(ranges, F.floor((place - first) / -(-count // ranges)).cast("int"))
    # one number is sorted by its digits, where an epoch and a cursor would be compared
    out = spread.sortWithinPartitions(place)
    out = out.withColumn("update", F.floor(place / (batch * accumulation))).withColumn("microbatch", F.floor(place / batch))
    return out, state.after(count, chunks)
