"""Rates over time, smoothed over the last intervals; as a window over a table, and as a listener of a stream."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Intervals of which a rate is the mean, the k-th of them with weight k.
INTERVALS = 20


def weighted(rates: Column) -> Column:
    """The mean of an array of rates, weighted by their places from 1; null rates have no weight, though a place."""
    part = lambda x, i: F.coalesce(x * (i + 1), F.lit(0.0))
    add = lambda s, x: s + x
    top = F.aggregate(F.transform(rates, part), F.lit(0.0), add)
    weights = F.aggregate(F.transform(rates, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0).cast("double")), F.lit(0.0), add)
    return F.when(weights > 0, top / weights).otherwise(F.lit(0.0))


def rolling_rates(df: DataFrame, by: list[str], seconds: Column, order: list[str], amount: str, intervals: int = INTERVALS) -> DataFrame:
    """``df`` with ``rate``: ``amount`` for each second, over the last ``intervals`` between rows of one ``by``.

    A row's interval is the time since the row before it, along ``order``; an interval that isn't positive counts for
    nothing. The first row of a series has no interval, so its rate is null.
    """
    along = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_at", seconds).withColumn("_gap", F.col("_at") - F.lag("_at").over(along)).withColumn("_place", F.row_number().over(along))
    own = F.when(F.col("_gap") > 0, F.col(amount) / F.col("_gap"))
    last = F.collect_list(F.struct(own.alias("r"), F.col("_place").alias("p"))).over(along.rowsBetween(-(intervals - 1), 0))
    known = F.transform(F.filter(last, lambda x: x["p"] > 1), lambda x: x["r"])
    return df.withColumn("rate", F.when(F.col("_place") > 1, weighted(known))).drop("_at", "_gap", "_place")


class RateListener(StreamingQueryListener):
    """Rows for each second of running queries, weighted like ``rolling_rates``; ``rates`` has one for each query."""

    def __init__(self, intervals: int = INTERVALS):
        self.intervals, self._rings = intervals, {}

    def add(self, query: str, rows: float, seconds: float) -> None:
        ring = self._rings.setdefault(query, deque(maxlen=self.intervals))
        ring.append(rows / seconds if seconds > 0 else None)

    def rate(self, query: str) -> float:
        found = [(x, k + 1) for k, x in enumerate(self._rings.get(query, ())) if x is not None]
        return sum(x * k for x, k in found) / sum(k for _, k in found) if found else 0.0

    @property
    def rates(self) -> dict[str, float]:
        return {query: self.rate(query) for query in self._rings}

    def onQueryStarted(self, event):
        self._rings[str(event.id)] = deque(maxlen=self.intervals)

    def onQueryProgress(self, event):
        progress = event.progress
        self.add(str(progress.id), progress.numInputRows, progress.batchDuration / 1000)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
