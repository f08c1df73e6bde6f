"""Running sums over rows in an order, without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.shared import stored


def sums_along(df: DataFrame, value: str, order: list, by: list[str] = (), name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (an integer) over earlier rows of the same ``by``.

    Rows are sorted in ranges, whatever their keys look like. A task sums along its own range while it writes the rows,
    and a row for each range, and each ``by`` in it, says what the ranges before have. Rows travel once.
    """
    by = list(by)
    names = df.columns
    at, groups = names.index(value), [names.index(c) for c in by]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = np.asarray(pc.fill_null(batch.column(at), 0), np.int64)
            new = np.zeros(n, bool)
            keys = [pc.fill_null(pc.cast(batch.column(k), pa.string()), "\0") for k in groups]
            for key in keys:
                new[1:] |= np.asarray(pc.not_equal(key[1:], key[:-1]))
            first = tuple(key[0].as_py() for key in keys)
            sums = np.cumsum(own) - own
            # what stands before the first row of each row's group; the batch's first group goes on from the last
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            before = sums - sums[start]
            if first == last:
                before[: int(np.argmax(new)) if new.any() else n] += total
            last, total = tuple(key[n - 1].as_py() for key in keys), int(before[-1] + own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(n, part, np.int32))], schema.names)

    schema = T.StructType([*df.schema.fields, T.StructField("_within", T.LongType()), T.StructField("_part", T.IntegerType())])
    order = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    totals = rows.groupBy("_part", *by).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    same = rows["_part"] == start["_of"]
    for c in by:
        same &= rows[c].eqNullSafe(start[f"_by_{c}"])
    out = rows.join(start, same)
    return out.select(*names, (F.col("_start") + F.col("_within")).cast("long").alias(name))


def sums_before(df: DataFrame, value: str, order: list, bucket: Column, by: list[str] = (), name: str = "before") -> DataFrame:
    """The same for rows that already come in small buckets: ``bucket`` never falls along ``order``.

    Rows are summed within their bucket; only the buckets' totals are summed across.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = total.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(start, keys)
    return df.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_bucket", "_start", "_within")
