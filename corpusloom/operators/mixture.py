"""Blending documents of several sources in weighted shares, whole documents at a time.

The next document comes from the source with the least emitted tokens for its weight. That order is the
order of (tokens before the document in its source / weight, source, document), so a sort replaces the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import sums_along

def feasible(docs: DataFrame, target) -> DataFrame:
    """For each source: tokens, the share of ``target`` it must give at least, and whether it can."""
    every = docs.groupBy("source_index").agg(F.first("source").alias("source"), F.first("weight").alias("weight"), F.sum("tokens").alias("tokens"))
    total = every.agg(F.sum("weight").alias("all"))
    share = F.floor(F.lit(target) * (F.col("weight") / F.col("all"))).cast("long")
    return every.join(F.broadcast(total)).select("source", "tokens", share.alias("required"), (F.col("tokens") >= share).alias("is_feasible"))

def mixed(docs: DataFrame, target: int) -> DataFrame:
    """Documents of the mixture, with ``before``, the tokens ahead of each.

    ``docs`` has doc_id (a rising integer), source_index, weight (positive) and tokens (positive). The last
    document stays whole, so the mixture may exceed ``target``. The query fails if a source runs out first.
    """
    if target < 1:
        raise ValueError("the target must be positive")
    rows = sums_along(docs.select("doc_id", "source_index", "weight", F.col("tokens").cast("long").alias("tokens")), "tokens", ["doc_id"], ["source_index"], "own")
    # one row without tokens at the end of each source says where it runs out
    ends = rows.groupBy("source_index").agg(F.max("weight").alias("weight"), F.max(F.col("own") + F.col("tokens")).alias("own"))
    ends = ends.select("source_index", "weight", "own", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("doc_id"))
    rows = rows.select("source_index", "weight", "own", "tokens", F.col("doc_id").cast("long").alias("doc_id")).union(ends.select("source_index", "weight", "own", "tokens", "doc_id"))
    rows = rows.withColumn("score", F.col("own") / F.col("weight"))

    rows = sums_along(rows, "tokens", ["score", "source_index", F.col("doc_id").asc_nulls_last()])
    out = rows.where(F.col("before") < target)
    known = F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.raise_error(F.lit("a source ended before the mixture was complete")).cast("long"))
    return out.select(known.alias("doc_id"), "source_index", "tokens", "before")
