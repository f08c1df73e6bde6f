"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node in ``links``.

    Each round gives a node the least label around it, then that label's own label, so paths halve. Every
    round is written to the shared folder. Links may repeat, in either direction; without links, no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = materialize(edges.union(edges.select("v", "u")).where("u <> v").distinct())
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("hooked"), "label")
        above = labels.select(F.col("node").alias("hooked"), F.col("label").alias("above"))
        new = hooked.join(above, "hooked", "left").select("node", F.least("hooked", "above").alias("label"), F.col("label").alias("was"))
        new = materialize(new)
        discard(labels)
        labels = new
        if new.where("label <> was").isEmpty():
            discard(edges)
            break
    out = labels.select("node", "label")
    out._stored = labels._stored
    return out
