"""A uniform shuffle of all rows in two passes, cut into shards.

Pass 1 scatters the records into buckets that fit in memory, by a seeded hash of what identifies a record.
Pass 2 shuffles each bucket by Fisher-Yates, with numbers drawn from the seed and the bucket's own number, and gives
its records their places. So the order is a function of seed and records, however many tasks there are. Both passes
use DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import sums_before

#: Bytes and rows in a bucket, on average, at most.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 4096


def size_of(text_col: str):
    """Bytes of the text in UTF-8 (null: none) plus 8."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0 to n - 1 as an array, for n from 1 on, by the inside-out form of the shuffle.

    Step i puts i where a number drawn from 0 to i says, and what stood there at the end. Steps copy the array, so
    buckets hold a few thousand rows.
    """

    def step(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int")
        swapped = lambda j: F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)))
        return F.get(F.transform(F.array(j), lambda j: F.when(j == i, F.concat(a, F.array(i))).otherwise(swapped(F.least(j, i - 1)))), 0)

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(F.lit(0)), step)


def shuffled(df: DataFrame, record: list[str], text_col: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df``'s rows in a seeded uniform order, as ``place`` (long, from 0 without gaps).

    ``record`` names the columns that tell records apart; they decide a record's bucket and the order that
    Fisher-Yates starts from, so that places depend on the rows and the seed alone. Rows equal in all of them share
    a bucket: give a column that differs, such as the place in the file, if they may be many. A bucket is held as one
    row, so that it is as large as its longest text at least; a very long text is one like any other. Nulls in any
    column count as values. An empty table gives an empty result. A column named ``place`` is replaced.
    """
    df = df.drop("place")
    bytes_, rows = df.agg(F.sum(size_of(text_col)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((bytes_ or 0) / bucket_bytes), math.ceil(rows / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *record), F.lit(buckets)).cast("int")
    counts = df.groupBy(bucket.alias("_number")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sums_before(counts, "_n", ["_number"], F.floor(F.col("_number") / 4096), name="_before").drop("_n")
    row = F.struct(*(F.col(c) for c in record), *(F.col(c) for c in df.columns if c not in record))
    held = df.select(bucket.alias("_number"), row.alias("_row")).groupBy("_number").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    held = held.select("_number", "_rows", fisher_yates(F.size("_rows"), seed, F.col("_number")).alias("_order"))
    dealt = held.join(offsets, "_number").select("_before", "_rows", F.posexplode("_order").alias("_at", "_from"))
    dealt = dealt.select((F.col("_before") + F.col("_at")).alias("place"), F.get("_rows", F.col("_from")).alias("_row"))
    return dealt.select(*(F.col("_row")[c].alias(c) for c in df.columns), "place")


def sharded(df: DataFrame, record: list[str], shards: int, text_col: str = "text", seed: int = 42) -> DataFrame:
    """``df`` shuffled and dealt out: ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps).

    The counts of any two shards differ by one at most. Columns named shard or slot are replaced.
    """
    out = shuffled(df.drop("shard", "slot"), record, text_col, seed)
    return out.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long")).drop("place")


def write_shards(out: DataFrame, path: str) -> None:
    """Write sharded rows as Parquet, a folder for each shard, in the order of their slots."""
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards whose counts differ by one at most."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    out = sharded(docs, ["doc_id", "_file", "_index"], 24)
    return out.select(
        "doc_id",
        size_of("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    """What the law ``rows`` comes to: the rows of each shard, and that their slots have no gaps."""
    out = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last_slot"))
    return out


_SIZES = """
WITH total AS (SELECT count(*) AS n FROM documents), shards AS (SELECT CAST(s AS INT) AS shard, (n - s + 23) // 24 AS rows FROM total, range(0, 24) t(s))
SELECT shard, rows, rows AS slots, rows - 1 AS last_slot FROM shards WHERE rows > 0
"""

QUERIES = {"op6_sharding": op6_sharding, "shard_sizes": shard_sizes}
ORACLE_SQL = {"shard_sizes": _SIZES}
