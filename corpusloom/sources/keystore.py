"""Stored sets of sample keys, so that a new corpus can leave out what earlier ones had.

A store is a folder of sorted Parquet files by bucket of the key's leading bits and by batch; a batch is what one corpus
added. Each bucket of a batch also has a Bloom filter. What a new corpus asks for is held against the filters first, in
the bucket's task, and only buckets in which something passed are read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.files import InvalidFile
from corpusloom.sources.shared import discard, exists, stored

#: Buckets, bits of a filter for each key, and places of a key.
BUCKETS, BITS, PLACES = 64, 10, 5


def signed_key(sample_key: Column) -> Column:
    """An unsigned 64-bit key as a long, which is cheaper to sort and join."""
    key = sample_key.cast("decimal(20,0)")
    return F.when(key >= F.lit(Decimal(2**63)), key - F.lit(Decimal(2**64))).otherwise(key).cast("long")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned("key", 32), F.lit(buckets)).cast("int")


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """The places of keys in a filter of ``size`` bits. Keys are bytes of a SHA-256, so products spread them."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB][:PLACES], np.uint64)
    return ((keys.view(np.uint64)[:, None] * odd) >> np.uint64(24)) % np.uint64(size)


def has_batch(spark: SparkSession, path: str, batch: int) -> bool:
    return exists(spark, f"{path}/keys/batch={batch}/_SUCCESS")


def append(index: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Add the keys of ``index`` (sample_key) as ``batch``, a number that the store doesn't have yet.

    Filters are written first: a batch that breaks off has none that keys lack, and may be added again.
    """
    spark = index.sparkSession
    if has_batch(spark, path, batch):
        raise InvalidFile(f"the store already has batch {batch}")
    keys = stored(index.select(signed_key(F.col("sample_key")).alias("key")).where("key IS NOT NULL").distinct().withColumn("bucket", _bucket(buckets)))

    def run(table):
        import pyarrow as pa

        keys = np.asarray(table["key"].combine_chunks(), np.int64)
        size = max(64, -(-len(keys) * BITS // 8) * 8)
        bits = np.zeros(size, bool)
        bits[_places(keys, size).ravel().astype(np.int64)] = True
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    keys.groupBy("bucket").applyInArrow(run, "bucket int, size long, bits binary").write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")
    keys.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={batch}")
    discard(keys)


def _passing(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """Keys that some batch's filter of their bucket lets through."""

    def run(left, right):
        keys = np.asarray(left["key"].combine_chunks(), np.int64) if left.num_rows else np.zeros(0, np.int64)
        through = np.zeros(len(keys), bool)
        for size, bits in zip(right["size"].to_pylist(), right["bits"].to_pylist()):
            own = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            through |= own[_places(keys, size).astype(np.int64)].all(axis=1)
        return left.filter(through)

    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "key long, bucket int")


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``bucket`` and ``batch`` of all that is stored."""
    return spark.read.schema("key long, bucket int, batch int").option("basePath", f"{path}/keys").parquet(f"{path}/keys")


def excluded(index: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``index`` whose sample key the store doesn't have; repeats among them stay.

    The numbers of touched buckets reach the driver, so that others aren't read.
    """
    spark = index.sparkSession
    index = index.withColumn("_key", signed_key(F.col("sample_key")))
    asked = index.select(F.col("_key").alias("key")).where("key IS NOT NULL").distinct().withColumn("bucket", _bucket(buckets))
    filters = spark.read.schema("bucket int, size long, bits binary, batch int").option("basePath", f"{path}/filters").parquet(f"{path}/filters")
    passing = stored(_passing(asked, filters))
    touched = sorted(x.bucket for x in passing.select("bucket").distinct().collect())
    held = stored_keys(spark, path).where(F.col("bucket").isin(touched)) if touched else stored_keys(spark, path).where("false")
    found = passing.join(held.select("key", "bucket"), ["bucket", "key"], "left_semi").select(F.col("key").alias("_key"))
    return index.join(found, "_key", "left_anti").drop("_key")
