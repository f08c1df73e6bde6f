"""Fingerprints of tables as multisets: they don't depend on the order of rows or on how rows are spread.

A row's SHA-256 is read as four numbers, and numbers are added up by lane. So sums of parts add up to the sum of the
whole, a row that is there twice counts twice, and the sums are formed in the tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns' values in hex; values are told apart by their lengths, and nulls from empty ones."""
    text = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns)).cast("binary"), 256)


def lane_sums(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """``by``, ``rows`` and ``s0`` to ``s3``, the sums of the lanes; may be added up further."""
    digest = df.select(*by, row_digest(*columns).alias("_digest"))
    lane = lambda k: F.conv(F.substring("_digest", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    return digest.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(lane(k)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(LANES)))


def merged(sums: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sums of parts, such as days or shards, added up."""
    return sums.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.sum(f"s{k}").cast("decimal(38,0)").alias(f"s{k}") for k in range(LANES)))


def fingerprints(sums: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by``, ``rows`` and ``fingerprint``, in hex, of what ``lane_sums`` or ``merged`` gives."""
    whole = F.concat_ws("|", F.col("rows").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(LANES)))
    return sums.select(*by, "rows", F.sha2(whole.cast("binary"), 256).alias("fingerprint"))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """The fingerprint of a whole table."""
    return fingerprints(lane_sums(df, columns)).first().fingerprint
