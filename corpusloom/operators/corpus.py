"""From rows of text to an indexed corpus: filter, identify, split, exclude, sample and count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import identity as I


def extract(df: DataFrame) -> DataFrame:
    """Rows with a text that is neither null nor empty."""
    return df.where("text IS NOT NULL AND text <> ''")


def indexed(df: DataFrame) -> DataFrame:
    """``df`` with doc_bytes, is_validation and sample_key; a missing url counts as null."""
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    df = extract(df).withColumn("_digest", I.digest(I.identity(url, F.col("text"))))
    made = {"doc_bytes": I.framed_bytes(F.col("text")), "is_validation": I.is_validation(F.col("_digest")), "sample_key": I.sample_key(F.col("_digest"))}
    return df.withColumns(made).drop("_digest")


def excluded(index: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows of an index whose sample key no prior index has. Repeats inside the new one stay."""
    return index.join(prior.select("sample_key").distinct(), "sample_key", "left_anti")


def tokenizer_sample(index: DataFrame, target_bytes: int) -> DataFrame:
    """Training rows of about ``target_bytes``, by their keys."""
    total = index.agg(F.sum("doc_bytes")).first()[0] or 0
    cutoff = I.sample_cutoff(target_bytes, total)
    return index.where(~F.col("is_validation") & (F.col("sample_key") <= F.lit(cutoff).cast("decimal(20,0)")))


def checked_ids(ids, limit: int = 65536):
    """``ids``, or an error if one can't be an unsigned 16-bit integer."""
    good = F.forall(ids, lambda x: (x >= 0) & (x < limit))
    return F.when(F.coalesce(good, F.lit(True)), ids).otherwise(F.raise_error(F.lit("a token id is out of range")).cast("array<int>"))
