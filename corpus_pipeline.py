"""From raw documents to packed sequences: each stage works on what the one before has kept.

Every stage takes (spark, docs, sf_dir). All but the last return rows with the columns of ``docs``, which are
those of ``documents``. Stages go by rows: ids may repeat or be null, equal rows are treated alike, columns that
a stage doesn't know pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import minhash, packing, quality, secret_scan, suffix_dedup
from corpusloom.llm.common import contained, discard, read


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; weights come from all of ``docs``."""
    return quality.kept_rows(docs, quality.learnt(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least id. Different documents with one id all stay."""
    return minhash.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat elsewhere. All documents stay."""
    return _counted(suffix_dedup.trimmed(docs)).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out. All documents stay."""
    return _counted(secret_scan.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null text is empty: one piece."""
    return packing.placed(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("packing", best_fit_packing),
]

#: SQL has neither the hashes nor the tokenizer that the stages need.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        # a stage's own tables and the rows it read go once its result is stored
        done, docs = docs, contained(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        discard(done)
    return last(spark, docs, sf_dir)
