"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only on a local master."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hold the Arrow batches that Python workers get to ``rows`` rows and 8 MB, so that long texts fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stored(df: DataFrame, group: int = 0) -> DataFrame:
    """``df``, written as Parquet into the shared folder and read back.

    This cuts the lineage in storage that outlives any executor. The files go with ``discard``, or when the
    driver ends. Writers and readers hold a row group in memory: ``group`` bounds its bytes for tables of large rows,
    of which Parquet else takes a hundred before it looks at their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write
    if group:
        writer = writer.options(**{"parquet.block.size": str(group), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"})
    writer.parquet(path)
    _STORED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` made and that nothing will read any more."""
    for table in tables:
        if path := getattr(table, "_stored", None):
            _remove(path)


def _remove(path: str) -> None:
    spark = _STORED.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_STORED):
        _remove(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for files that go when the driver ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    _STORED[path] = spark
    return path
