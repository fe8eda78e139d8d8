"""Parquet tables, appends and small shared settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only where it names none, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = context.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the table stands in for the shuffle files that it was made from
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # noqa: SLF001
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns that a table should have and has not."""
    return [n for n in names if n not in df.columns]


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
