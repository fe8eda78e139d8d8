"""Tables in hash buckets of a key, changed bucket by bucket.

A table is Parquet in folders `_bucket=k`. A merge reads only the buckets that the new
rows' keys fall in, writes their merged rows to the shared folder first and then over
those folders, by Spark's own dynamic partition overwrite; the other folders are neither
read nor written. A merge that is cut off leaves each bucket as it was or as it becomes,
and the same merge again gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.sources.tables import drop_table, materialize

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Nulls have buckets as well; keys have one type in the table and in what is merged."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> None:
    """A table by the buckets of its keys: each bucket is written by one task, so it is one file unless it is large."""
    rows = df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def merge_buckets(path: str, new: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """merge(old, new) on the buckets that new's keys fall in, in place; the buckets, at most `buckets` numbers.

    merge gives rows of the table's columns and of keys that one of the two has, such
    as `curate.upsert`. Rows it leaves out are gone, and a bucket that would be empty
    keeps a file without rows.
    """
    spark = new.sparkSession
    new = materialize(new)
    touched = sorted(r[0] for r in new.select(bucket_of(keys, buckets)).distinct().collect())
    if touched:
        stored = spark.read.parquet(path)
        columns = [c for c in stored.columns if c != BUCKET]
        old = stored.where(F.col(BUCKET).isin(touched)).select(*columns)  # pruned to these folders
        merged = materialize(merge(old, new).select(*columns))
        write_buckets(merged, path, keys, buckets, "overwrite")
        left = {r[0] for r in merged.select(bucket_of(keys, buckets)).distinct().collect()}
        for bucket in set(touched) - left:  # dynamic overwrite leaves a folder that gets no row as it was
            merged.limit(0).write.mode("overwrite").parquet(f"{path}/{BUCKET}={bucket}")
        drop_table(merged)
    drop_table(new)
    return touched
