"""Operators on ordered rows: run lengths, stops, keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_length(df: DataFrame, partition: list[str], order: list[Column], condition: Column, name: str = "racha") -> DataFrame:
    """For each row, how many rows in a row up to it meet the condition; 0 where it does not hold."""
    w = Window.partitionBy(*partition).orderBy(*order)
    holds = F.coalesce(condition, F.lit(False))
    islands = df.withColumn("_h", holds).withColumn("_g", F.sum(F.when(F.col("_h"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*partition, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum(F.col("_h").cast("long")).over(inside)).drop("_h", "_g")


def until_run(df: DataFrame, partition: list[str], order: list[Column], condition: Column, length: int) -> DataFrame:
    """Rows up to the one that completes the first run of `length`, that one included; all rows without such a run."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = run_length(df, partition, order, condition, "_run")
    stopped = F.coalesce(F.max(F.col("_run") >= length).over(w), F.lit(False))
    return counted.withColumn("_stop", stopped).where("NOT _stop").drop("_run", "_stop")


def before_mark(df: DataFrame, partition: list[str], order: Column, mark: Column) -> DataFrame:
    """Rows before the first marked one."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_m", F.max(F.coalesce(mark, F.lit(False))).over(w)).where("NOT _m").drop("_m")


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def newest_per_probe(pairs: DataFrame, probe: str, candidate: str, most: int = 1000) -> DataFrame:
    """The candidates of each probe with the highest ids."""
    place = F.row_number().over(Window.partitionBy(probe).orderBy(F.desc(candidate)))
    return pairs.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def best_per_identity(df: DataFrame, identity: list[str], order: Column, score: Column, value: str) -> DataFrame:
    """One row per identity: its best value, in the place where it first appears; of equal scores the first counts."""
    return df.groupBy(*identity).agg(F.min(order).alias("lugar"), F.max_by(value, F.struct(score, -order)).alias(value))


def newest_of_each(df: DataFrame, by: list[str], newest: Column, n: int, spread: Column, parts: int) -> DataFrame:
    """The n first rows of each key by `newest`, in two levels: of a key's rows in each of `parts` parts by `spread`, then of what those leave.

    A key with most of all rows is dealt to `parts` tasks; the second level sees at most n times parts rows of it.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(parts))
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(newest))
    some = df.withColumn("_part", part).withColumn("_place", place([*by, "_part"])).where(F.col("_place") <= n)
    return some.withColumn("_place", place(by)).where(F.col("_place") <= n).drop("_part", "_place")
