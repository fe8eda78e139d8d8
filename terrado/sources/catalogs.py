"""Catalog files to frames: places by region, and flat name lists. Files are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrado.functions.text import place_key, strip


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one small file with their order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\R")).alias("ord", "line"))
    return whole.select(F.col("ord").cast("long").alias("ord"), "line")


def _first_by_key(rows: DataFrame, partition: list[str]) -> DataFrame:
    """One row per key: the first spelling."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy("ord"))
    return rows.where("key <> ''").withColumn("_n", place).where("_n = 1").drop("_n")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """key, canonical, kind, parent, ord of a tab-separated file of neighbourhoods and townships.

    Lines "Comuna:, name, Barrio:, name" give neighbourhoods, lines
    "Corregimiento:, name, Vereda:, name" the township; others are left out.
    """
    lines = _numbered(spark, path)
    cells = F.filter(F.transform(F.split("line", "\t"), strip), lambda c: c != "")
    rows = lines.select("ord", cells.alias("c")).where(F.size("c") >= 4)
    urban = (F.get("c", F.lit(0)) == "Comuna:") & (F.get("c", F.lit(2)) == "Barrio:")
    rural = (F.get("c", F.lit(0)) == "Corregimiento:") & (F.get("c", F.lit(2)) == "Vereda:")
    named = rows.where(urban | rural).select(
        "ord",
        F.when(urban, F.array_join(F.slice("c", 4, F.size("c")), " ")).otherwise(F.get("c", F.lit(1))).alias("canonical"),
        F.when(urban, "barrio").otherwise("corregimiento").alias("kind"),
        F.when(urban, F.get("c", F.lit(1))).alias("parent"),
    )
    return _first_by_key(named.withColumn("key", place_key(F.col("canonical"))), ["kind", "key"]).select("key", "canonical", "kind", "parent", "ord")


def read_names(spark: SparkSession, path: str, kind: str = "ph") -> DataFrame:
    """key, canonical, kind, parent, ord of a list with a name per line; blank lines and those that begin with # are left out."""
    rows = _numbered(spark, path).select("ord", strip(F.col("line")).alias("canonical")).where("canonical <> '' AND NOT startswith(canonical, '#')")
    keyed = rows.select(place_key(F.col("canonical")).alias("key"), "canonical", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("parent"), "ord")
    return _first_by_key(keyed, ["key"])
