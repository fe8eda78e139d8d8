"""The driver's tables in the shape of listings, sources, edges and evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries, SQL and a decorator that registers a query under its name with its SQL."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as listings: id, fuente_id, fecha_captura, precio, tipo_inmueble, barrio, habitaciones, banios, parqueadero, m2, ph, notas."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("fuente_id"),
        F.col("o_orderdate").alias("fecha_captura"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("precio"),
        F.col("o_orderpriority").alias("tipo_inmueble"),
        F.when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("Barrio Ñ"), (k % 17).cast("string"))).alias("barrio"),
        (k % 6).cast("int").alias("habitaciones"),
        (k % 4).cast("int").alias("banios"),
        (k % 3).cast("int").alias("parqueadero"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(k % 400).cast("decimal(10,2)").alias("m2"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Torre "), (k % 9).cast("string"))).alias("ph"),
        F.when(k % 10 == 0, F.concat(F.lit("nota "), k.cast("string"))).alias("notas"),
    )


LISTINGS_SQL = """listings AS (
  SELECT o_orderkey AS id, o_custkey AS fuente_id, o_orderdate AS fecha_captura, CAST(o_totalprice AS DECIMAL(15,2)) AS precio, o_orderpriority AS tipo_inmueble,
    CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Barrio Ñ' || CAST(o_orderkey % 17 AS VARCHAR) END AS barrio,
    CAST(o_orderkey % 6 AS INTEGER) AS habitaciones, CAST(o_orderkey % 4 AS INTEGER) AS banios, CAST(o_orderkey % 3 AS INTEGER) AS parqueadero,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS DECIMAL(10,2)) END AS m2,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Torre ' || CAST(o_orderkey % 9 AS VARCHAR) END AS ph,
    CASE WHEN o_orderkey % 10 = 0 THEN 'nota ' || CAST(o_orderkey AS VARCHAR) END AS notas
  FROM orders)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive orders of one customer as match edges."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = o.withColumn("n", following).where("n IS NOT NULL")
    a = F.col("o_orderkey")
    state = F.when(a % 5 == 0, "descartada").when(a % 3 == 0, "confirmada").otherwise("pendiente")
    return e.select(a.alias("id"), a.alias("publicacion_id"), F.col("n").alias("candidata_id"), (60 + a % 40).cast("decimal(5,2)").alias("puntaje"), state.alias("estado"), (a % 4).cast("int").alias("imagenes_coincidentes"))


EDGES_SQL = """edges AS (
  SELECT o_orderkey AS id, o_orderkey AS publicacion_id, n AS candidata_id, CAST(60 + o_orderkey % 40 AS DECIMAL(5,2)) AS puntaje,
    CASE WHEN o_orderkey % 5 = 0 THEN 'descartada' WHEN o_orderkey % 3 = 0 THEN 'confirmada' ELSE 'pendiente' END AS estado, CAST(o_orderkey % 4 AS INTEGER) AS imagenes_coincidentes
  FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n IS NOT NULL)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"))
