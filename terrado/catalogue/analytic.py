"""Dashboard and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import EDGES_SQL, LISTINGS_SQL, edges, listings, registry, table
from terrado.operators import analytics, matches, search

QUERIES, SQL, query = registry()
NOW = "1998-06-15 12:00:00"


@query(f"""WITH {LISTINGS_SQL} SELECT count(*) AS n, round(avg(CAST(precio AS DOUBLE)), 4) AS precio_promedio, round(median(CAST(precio AS DOUBLE)), 4) AS precio_mediano, round(avg(CAST(m2 AS DOUBLE)), 4) AS area_promedio, max(fecha_captura) AS ultima_captura FROM listings""")
def avg_median_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).withColumn("precio_m2", F.lit(None).cast("decimal(15,0)"))
    s = analytics.summary(rows.withColumns({c: F.col(c).cast("double") for c in ("precio", "m2")}))
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("precio_promedio", "precio_mediano", "area_promedio")], "ultima_captura")


@query(f"""WITH {LISTINGS_SQL}, g AS (SELECT coalesce(nullif(trim(barrio), ''), 'Sin barrio') AS label, count(*) AS n, min(id) AS f FROM listings GROUP BY 1) SELECT label, n AS count FROM g ORDER BY n DESC, f LIMIT 7""")
def group_count_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.count_by(listings(spark, sf), analytics.labelled(F.col("barrio"), "Sin barrio"), [F.col("id")], 7)


@query("SELECT label, count FROM (SELECT event_type AS label, count(*) AS count, min(event_id) AS f FROM events GROUP BY 1) ORDER BY count DESC, f LIMIT 1")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.count_by(table(spark, sf, "events"), analytics.labelled(F.col("event_type")), [F.col("event_id")], 1)


@query("SELECT count(DISTINCT nullif(trim(p_brand), '')) AS n FROM part")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").agg(F.countDistinct(analytics.blank_to_null(F.col("p_brand"))).alias("n"))


@query("""SELECT CASE WHEN p IS NULL THEN 'Sin precio' WHEN p <= 100000000 THEN 'Hasta 100M' WHEN p <= 200000000 THEN '100M a 200M' WHEN p <= 400000000 THEN '200M a 400M' ELSE 'Mas de 400M' END AS rango, count(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice * 1000 END AS p FROM orders) GROUP BY 1""")
def price_buckets(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") * 1000)
    return table(spark, sf, "orders").groupBy(analytics.price_range(p).alias("rango")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT CAST(d AS DATE) AS mes FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-06-01', INTERVAL 1 MONTH) t(d))
SELECT m.mes, count(o.o_orderkey) AS n FROM m LEFT JOIN orders o ON CAST(date_trunc('month', o.o_orderdate) AS DATE) = m.mes GROUP BY m.mes""")
def monthly_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.monthly(table(spark, sf, "orders"), "o_orderdate", NOW)


@query("SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 7 DAYS) AS n FROM orders")
def rolling_7d(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.recent(table(spark, sf, "orders"), "o_orderdate", NOW)


@query(f"""WITH {LISTINGS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE trim(coalesce(barrio, '')) <> '') AS b, count(m2) AS a, count(*) FILTER (WHERE trim(coalesce(notas, '')) <> '') AS t FROM listings)
SELECT n, b AS con_barrio, n - b AS sin_barrio, CAST(floor(b * 100.0 / n + 0.5) AS BIGINT) AS pct_barrio, a AS con_area, n - a AS sin_area, CAST(floor(a * 100.0 / n + 0.5) AS BIGINT) AS pct_area, t AS con_notas, n - t AS sin_notas, CAST(floor(t * 100.0 / n + 0.5) AS BIGINT) AS pct_notas FROM c""")
def quality_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).withColumns({"coordenadas": F.lit(None).cast("string"), "latitud": F.lit(None).cast("double"), "longitud": F.lit(None).cast("double"), "precio_m2": F.lit(None).cast("double")})
    kept = [f"{p}_{k}" for k in ("barrio", "area", "notas") for p in ("con", "sin", "pct")]
    return analytics.quality(rows).select("n", *kept)


@query("""SELECT 'min' AS cual, p_partkey, p_retailprice, p_name FROM (SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) UNION ALL SELECT 'max', p_partkey, p_retailprice, p_name FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1)""")
def min_max_listing(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.extremes(table(spark, sf, "part"), "p_retailprice", "p_partkey", ["p_name"])


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS "view", count(*) AS total FROM events GROUP BY user_id""")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.status_by_source(table(spark, sf, "events"), "user_id", "event_type", ("click", "view"))


@query("""SELECT user_id AS corrida, count(*) AS paginas, count(*) FILTER (WHERE e <> 'ok') AS fallidas, count(*) FILTER (WHERE e = 'ok' AND l = 0) AS vacias, CAST(sum(l) AS BIGINT) AS links, CAST(sum(l % 3) AS BIGINT) AS nuevos, CAST(sum(l % 2) AS BIGINT) AS repetidos
FROM (SELECT user_id, CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'ok' END AS e, event_id % 4 AS l FROM events) GROUP BY 1""")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.audit(_crawls(spark, sf))


def _crawls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("corrida"), k.alias("pagina"), F.when(k % 6 == 0, "error").otherwise("ok").alias("estado"), (k % 4).alias("links"), (k % 4 % 3).alias("nuevos"), (k % 4 % 2).alias("repetidos"), F.when(k % 12 == 0, "tiempo").alias("motivo")
    )


@query("""WITH x AS (SELECT user_id AS corrida, event_id AS p, CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'ok' END AS e, event_id % 4 AS l, CASE WHEN event_id % 12 = 0 THEN 'tiempo' END AS m FROM events),
f AS (SELECT corrida, count(*) AS n, string_agg(CAST(p AS VARCHAR) || ' (' || coalesce(m, 'sin detalle') || ')', ', ' ORDER BY p) FILTER (WHERE r <= 5) AS s FROM (SELECT *, row_number() OVER (PARTITION BY corrida ORDER BY p) AS r FROM x WHERE e <> 'ok') GROUP BY 1),
v AS (SELECT corrida, count(*) AS n, string_agg(CAST(p AS VARCHAR), ', ' ORDER BY p) FILTER (WHERE r <= 8) AS s FROM (SELECT *, row_number() OVER (PARTITION BY corrida ORDER BY p) AS r FROM x WHERE e = 'ok' AND l = 0) GROUP BY 1),
d AS (SELECT corrida, sum(l % 2) AS n FROM x GROUP BY 1)
SELECT d.corrida, array_to_string(list_filter([CASE WHEN f.n > 0 THEN CAST(f.n AS VARCHAR) || ' paginas fallidas: ' || f.s END, CASE WHEN v.n > 0 THEN CAST(v.n AS VARCHAR) || ' paginas vacias: ' || v.s END, CASE WHEN d.n > 0 THEN CAST(d.n AS VARCHAR) || ' links repetidos' END], lambda z: z IS NOT NULL), '|') AS motivos
FROM d LEFT JOIN f USING (corrida) LEFT JOIN v USING (corrida)""")
def coverage_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.coverage_reasons(_crawls(spark, sf)).select("corrida", F.array_join("motivos", "|").alias("motivos"))


@query(f"""WITH {LISTINGS_SQL} SELECT bool_or(trim(coalesce(barrio, '')) = '') AS barrio_vacio, bool_or(trim(coalesce(ph, '')) = '') AS ph_vacio FROM listings""")
def blank_flags(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.blank_flags(listings(spark, sf), ["barrio", "ph"])


@query(f"""WITH {LISTINGS_SQL}, {EDGES_SQL} SELECT count(*) AS n FROM listings WHERE id IN (SELECT publicacion_id FROM edges WHERE estado <> 'descartada' UNION SELECT candidata_id FROM edges WHERE estado <> 'descartada')""")
def matched_count(spark: SparkSession, sf: str) -> DataFrame:
    return search.by_duplicates(listings(spark, sf), edges(spark, sf), "con").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT lower(p_brand) AS key, p_type AS g FROM part), e AS (SELECT key, count(DISTINCT g) AS grupos FROM k GROUP BY key) SELECT key, grupos, length(key) <= 5 AS corto FROM e WHERE grupos > 1 OR length(key) <= 5""")
def repeated_names(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.repeated_names(table(spark, sf, "part"), F.lower("p_brand"), "p_type")


@query("""SELECT user_id AS id, CASE WHEN bool_or(event_id % 5 = 0) THEN false WHEN bool_or(event_id % 3 = 0) THEN NULL ELSE true END AS ok FROM events GROUP BY user_id""")
def link_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    checks = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.when(k % 5 == 0, False).when(k % 3 != 0, True).alias("ok"))
    return matches.link_status(checks)


@query("""SELECT n_name, CASE WHEN p >= 75 THEN 'alta' WHEN p >= 45 THEN 'media' ELSE 'baja' END AS tono FROM (SELECT n_name, n_nationkey * 4 AS p FROM nation)""")
def quality_tone(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_name", analytics.tone(F.col("n_nationkey") * 4).alias("tono"))


@query("SELECT event_type AS motivo, count(*) AS n FROM events GROUP BY 1")
def skip_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.reason_counts(table(spark, sf, "events").select(F.col("event_type").alias("motivo")), "motivo")
