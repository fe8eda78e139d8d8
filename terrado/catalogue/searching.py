"""Search, order, page, label and curate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import EDGES_SQL, LISTINGS_SQL, edges, listings, registry, sources, table
from terrado.functions.numbers import unit_price
from terrado.functions.text import blank_to_null, is_blank
from terrado.operators import curate, search, windows
from terrado.operators.search import ListingFilters

QUERIES, SQL, query = registry()


@query(f"""WITH {LISTINGS_SQL}
SELECT l.id, l.precio, l.habitaciones, c.c_name AS fuente_nombre, l.fecha_captura FROM listings l LEFT JOIN customer c ON c.c_custkey = l.fuente_id
WHERE l.habitaciones >= 3 AND l.banios = 2 AND l.precio >= 100000 AND l.precio <= 250000""")
def listing_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = ListingFilters(habitaciones="3+", banios="2", precio_min="$ 100.000", precio_max="250000")
    return search.search(listings(spark, sf), asked, sources(spark, sf)).select("id", "precio", "habitaciones", "fuente_nombre", "fecha_captura")


@query(f"""WITH {LISTINGS_SQL} SELECT id, m2 FROM listings WHERE m2 >= 120.5 AND m2 <= 200""")
def search_area(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(listings(spark, sf), ListingFilters(area_min="120,5 m2", area_max="200")).select("id", "m2")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%e%'")
def search_like_substring(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(search.contains_folded(F.col("p_name"), "Á%é")).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15'")
def search_calendar_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(search.on_day(F.col("o_orderdate"), search.day_filter("1995-03-15"))).select("o_orderkey")


@query(f"""WITH {LISTINGS_SQL} SELECT id, 'sin_barrio' AS caso FROM listings WHERE barrio IS NULL OR trim(barrio) = ''
UNION ALL SELECT id, 'con_ph' FROM listings WHERE ph IS NOT NULL AND trim(ph) <> ''
UNION ALL SELECT id, 'un_barrio' FROM listings WHERE barrio = 'Barrio Ñ3'""")
def search_blank_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    cases = (("sin_barrio", ListingFilters(barrio=search.NO_BARRIO)), ("con_ph", ListingFilters(ph=search.ANY_BUILDING)), ("un_barrio", ListingFilters(barrio="BARRIO  ñ3")))
    parts = [search.search(rows, f).select("id", F.lit(name).alias("caso")) for name, f in cases]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {LISTINGS_SQL}, {EDGES_SQL},
live AS (SELECT publicacion_id AS id, estado FROM edges UNION ALL SELECT candidata_id, estado FROM edges)
SELECT id, 'con' AS caso FROM listings WHERE id IN (SELECT id FROM live WHERE estado <> 'descartada')
UNION ALL SELECT id, 'confirmadas' FROM listings WHERE id IN (SELECT id FROM live WHERE estado = 'confirmada')
UNION ALL SELECT id, 'pendientes' FROM listings WHERE id IN (SELECT id FROM live WHERE estado = 'pendiente')""")
def has_match_semi(spark: SparkSession, sf: str) -> DataFrame:
    rows, e = listings(spark, sf), edges(spark, sf)
    parts = [search.by_duplicates(rows, e, w).select("id", F.lit(w).alias("caso")) for w in ("con", "confirmadas", "pendientes")]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {LISTINGS_SQL}, {EDGES_SQL}
SELECT id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.estado <> 'descartada' AND (e.publicacion_id = l.id OR e.candidata_id = l.id))""")
def no_match_anti(spark: SparkSession, sf: str) -> DataFrame:
    return search.by_duplicates(listings(spark, sf), edges(spark, sf), "sin").select("id")


@query("SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY place LIMIT 40")
def sort_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")
    top = search.ordered(rows, "quality", "desc", "doc_id").limit(40)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("quality").desc_nulls_last(), "doc_id"))
    return top.withColumn("place", place)  # of the 40 rows of the report


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_slice(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3, 20, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""SELECT o_custkey, o_orderkey, r AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 3 AND 4""")
def page_of_each(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return search.rank_page(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 2).select("o_custkey", "o_orderkey", "place")


@query(f"""WITH {LISTINGS_SQL}
SELECT id, coalesce(nullif(trim(barrio), ''), 'Sin barrio') AS barrio_label, coalesce(nullif(trim(ph), ''), 'Sin PH') AS ph_label, coalesce(notas, 'Sin nota') AS nota_label FROM listings""")
def listing_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("coordenadas", "latitud", "longitud")})
    return search.labelled(rows).select("id", "barrio_label", "ph_label", "nota_label")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) / CAST(l_quantity - 10 AS DECIMAL(10,2))) AS DECIMAL(15,0)) END AS precio_m2 FROM lineitem""")
def price_per_unit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", unit_price(F.col("l_extendedprice").cast("decimal(15,2)"), (F.col("l_quantity") - 10).cast("decimal(10,2)")).alias("precio_m2"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'no_positivo' WHEN o_custkey IS NULL THEN 'sin_fuente' WHEN o_orderkey % 9 = 0 THEN 'fuera' END AS motivo FROM orders""")
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("no_positivo", F.col("o_totalprice") <= 0), ("sin_fuente", F.col("o_custkey").isNull()), ("fuera", F.col("o_orderkey") % 9 == 0)]
    return curate.with_reject_reason(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), rules).select("o_orderkey", "motivo")


@query(f"""WITH {EDGES_SQL},
fresh AS (SELECT publicacion_id, candidata_id, CAST(99 AS DECIMAL(5,2)) AS puntaje, 'pendiente' AS estado FROM edges WHERE publicacion_id % 2 = 0
  UNION ALL SELECT publicacion_id, -candidata_id, CAST(50 AS DECIMAL(5,2)), 'confirmada' FROM edges WHERE publicacion_id % 7 = 0)
SELECT coalesce(o.publicacion_id, f.publicacion_id) AS publicacion_id, coalesce(o.candidata_id, f.candidata_id) AS candidata_id, coalesce(f.puntaje, o.puntaje) AS puntaje,
  CASE WHEN o.estado IN ('descartada', 'confirmada') THEN o.estado ELSE coalesce(f.estado, o.estado) END AS estado
FROM edges o FULL JOIN fresh f ON o.publicacion_id = f.publicacion_id AND o.candidata_id = f.candidata_id""")
def merge_preserve_review(spark: SparkSession, sf: str) -> DataFrame:
    old = edges(spark, sf).select("publicacion_id", "candidata_id", "puntaje", "estado")
    again = old.where("publicacion_id % 2 = 0").withColumns({"puntaje": F.lit(99).cast("decimal(5,2)"), "estado": F.lit("pendiente")})
    more = old.where("publicacion_id % 7 = 0").withColumns({"candidata_id": -F.col("candidata_id"), "puntaje": F.lit(50).cast("decimal(5,2)"), "estado": F.lit("confirmada")})
    return curate.upsert_edges(old, again.union(more))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(nullif(trim(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END), ''), d.lang) AS origen FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    source = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return rows.select("doc_id", curate.fill_missing(F.col("quality"), F.lit(-1)).alias("quality"), curate.fill_missing(source, F.col("lang"), blank=True).alias("origen"))


@query(f"""WITH {LISTINGS_SQL} SELECT id AS publicacion_id, notas AS nota, coalesce(CASE WHEN id % 20 = 0 THEN NULL ELSE fecha_captura END, fecha_captura) AS fecha FROM listings WHERE notas IS NOT NULL AND trim(notas) <> ''""")
def insert_select_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return curate.insert_notes(listings(spark, sf).withColumn("fecha_nota", F.when(F.col("id") % 20 != 0, F.col("fecha_captura"))))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_get(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", curate.json_get(F.col("props"), "$.k").alias("k"), curate.json_get(F.col("props"), "$.missing").alias("missing"))


@query("SELECT event_id, 'caido' AS estado, NULL AS quitado FROM events")
def json_patch(spark: SparkSession, sf: str) -> DataFrame:
    patched = curate.json_set(F.col("props"), "link_check", F.lit("caido"))
    e = table(spark, sf, "events").select("event_id", patched.alias("p"))
    return e.select("event_id", curate.json_get(F.col("p"), "$.link_check").alias("estado"), curate.json_get(curate.json_remove(F.col("p"), "link_check"), "$.link_check").alias("quitado"))


@query("""SELECT p_name AS clave, first(p_partkey ORDER BY p_partkey) AS primero FROM part GROUP BY p_name""")
def keep_first_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.keep_first(table(spark, sf, "part").select("p_name", "p_partkey"), [F.col("p_name")], [F.col("p_partkey")])
    return rows.select(F.col("p_name").alias("clave"), F.col("p_partkey").alias("primero"))


@query("""SELECT p_partkey AS id, p_name || '!' AS link, CASE WHEN p_partkey % 2 = 0 THEN 'http://x' END AS url FROM part WHERE p_partkey % 2 = 0""")
def real_urls(spark: SparkSession, sf: str) -> DataFrame:
    from terrado.operators.matches import is_real_url

    url = F.when(F.col("p_partkey") % 2 == 0, "http://x").when(F.col("p_partkey") % 3 == 0, "sin url")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("!")).alias("link"), url.alias("url")).where(is_real_url(F.col("url")))


@query("""SELECT p_brand AS key, min(p_partkey) AS orden FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 10 = 0) GROUP BY p_brand""")
def new_catalog_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("key"), "p_partkey")
    return curate.new_keys(p, p.where("p_partkey % 10 = 0")).groupBy("key").agg(F.min("p_partkey").alias("orden"))


@query("SELECT doc_id, coalesce(nullif(trim(source), ''), '-') AS origen, trim(source) = '' AS vacio FROM documents")
def blank_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce(blank_to_null(F.col("source")), F.lit("-")).alias("origen"), is_blank(F.col("source")).alias("vacio"))


@query("""SELECT event_id, CASE WHEN trim(u) <> '' THEN CAST(try_strptime(u, '%Y-%m-%d') AS DATE) ELSE CAST(try_strptime(g, '%Y-%m-%d') AS DATE) END AS fecha FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'mala' ELSE '2024-02-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') END AS u, '2023-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') AS g FROM events)""")
def capture_dates(spark: SparkSession, sf: str) -> DataFrame:
    e, day = table(spark, sf, "events"), F.lpad((1 + F.col("event_id") % 28).cast("string"), 2, "0")
    updated = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "mala").otherwise(F.concat(F.lit("2024-02-"), day))
    return e.select("event_id", curate.corrected_capture(updated, F.concat(F.lit("2023-01-"), day)).alias("fecha"))
