"""Queries of the operators that keep listings in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import EDGES_SQL, LISTINGS_SQL, edges, listings, registry, sources, table
from terrado.operators import graph, upkeep
from terrado.operators.fuzzy import close_names

QUERIES, SQL, query = registry()


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stored link checks: what the status is read from."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    ok = F.when(k % 5 == 0, F.lit('"true"')).when(k % 5 == 1, F.lit("null")).when(k % 5 == 2, F.lit("false")).otherwise("true")
    by_hand = F.when(k % 7 == 0, F.lit(', "link_check_manual": {"ok": false, "detalle": 3, "marcado_en": "hoy"}')).when(k % 7 == 1, F.lit(', "link_check_manual": {"ok": "no"}')).otherwise("")
    document = F.concat(F.lit('{"link_check": {"ok": '), ok, F.lit(', "detalle": "'), F.col("event_type"), F.lit('", "verificado_en": "x"}'), by_hand, F.lit("}"))
    return e.select("event_id", F.when(k % 11 == 0, "no json").when(k % 13 == 0, "[1]").otherwise(document).alias("links"))


@query("""WITH d AS (SELECT event_id, event_type, event_id % 11 <> 0 AND event_id % 13 <> 0 AS good, event_id % 7 = 0 AS hand FROM events)
SELECT event_id, CASE WHEN NOT good THEN NULL WHEN hand THEN false WHEN event_id % 5 = 2 THEN false WHEN event_id % 5 > 2 THEN true END AS ok,
  CASE WHEN good AND NOT hand THEN event_type END AS detalle, CASE WHEN good THEN CASE WHEN hand THEN 'hoy' ELSE 'x' END END AS cuando, CASE WHEN good THEN hand END AS manual FROM d""")
def link_status(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark, sf).withColumn("s", upkeep.link_status(F.col("links"))).select("event_id", "s.ok", "s.detalle", "s.cuando", "s.manual")


@query("""SELECT page_id, CASE WHEN contains(lower(url), '/login') OR contains(lower(url), '/checkpoint') OR contains(lower(html), 'log in to facebook') OR contains(lower(html), 'iniciar sesión') OR contains(lower(html), 'checkpoint') THEN 'sesion_perdida_durante_el_chequeo'
  WHEN contains(lower(html), 'isn''t available') AND contains(lower(html), 'content') OR contains(lower(html), 'page not found') THEN 'contenido_no_disponible' ELSE 'contenido_visible' END AS detalle FROM pages""")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", upkeep.availability(F.col("url"), F.col("html"))["detalle"].alias("detalle"))


@query(f"""WITH {LISTINGS_SQL} SELECT l.id, f.c_name AS snapshot_fuente, tipo_inmueble AS snapshot_tipo_inmueble, barrio AS snapshot_barrio, CAST(precio AS VARCHAR) AS snapshot_precio, CAST(NULL AS VARCHAR) AS snapshot_link
FROM listings l LEFT JOIN customer f ON f.c_custkey = l.fuente_id""")
def audit_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.snapshot(listings(spark, sf).withColumn("link_origen", F.lit(None).cast("string")), sources(spark, sf))


@query("""SELECT o_orderkey, '$' || chr(160) || replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', '.') AS pesos,
  translate(regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '0$', ''), '\\.0?$', ''), ',.', '.,') || ' m²' AS area,
  strftime(o_orderdate, '%-d/%m/%Y, %-I:%M') || chr(8239) || CASE WHEN hour(o_orderdate) < 12 THEN 'a.' ELSE 'p.' END || chr(160) || 'm.' AS cuando FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders)""")
def local_formats(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)")
    return table(spark, sf, "orders").select("o_orderkey", upkeep.format_cop(price).alias("pesos"), upkeep.format_count(price, " m²").alias("area"), upkeep.format_moment(F.col("o_orderdate").cast("timestamp")).alias("cuando"))


@query("""SELECT o_orderkey, CAST(least(95, greatest(2, floor(e * 100 / 900 + 0.5))) AS INTEGER) AS avance, greatest(0, 900 - e) AS faltan,
  CASE dayofweek(o_orderdate) WHEN 1 THEN 'fincaraiz,ciencuadras,metrocuadrado,amorel,facebook' WHEN 5 THEN 'facebook' ELSE '' END AS portales
FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 1000 AS e FROM orders)""")
def jobs_due(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("o_orderkey") % 1000
    return table(spark, sf, "orders").select("o_orderkey", upkeep.job_progress(e, F.lit(900)).alias("avance"), upkeep.remaining_seconds(e, F.lit(900)).alias("faltan"), F.array_join(upkeep.due_portals(F.col("o_orderdate")), ",").alias("portales"))


@query("""SELECT page_id, regexp_matches(strip_accents(lower(concat_ws(' ', url, split_part(coalesce(html, ''), '</head>', 1)))), '(^|[^\\p{L}\\p{N}_])en($|[^\\p{L}\\p{N}_])') AS territorial FROM pages""")
def territorial_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", upkeep.territorial(F.col("url"), F.lit(None).cast("string"), F.col("html"), "en").alias("territorial"))


@query(f"""WITH {LISTINGS_SQL} SELECT id FROM listings WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')""")
def with_images(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publicacion_id"), F.when(F.col("l_returnflag") == "R", "imagen").otherwise("html").alias("tipo"))
    return upkeep.with_images(listings(spark, sf), evidence).select("id")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS publicacion_id, l_returnflag AS tipo, CAST(l_suppkey AS VARCHAR) AS ruta FROM lineitem),
s AS (SELECT l_orderkey AS publicacion_id, l_returnflag AS tipo, CAST(l_suppkey AS VARCHAR) AS ruta FROM lineitem WHERE l_linestatus = 'O')
SELECT * FROM e EXCEPT SELECT * FROM s""")
def missing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publicacion_id"), F.col("l_returnflag").alias("tipo"), F.col("l_suppkey").cast("string").alias("ruta"), "l_linestatus")
    return upkeep.missing_evidence(every.drop("l_linestatus"), every.where("l_linestatus = 'O'")).select("publicacion_id", "tipo", "ruta")


@query(f"""WITH {EDGES_SQL}, m AS (SELECT o_orderkey AS p, o_orderkey // 10 AS g FROM orders WHERE o_orderstatus = 'F')
SELECT e.publicacion_id, e.candidata_id, a.g AS grupo_a, b.g AS grupo_b FROM edges e LEFT JOIN m a ON a.p = e.publicacion_id LEFT JOIN m b ON b.p = e.candidata_id""")
def groups_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS publicacion_id", "o_orderkey div 10 AS inmueble_id")
    return upkeep.groups_of_pairs(edges(spark, sf).select("publicacion_id", "candidata_id"), members)


@query(f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT publicacion_id AS a, candidata_id AS b FROM edges WHERE estado = 'confirmada'), both_ways AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
parts AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
held AS (SELECT node, component, o_custkey AS g FROM parts LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = node),
kept AS (SELECT component, coalesce(arg_min(g, node) FILTER (WHERE g IS NOT NULL), component) AS k FROM held GROUP BY component)
SELECT node AS publicacion_id, k AS inmueble_id FROM held JOIN kept USING (component)""")
def groups_keep_ids(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS publicacion_id", "o_custkey AS inmueble_id")
    parts = graph.connected_components(edges(spark, sf).where("estado = 'confirmada'"))
    return upkeep.keep_group_ids(parts, members).select("publicacion_id", "inmueble_id")


@query(f"""WITH {LISTINGS_SQL} SELECT id, ph AS ph_anterior, nuevo AS ph_nuevo FROM (SELECT id, ph, CASE WHEN id % 3 = 0 THEN NULL ELSE 'Torre ' || CAST(id % 4 AS VARCHAR) END AS nuevo FROM listings) WHERE nuevo IS NOT NULL AND nuevo IS DISTINCT FROM ph""")
def building_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf)
    found = rows.select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("Torre "), (F.col("id") % 4).cast("string"))).alias("ph"))
    return upkeep.building_changes(rows, found)


@query("""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS x FROM orders),
c AS (SELECT DISTINCT o_orderpriority AS nombre, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g') AS k FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT id, c.nombre AS tipo_inmueble, nullif(trim(coalesce(x, '')), '') IS NOT NULL AND c.k IS NULL AS rechazada FROM t LEFT JOIN c ON c.k = regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')""")
def checked_types(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = o.select(k.alias("id"), F.when(k % 6 == 0, "  ").when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.upper(p)).otherwise(p).alias("tipo_inmueble"))
    good, bad = upkeep.checked_types(rows, o.where("o_orderpriority <> '5-LOW'").select(p.alias("nombre")).distinct())
    return good.withColumn("rechazada", F.lit(False)).unionByName(bad.select("id", F.lit(None).cast("string").alias("tipo_inmueble"), F.lit(True).alias("rechazada")))


@query(f"""WITH {LISTINGS_SQL} SELECT id, nullif(fuente_id % 3, 0) AS fuente_id, nullif(ph, '') AS ph, nullif(barrio, '') AS barrio, nullif(trim(coalesce(barrio, '')), '') AS link_origen FROM listings""")
def form_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).select("id", (F.col("fuente_id") % 3).alias("fuente_id"), "ph", "barrio", F.col("barrio").alias("link_origen"))
    return upkeep.form_values(rows)


@query(f"""WITH {LISTINGS_SQL}, n AS (SELECT l_orderkey AS p, ' nota ' || CAST(l_partkey AS VARCHAR) AS c, CAST(l_shipdate AS TIMESTAMP) AS f, l_linenumber AS i FROM lineitem),
newest AS (SELECT p, arg_max(trim(c), (f + i * INTERVAL 1 SECOND, trim(c))) AS nota FROM n GROUP BY p)
SELECT id, coalesce(nota, notas) AS notas FROM listings LEFT JOIN newest ON p = id""")
def newest_notes(spark: SparkSession, sf: str) -> DataFrame:
    when = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))
    notes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publicacion_id"), F.concat(F.lit(" nota "), F.col("l_partkey").cast("string")).alias("contenido"), when.alias("fecha_creacion"))
    return upkeep.with_notes(listings(spark, sf).withColumn("fecha_nota", F.lit(None).cast("timestamp")), notes).select("id", "notas")


@query("""SELECT p_partkey, array_to_string([CASE WHEN upper(w) IN ('PH', 'VIP', 'VIS') THEN upper(w) ELSE upper(w[1]) || w[2:] END FOR w IN [regexp_replace(x, '^[-_,.;:]+|[-_,.;:]+$', '', 'g') FOR x IN string_split(lower(p_brand || ' ph. ' || p_name || ' -- vip,'), ' ')] IF w <> ''], ' ') AS titulo FROM part""")
def smart_titles(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" ph. "), "p_name", F.lit(" -- vip,"))
    return table(spark, sf, "part").select("p_partkey", upkeep.smart_title(text).alias("titulo"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Origen=http://a/' || CAST(event_id AS VARCHAR) || ' ' END || CASE WHEN event_id % 3 = 0 THEN 'Adicional 1=' || event_type || ' Adicional 3=z' WHEN event_id % 3 = 1 THEN 'Adicional 2=' || event_type ELSE '' END AS enlaces FROM events""")
def stored_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    origin = F.when(k % 4 != 0, F.concat(F.lit(" http://a/"), k.cast("string"))).otherwise("  ")
    more = F.when(k % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", " ", "z"]'))).when(k % 3 == 1, F.concat(F.lit("\n"), "event_type"))
    found = F.transform(upkeep.stored_links(origin, more), lambda x: F.concat(x["label"], F.lit("="), x["url"]))
    joined = F.concat(F.array_join(found, " "), F.when((F.size(found) > 0) & (k % 3 == 2), " ").otherwise(""))
    return table(spark, sf, "events").select("event_id", joined.alias("enlaces"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 1 + event_id % 5 + 0.25 END AS lat, CASE WHEN event_id % 4 = 3 THEN NULL ELSE -77.5 END AS lon FROM events""")
def json_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    lat = (1 + k % 5 + F.lit(0.25)).cast("string")
    forms = [F.concat(F.lit('{"a": {"lat": "'), F.replace(lat, F.lit("."), F.lit(",")), F.lit('", "zoom": 3, "lng": -77.5}}')), F.concat(F.lit('[{"coordinates": [-77.5, '), lat, F.lit("]}]")), F.concat(F.lit('{"coordenadas": "'), lat, F.lit(', -77.5"}'))]
    text = F.when(k % 4 == 0, forms[0]).when(k % 4 == 1, forms[1]).when(k % 4 == 2, forms[2]).otherwise('{"lat": 95.0, "lng": 200.1}')
    return table(spark, sf, "events").withColumn("c", upkeep.json_coordinates(text)).select("event_id", "c.lat", "c.lon")


@query("SELECT user_id AS corrida, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 50")
def capped_links(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.capped_links(table(spark, sf, "events").select(F.col("user_id").alias("corrida"), "event_id"), ["corrida"], [F.col("event_id")])


@query("""SELECT o_custkey AS corrida, count(*) FILTER (WHERE o_orderstatus = 'O') AS nueva, count(*) FILTER (WHERE o_orderstatus = 'F') AS existente, 0::BIGINT AS omitida, count(*) FILTER (WHERE o_orderstatus = 'P') AS error, count(*) AS total FROM orders GROUP BY 1""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "O", "nueva").when(F.col("o_orderstatus") == "F", "existente").otherwise("error")
    return upkeep.run_counts(table(spark, sf, "orders").select(F.col("o_custkey").alias("corrida"), outcome.alias("resultado")))


@query(f"""WITH {LISTINGS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE trim(barrio) = '') AS b, count(*) FILTER (WHERE m2 IS NULL) AS m FROM listings)
SELECT 'barrio en blanco' AS "column", b AS n, b / n AS share FROM c UNION ALL SELECT 'sin area', m, m / n FROM c""")
def column_faults(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.column_faults(listings(spark, sf), {"barrio en blanco": F.trim("barrio") == "", "sin area": F.col("m2").isNull()})


@query("""SELECT event_id, try_cast(x AS DOUBLE) AS precio, CASE WHEN try_cast(x AS DOUBLE) IS NULL THEN 'precio' ELSE '' END AS apartado FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'mucho' ELSE CAST(event_id AS VARCHAR) END AS x FROM events)""")
def quarantined_rows(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("event_id") % 9 == 0, "mucho").otherwise(F.col("event_id").cast("string"))
    out = upkeep.quarantined(table(spark, sf, "events").select("event_id", x.alias("x")), {"precio": F.col("x").try_cast("double")})
    return out.select("event_id", "precio", F.array_join("apartado", ",").alias("apartado"))


@query("SELECT c_custkey, string_agg(lower(n_name), ',' ORDER BY n_nationkey) AS cercanos FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey")
def suggest_own_nation(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest name of the catalog to a customer's nation is that nation; made once for each name, and joined."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("key"))
    near = close_names(nations.select("key"), nations.select("key"), most=1)
    named = nations.join(near, "key").select(F.col("n_nationkey").alias("c_nationkey"), F.array_join("near.key", ",").alias("cercanos"))
    return table(spark, sf, "customer").join(F.broadcast(named), "c_nationkey").select("c_custkey", "cercanos")
