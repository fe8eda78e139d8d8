"""Join, match, graph and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import EDGES_SQL, LISTINGS_SQL, edges, listings, registry, sources, table
from terrado.functions.geo import hash_distance, haversine_metres
from terrado.operators import entity, graph, matches, windows

QUERIES, SQL, query = registry()


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def dump_join(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


@query(f"""WITH {LISTINGS_SQL}, {EDGES_SQL}
SELECT e.id, a.precio AS a_precio, b.precio AS b_precio, s.c_name AS a_fuente, t.c_name AS b_fuente FROM edges e
JOIN listings a ON a.id = e.publicacion_id JOIN listings b ON b.id = e.candidata_id LEFT JOIN customer s ON s.c_custkey = a.fuente_id LEFT JOIN customer t ON t.c_custkey = b.fuente_id""")
def roles_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return matches.roles_joined(edges(spark, sf), listings(spark, sf), sources(spark, sf), ("precio",)).select("id", "a_precio", "b_precio", "a_fuente", "b_fuente")


@query("""SELECT o.o_orderkey AS id FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 AND l.l_returnflag <> 'R' WHERE l.l_orderkey IS NULL""")
def work_queue_left_null(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("imagen").alias("tipo"))
    li = table(spark, sf, "lineitem").where("l_linenumber = 1")
    hashes = li.select(F.col("l_orderkey").alias("evidencia_id"), F.lit("dhash64").alias("algoritmo"), F.when(F.col("l_returnflag") != "R", "x").alias("hash_contenido"))
    return matches.needs_hashing(evidence, hashes).select("id")


@query("""WITH e AS (SELECT event_id, 'l' || CAST(event_id AS VARCHAR) AS link, 'l' || CAST(event_id * 2 AS VARCHAR) AS asked, user_id, event_type FROM events),
by_link AS (SELECT link, min(event_id) AS m FROM e GROUP BY 1), by_key AS (SELECT user_id, event_type, min(event_id) AS m FROM e GROUP BY 1, 2)
SELECT e.event_id AS fila, least(l.m, k.m) AS existente_id FROM e LEFT JOIN by_link l ON l.link = e.asked LEFT JOIN by_key k ON k.user_id = e.user_id AND k.event_type = e.event_type""")
def existing_or_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    link = lambda x: F.concat(F.lit("l"), x.cast("string")).alias("link_origen")
    keys = [F.col("user_id").alias("fuente_id"), F.col("event_type").alias("codigo_externo")]
    stored = e.select(F.col("event_id").alias("id"), link(F.col("event_id")), *keys)
    incoming = e.select(F.col("event_id").alias("fila"), link(F.col("event_id") * 2), *keys)
    return matches.existing(incoming, stored).select("fila", "existente_id")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def top_n_per_probe(spark: SparkSession, sf: str) -> DataFrame:
    return windows.newest_per_probe(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def latest_note(spark: SparkSession, sf: str) -> DataFrame:
    from terrado.operators.analytics import latest

    return latest(table(spark, sf, "conversations"), "conv_id", [F.desc("turn")]).select("conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC) AS historia, count(*) AS n FROM conversations GROUP BY conv_id")
def note_history(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    items = F.sort_array(F.collect_list(F.struct((-F.col("turn")).alias("k"), "role")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: x["role"]), ",").alias("historia"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, event_id, value < 50 AS h FROM events),
g AS (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM x)
SELECT user_id, event_id, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS racha FROM g""")
def run_length(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return windows.run_length(e, ["user_id"], [F.col("event_id")], F.col("value") < 50).select("user_id", "event_id", "racha")


@query("""WITH x AS (SELECT user_id, event_id, value < 50 AS h FROM events),
g AS (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM x),
r AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS racha FROM g),
s AS (SELECT *, max(CASE WHEN racha >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM r)
SELECT user_id, event_id FROM s WHERE coalesce(stopped, 0) = 0""")
def run_length_stop(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return windows.until_run(e, ["user_id"], [F.col("event_id")], F.col("value") < 50, 3).select("user_id", "event_id")


@query("""SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS m FROM events WHERE value > 90 GROUP BY user_id) s USING (user_id) WHERE s.m IS NULL OR e.event_id < s.m""")
def separator_cut(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return windows.before_mark(e, ["user_id"], F.col("event_id"), F.col("value") > 90).select("user_id", "event_id")


@query(f"""WITH {EDGES_SQL},
seen AS (SELECT publicacion_id AS id, candidata_id AS other, id AS edge_id, estado, puntaje FROM edges WHERE estado <> 'descartada' UNION ALL SELECT candidata_id, publicacion_id, id, estado, puntaje FROM edges WHERE estado <> 'descartada')
SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY estado <> 'confirmada', puntaje DESC, edge_id) AS otras, count(*) AS n FROM seen GROUP BY id""")
def ordered_match_list(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    lists = matches.match_lists(listings(spark, sf), e).where(F.size("coincidencias") > 0)
    return lists.select("id", F.array_join(F.transform("coincidencias", lambda x: x["otra_id"].cast("string")), ",").alias("otras"), F.size("coincidencias").cast("long").alias("n"))


@query(f"""WITH {EDGES_SQL}, x AS (SELECT publicacion_id AS id, estado FROM edges UNION ALL SELECT candidata_id, estado FROM edges)
SELECT id, count(*) FILTER (WHERE estado = 'confirmada') AS confirmadas, count(*) FILTER (WHERE estado = 'pendiente') AS candidatas FROM x WHERE estado <> 'descartada' GROUP BY id""")
def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matches.match_counts(edges(spark, sf))


@query(f"""WITH {LISTINGS_SQL}, {EDGES_SQL}, root AS (SELECT min(publicacion_id) AS r FROM edges WHERE estado <> 'descartada'),
near AS (SELECT CASE WHEN publicacion_id = r THEN candidata_id ELSE publicacion_id END AS id, puntaje FROM edges, root WHERE estado <> 'descartada' AND r IN (publicacion_id, candidata_id))
SELECT l.id, l.precio, n.puntaje, c.c_name AS fuente_nombre FROM listings l LEFT JOIN near n USING (id) LEFT JOIN customer c ON c.c_custkey = l.fuente_id, root WHERE l.id = r OR n.id IS NOT NULL""")
def comparison_set(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    root = e.where("estado <> 'descartada'").agg(F.min("publicacion_id")).first()[0]
    return matches.comparison(listings(spark, sf), e, sources(spark, sf), root).select("id", "precio", "puntaje", "fuente_nombre")


@query(f"""WITH RECURSIVE {EDGES_SQL}, live AS (SELECT publicacion_id AS a, candidata_id AS b FROM edges WHERE estado = 'confirmada'),
reach AS (SELECT b AS node, a AS root FROM live UNION SELECT l.b, r.root FROM reach r JOIN live l ON l.a = r.node),
members AS (SELECT a AS node FROM live UNION SELECT b FROM live)
SELECT m.node AS publicacion_id, least(m.node, coalesce(min(r.root), m.node)) AS inmueble_id FROM members m LEFT JOIN reach r ON r.node = m.node GROUP BY m.node""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.groups(edges(spark, sf))


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b, round(6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metros FROM (
  SELECT a.c_custkey AS ka, b.c_custkey AS kb, pow(sin(radians((b.c_custkey - a.c_custkey) * 0.001) / 2), 2) + cos(radians(1 + a.c_custkey * 0.001)) * cos(radians(1 + b.c_custkey * 0.001)) * pow(sin(radians((b.c_custkey - a.c_custkey) * 0.002) / 2), 2) AS h
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1) x JOIN customer a ON a.c_custkey = ka JOIN customer b ON b.c_custkey = kb""")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    pairs = c.select(F.col("c_custkey").alias("a")).join(c.select(F.col("c_custkey").alias("b"), (F.col("c_custkey") - 1).alias("a")), "a")
    lat, lon = (lambda k: 1 + k * 0.001), (lambda k: -77 + k * 0.002)
    return pairs.select("a", "b", F.round(haversine_metres(lat(F.col("a")), lon(F.col("a")), lat(F.col("b")), lon(F.col("b"))), 3).alias("metros"))


@query("""WITH h AS (SELECT doc_id, substr(md5(text), 1, 16) AS x FROM documents)
SELECT a.doc_id, CAST(bit_count(xor(CAST('0x' || a.x AS UBIGINT), CAST('0x' || b.x AS UBIGINT))) AS INTEGER) AS d FROM h a JOIN h b ON b.doc_id = a.doc_id + 1""")
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("x"))
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id").select("doc_id", hash_distance(F.col("x"), F.col("y")).alias("d"))


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS primero FROM documents GROUP BY 1 HAVING count(*) > 1")
def sha_exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("primero"))
    return d.where("n > 1")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as listings for entity resolution."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.concat(F.lit("ciudad "), (k % 3).cast("string")).alias("ciudad"),
        F.concat(F.lit("barrio "), (k % 40).cast("string")).alias("barrio"),
        F.when(k % 4 == 0, F.concat(F.lit("Carrera "), (k % 25).cast("string"))).alias("direccion"),
        F.col("c_mktsegment").alias("tipo_inmueble"),
        F.lit(None).cast("string").alias("ph"),
        F.lit(None).cast("string").alias("antiguedad"),
        F.lit(None).cast("string").alias("descripcion"),
        F.lit(None).cast("decimal(10,7)").alias("latitud"),
        F.lit(None).cast("decimal(10,7)").alias("longitud"),
        (50 + k % 30).cast("decimal(10,2)").alias("m2"),
        F.lit(None).cast("decimal(10,2)").alias("m2_construido"),
        (k % 5).cast("int").alias("habitaciones"),
        (k % 3).cast("int").alias("banios"),
        F.lit(None).cast("int").alias("parqueadero"),
        (k % 6).cast("int").alias("estrato"),
        F.lit(None).cast("int").alias("pisos"),
        (100000 + (k % 10) * 7000).cast("decimal(15,0)").alias("precio"),
        F.lit(None).cast("decimal(15,0)").alias("administracion"),
    )


PEOPLE_SQL = """people AS (SELECT c_custkey AS id, 'ciudad ' || CAST(c_custkey % 3 AS VARCHAR) AS ciudad, 'barrio ' || CAST(c_custkey % 40 AS VARCHAR) AS barrio,
  CASE WHEN c_custkey % 4 = 0 THEN 'kr ' || CAST(c_custkey % 25 AS VARCHAR) END AS direccion, c_mktsegment AS tipo, 50 + c_custkey % 30 AS m2, c_custkey % 5 AS hab, c_custkey % 3 AS ban, c_custkey % 6 AS est, 100000 + (c_custkey % 10) * 7000 AS precio FROM customer)"""


def _no_hashes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "publicacion_id long, evidencia_id long, hash_contenido string, hash_perceptual string")


@query(f"""WITH {PEOPLE_SQL},
pairs AS (SELECT a.id AS probe, b.id AS candidate, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS r FROM people a JOIN people b ON a.id <> b.id AND a.ciudad = b.ciudad AND (a.barrio = b.barrio OR a.direccion = b.direccion))
SELECT probe, candidate FROM pairs WHERE r <= 1000""")
def blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return entity.candidate_pairs(people(spark, sf), _no_hashes(spark))


_POOLED_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN 'ciudad ' || CAST(c_custkey % 3 AS VARCHAR) END AS ciudad, 'barrio ' || CAST(c_custkey % 40 AS VARCHAR) AS barrio,
  CASE WHEN c_custkey % 4 = 0 THEN 'carrera ' || CAST(c_custkey % 25 AS VARCHAR) END AS direccion, c_custkey % 3 = 0 AS placed, EXISTS (SELECT 1 FROM documents WHERE doc_id // 5 = c_custkey) AS hashed FROM customer"""


@query(f"""WITH p AS ({_POOLED_SQL}),
pairs AS (SELECT a.id AS probe, b.id AS candidate, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS r FROM p a JOIN p b
  ON a.id <> b.id AND (a.ciudad = b.ciudad OR a.ciudad IS NULL OR b.ciudad IS NULL) AND (a.barrio = b.barrio OR a.direccion = b.direccion OR (a.placed AND b.placed) OR b.hashed))
SELECT probe, candidate FROM pairs WHERE r <= 25""")
def blocking_pools(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 25 candidates where many listings have coordinates, some have image hashes and some no city."""
    k = F.col("id")
    rows = people(spark, sf).withColumns({"ciudad": F.when(k % 7 != 0, F.col("ciudad")), "latitud": F.when(k % 3 == 0, F.lit(1.2)).cast("decimal(10,7)"), "longitud": F.when(k % 3 == 0, F.lit(-77.2)).cast("decimal(10,7)")})
    return entity.candidate_pairs(rows, _page_hashes(spark, sf), most=25)


def _page_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the images of listings, five each."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.floor(F.col("doc_id") / 5).alias("publicacion_id"), F.col("doc_id").alias("evidencia_id"), F.sha2("text", 256).alias("hash_contenido"), F.substring(F.md5("text"), 1, 16).alias("hash_perceptual"))


_SCORED_SQL = f"""WITH {PEOPLE_SQL},
pairs AS (SELECT a.id AS a, b.id AS b, a.direccion AS da, b.direccion AS db, a.barrio = b.barrio AS sb, a.tipo = b.tipo AS st, a.m2 AS ma, b.m2 AS mb, a.hab = b.hab AS sh, a.ban = b.ban AS sn, a.est = b.est AS se, a.precio AS pa, b.precio AS pb
  FROM people a JOIN people b ON a.id < b.id AND a.ciudad = b.ciudad AND (a.barrio = b.barrio OR a.direccion = b.direccion)),
gaps AS (SELECT *, abs(pa - pb) / CAST(greatest(pa, pb) AS DOUBLE) AS gap, abs(ma - mb) / CAST(greatest(ma, mb) AS DOUBLE) AS mgap FROM pairs),
points AS (SELECT a, b, st, sh AND sn AS rooms, mgap, 3 + CASE WHEN sb THEN 6 ELSE 0 END + CASE WHEN st THEN 4 ELSE -30 END + CASE WHEN da = db THEN 20 ELSE 0 END + CASE WHEN mgap <= 0.10 THEN 10 WHEN mgap > 0.25 THEN -15 ELSE 0 END
  + CASE WHEN sh THEN 5 ELSE -8 END + CASE WHEN sn THEN 5 ELSE -8 END + CASE WHEN se THEN 3 ELSE -5 END
  + CASE WHEN gap = 0 THEN 12 WHEN gap <= 0.05 THEN 8 WHEN gap <= 0.15 THEN 3 WHEN gap >= 0.30 THEN -25 ELSE 0 END AS p FROM gaps)"""


@query(_SCORED_SQL + " SELECT a, b, CAST(greatest(0, least(100, p)) AS INTEGER) AS puntaje FROM points")
def numeric_score(spark: SparkSession, sf: str) -> DataFrame:
    wide = entity.without_images(entity.pairs_of_units(entity.alike_units(people(spark, sf), _no_hashes(spark))))
    return entity.each_pair(wide.select("a", "b", "a_members", "b_members", F.least(F.lit(100), F.greatest(F.lit(0), entity.native_points())).alias("puntaje")))


@query(None)
def detect_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = entity.unit_edges(people(spark, sf), _no_hashes(spark))
    signals = F.array_join(F.transform("razones", lambda r: r["signal"]), ",").alias("senales")
    return entity.each_edge(found.select("publicacion_id", "candidata_id", "a_members", "b_members", "puntaje", "estado", signals))


@query(None)
def greedy_image_match(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    hashes = d.select((F.col("doc_id") / 5).cast("long").alias("publicacion_id"), F.col("doc_id").alias("evidencia_id"), F.sha2("text", 256).alias("hash_contenido"), F.substring(F.md5("text"), 1, 16).alias("hash_perceptual"))
    ids = hashes.select("publicacion_id").distinct()
    pairs = ids.select(F.col("publicacion_id").alias("a"), (F.col("publicacion_id") + 1).alias("b"))
    return entity.compare_images(pairs, hashes)
