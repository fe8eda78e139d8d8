"""Text, number, phrase, page and location queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import registry, table
from terrado.functions import numbers, text
from terrado.functions.similarity import text_similarity
from terrado.operators import buildings, fuzzy, location, phrases
from terrado.sources import pages as web

QUERIES, SQL, query = registry()


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS clave FROM documents""")
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce(text.type_key(F.col("text")), F.lit(""))).alias("clave"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(x)), '\bii\b', '2', 'g'), '\b(?:et|etapa)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS clave FROM (SELECT p_partkey, p_name || ' Ñandú II etapa' AS x FROM part)""")
def place_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.place_key(F.concat("p_name", F.lit(" Ñandú II etapa"))).alias("clave"))


@query(r"""SELECT p_partkey, 'kr 24 18 40 ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS clave FROM part""")
def address_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.address_key(F.concat(F.lit("Cra. 24 No. 18-40 "), F.col("p_name"))).alias("clave"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1000 + l_quantity WHEN l_linenumber % 3 = 1 THEN 1234.56 ELSE 118.65 END AS DOUBLE) AS n FROM lineitem""")
def colombian_decimal(spark: SparkSession, sf: str) -> DataFrame:
    q = F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0")
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("1."), q, F.lit(" m2"))).when(F.col("l_linenumber") % 3 == 1, "area 1.234,56").otherwise("118.65 m2")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.colombian_decimal(shown).alias("n"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS idioma, CAST(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS BIGINT) AS codigo FROM pages""")
def regex_first(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", web.first_match(html, ['lang="([a-z]+)"', "lang=([a-z]+)"]).alias("idioma"), web.first_match(html, [r"track\((\d+)\)"]).cast("long").alias("codigo"))


@query(r"""SELECT doc_id, list_max([try_cast(x AS BIGINT) FOR x IN regexp_extract_all(text, '[0-9]{1,15}')]) AS mayor FROM documents""")
def regex_max(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", web.greatest_number(F.col("text"), "[0-9]{1,15}", 0).alias("mayor"))


@query(r"""SELECT page_id, lower(regexp_extract(u, '^[A-Za-z]+://[^/]*')) || regexp_replace(regexp_replace(u, '^[A-Za-z]+://[^/]*', ''), '/+$', '') AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))


@query(r"""WITH names AS (SELECT key, row_number() OVER (ORDER BY first) AS ord FROM (SELECT lower(n_name) AS key, n_nationkey AS first FROM nation UNION ALL SELECT 'the', 100 UNION ALL SELECT 'de la', 101 UNION ALL SELECT 'la', 102)),
t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS k FROM documents),
h AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, ord) AS r FROM t JOIN names ON contains(k, ' ' || key || ' '))
SELECT doc_id AS id, key AS frase FROM h WHERE r = 1""")
def phrase_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("ord"))
    catalog = n.union(spark.createDataFrame([("the", 100), ("de la", 101), ("la", 102)], "key string, ord long"))
    texts = table(spark, sf, "documents").select("doc_id", F.coalesce(text.type_key(F.col("text")), F.lit("")).alias("k"))
    return phrases.longest_phrases(texts, catalog, "k", "doc_id").select("id", F.col("hit.key").alias("frase"))


@query("SELECT doc_id, CAST(len(list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda z: z <> '')) AS INTEGER) AS n FROM documents")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.lines(F.col("text"))).alias("n"))


@query("""SELECT event_id, 'http://x?' || CAST(event_id AS VARCHAR) AS u, CAST(event_id AS BIGINT) AS n FROM events""")
def number_digits(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.lit("http://x?"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", u.alias("u"), numbers.digits(u).alias("n"))


@query(None)
def suggest_topk(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.lower("n_name").alias("key"))
    customers = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("key"))
    # a name is compared with the catalog once, however many rows have it
    found = fuzzy.close_names(customers.select("key").distinct(), names)
    return customers.join(found, "key", "left").select("c_custkey", F.coalesce(F.col("near.key"), F.array().cast("array<string>")).alias("cercanos"))


@query(None)
def suggest_part_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts with two letters changed places, against all names of parts."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))
    wrong = p.withColumn("said", F.concat(F.substring("name", 2, 1), F.substring("name", 1, 1), F.substring("name", 3, 200)))
    near = fuzzy.close_names(wrong.select(F.col("said").alias("key")).distinct(), p.select("key").distinct())
    return wrong.join(near.select(F.col("key").alias("said"), F.col("near.key").alias("cercanos")), "said", "left").select("p_partkey", "said", "cercanos")


@query(None)
def text_similarities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("otro"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(text_similarity(F.col("p_name"), F.col("otro")), 6).alias("s"))


@query(None)
def parse_page(spark: SparkSession, sf: str) -> DataFrame:
    return web.parse_pages(table(spark, sf, "pages"))


def _places(spark: SparkSession) -> DataFrame:
    rows = [("torobajo", "Torobajo", "barrio", 0), ("the", "The", "barrio", 1), ("de la", "De La", "barrio", 2), ("gualmatan", "Gualmatán", "corregimiento", 3)]
    return spark.createDataFrame(rows, "key string, canonical string, kind string, ord long")


@query(None)
def resolve_location(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    empty = F.lit(None).cast("string")
    rows = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "Toro bajo").alias("candidate"), empty.alias("title"), F.col("text").alias("description"), empty.alias("address"), F.when(F.col("doc_id") % 9 == 0, "Bogota").alias("city"))
    return location.resolve_locations(rows, _places(spark))


@query(None)
def detect_ph(spark: SparkSession, sf: str) -> DataFrame:
    names = _places(spark).select("key", "canonical", "ord").where("key <> 'the'")
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.array("text", F.when(F.col("doc_id") % 5 == 0, "casa sin conjunto")).alias("texts"), F.when(F.col("doc_id") % 7 == 0, "Torobajo").alias("complex_name"))
    return buildings.detect_buildings(rows, buildings.usable_names(names, spark.createDataFrame([("x",)], "canonical string")))
