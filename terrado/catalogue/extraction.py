"""Extraction, import and capture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import registry, table
from terrado.extract import listing_pages, portals
from terrado.extract.rules import after_label
from terrado.functions import numbers, text
from terrado.operators import curate
from terrado.plans import sheet_import
from terrado.sources import pages as web

QUERIES, SQL, query = registry()


@query("""SELECT page_id, CASE WHEN contains(lower(u), 'fincaraiz.com.co') THEN 'Fincaraiz' WHEN contains(lower(u), 'facebook.com') THEN 'Facebook Marketplace' ELSE 'Cliente' END AS fuente
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://FincaRaiz.com.co/' WHEN page_id % 3 = 1 THEN url || 'facebook.com' ELSE url END AS u FROM pages)""")
def infer_source(spark: SparkSession, sf: str) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, "https://FincaRaiz.com.co/").when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("facebook.com"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", sheet_import.source_of(u).alias("fuente"))


@query("""SELECT c_custkey, CASE WHEN lat BETWEEN -5 AND 15 AND lon BETWEEN -82 AND -66 THEN lat END AS lat, CASE WHEN lat BETWEEN -5 AND 15 AND lon BETWEEN -82 AND -66 THEN lon END AS lon
FROM (SELECT c_custkey, CAST(c_custkey % 20 AS DOUBLE) + 0.5 AS lat, CAST(-(60 + c_custkey % 30) AS DOUBLE) - 0.25 AS lon FROM customer)""")
def coordinate_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    shown = F.concat((k % 20).cast("string"), F.lit(",5 , -"), (60 + k % 30).cast("string"), F.lit(".25"))
    point = sheet_import.coordinates_of(shown)
    return table(spark, sf, "customer").select("c_custkey", point["lat"].alias("lat"), point["lon"].alias("lon"))


@query(r"""SELECT doc_id, list_max([try_cast(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT) FOR x IN regexp_extract_all(s, '\$\s*([0-9][0-9\s\.,'']{4,})', 1)]) AS precio, contains(s, 'NEGOCIABLE') AS negociable
FROM (SELECT doc_id, 'VENDO $ ' || CAST(doc_id * 1000 + 20000000 AS VARCHAR) || ' O $ 15.000.000 NEGOCIABLE' AS s FROM documents)""")
def greatest_price(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("Vendo $ "), (F.col("doc_id") * 1000 + 20_000_000).cast("string"), F.lit(" o $ 15.000.000 negociable"))
    rows = table(spark, sf, "documents").select("doc_id", said.alias("text"))
    return portals.extract(rows, "amorel", id_col="doc_id").select(F.col("id").alias("doc_id"), "precio", "negociable")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'oferta_mixta_no_es_venta_pura' WHEN p_partkey % 3 = 2 THEN 'sin_palabra_venta' END AS motivo FROM part""")
def sale_gate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, "Vendo o permuto lote").when(k == 1, "Vendo lote").otherwise("Lote")
    return table(spark, sf, "part").select("p_partkey", portals.amorel_sale(title, F.lit(None).cast("string"), F.lit("")).alias("motivo"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '80 m2' ELSE CAST(p_size AS VARCHAR) END AS valor FROM part""")
def value_after_label(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Precio: 3"), F.lit("ÁREA: 80 m2"))).otherwise(F.array(F.lit("área"), F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", after_label("Área:")(lines).alias("valor"))


@query("""SELECT n_name, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey % 10 + 1 AS INTEGER) ELSE 2 END AS n FROM nation""")
def number_words(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") % 10 + 1).cast("string")).otherwise(" Dos ")
    return table(spark, sf, "nation").select("n_name", "n_nationkey", numbers.number_word(said).cast("int").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'http://x/' || CAST(o_orderkey AS VARCHAR) ELSE 'sin-url:' || CAST(o_orderkey AS VARCHAR) END AS link, CASE WHEN o_orderkey % 2 = 1 THEN 'Link original: llamar' END AS nota FROM orders""")
def placeholder_links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    link = F.when(k % 2 == 0, F.concat(F.lit("http://x/"), k.cast("string"))).otherwise("llamar")
    new, note = curate.placeholder_links(link, k, F.lit(None).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", new.alias("link"), note.alias("nota"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id * 2 END AS codigo FROM documents""")
def embedded_listing(spark: SparkSession, sf: str) -> DataFrame:
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<p><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"code":'), (F.col("doc_id") * 2).cast("string"), F.lit("}}}}</script>"))).otherwise("<p>")
    data = web.property_data(html)
    return table(spark, sf, "documents").select("doc_id", F.try_variant_get(data, "$.code", "long").alias("codigo"))


@query("""SELECT p_partkey, regexp_replace(p_name || ' ¡x!.jpg', '[^a-zA-Z0-9_-]', '_', 'g') AS archivo FROM part""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.file_name(F.concat("p_name", F.lit(" ¡x!.jpg"))).alias("archivo"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'C-' || CAST(p_partkey AS VARCHAR) END AS codigo_externo, CASE WHEN p_partkey % 9 <> 0 THEN 100000000 + p_partkey * 1000 END AS precio,
  CASE WHEN p_partkey % 2 = 0 THEN 'Casa Lote' ELSE 'Lote' END AS tipo_inmueble, 'San ' || p_brand AS barrio, p_name AS descripcion, p_size + 0.5 AS m2, CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5 ELSE p_size * 2.0 END AS m2_construido,
  CAST(p_size % 6 AS INTEGER) AS habitaciones, CAST(p_size % 3 AS INTEGER) AS estrato, CASE WHEN p_partkey % 5 = 0 THEN 'fuera_de_pasto' WHEN p_partkey % 9 = 0 THEN 'sin_precio' END AS skip_reason FROM part""")
def listing_page_records(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    said = lambda c: c.cast("string")
    parts = [
        F.when(k % 7 != 0, F.concat(F.lit("Código Fincaraíz: C-"), said(k))),
        F.when(k % 9 != 0, F.concat(F.lit("$ "), said(100_000_000 + k * 1000))),
        F.lit("Tipo de Inmueble"), F.when(k % 2 == 0, "casa lote").otherwise("Lote urbano"),
        F.lit("Área Privada"), F.concat(said(size), F.lit(",5 m2")),
        F.when(k % 4 != 0, F.concat(F.lit("Área Construida: "), said(size * 2), F.lit(" m2"))),
        F.lit("Habitaciones"), said(size % 6), F.concat(F.lit("Estrato: "), said(size % 3)),
        F.lit("Descripción"), F.col("p_name"), F.lit("Contactar"), F.lit("otro"),
    ]
    pages = table(spark, sf, "part").select(
        k.alias("id"),
        F.concat(F.when(k % 5 == 0, "http://x/ipiales/").otherwise("http://x/pasto/"), said(k)).alias("url"),
        F.concat(F.lit("Lote en venta en San "), "p_brand", F.when(k % 5 == 0, ", Pastoral").otherwise(", Pasto")).alias("title"),
        F.concat_ws("\n", *parts).alias("text"),
        F.lit(None).cast("string").alias("html"),
    )
    found = listing_pages.records(pages)
    return found.select("id", "codigo_externo", "precio", "tipo_inmueble", "barrio", "descripcion", "m2", "m2_construido", "habitaciones", "estrato", "skip_reason")


@query(None)
def marketplace_fields(spark: SparkSession, sf: str) -> DataFrame:
    return portals.extract(table(spark, sf, "documents"), "facebook", id_col="doc_id")
