"""Queries over free texts and JSON of the marketplace: areas by spans, coordinates by a walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue.common import registry, table
from terrado.extract import areas
from terrado.functions.json_walk import json_point

QUERIES, SQL, query = registry()

#: What stands before a document's own text, so that each pass has texts to find something in; $n and $m are numbers of the document.
OFFERS = (
    "Vendo lote de $n x $m metros", "Casa: área construida $n,5 m2, terreno $m m2", "Área privada $n mts2", "Frente: $n mts fondo $m", "Casa, medidas $n*$m y piscina de 8 x 4",
    "Closet de $n x $m, $n m2", "Apartamento $n por $m", "Área total: $m", "Terreno $n mt2 construido 90", "Lote $m x $n y solar de $n.5 metros cuadrados", "Cama de 2 x 2 m y televisor; en total $m M²", "Sala de $n x $m",
)


def offer(text: Column, n: Column, m: Column) -> Column:
    one = F.get(F.array(*map(F.lit, OFFERS)), F.pmod(n + m, F.lit(len(OFFERS))).cast("int"))
    return F.concat(F.replace(F.replace(one, F.lit("$n"), n.cast("string")), F.lit("$m"), m.cast("string")), F.lit(". "), F.coalesce(text, F.lit("")))


def _areas_sql() -> str:
    """The passes in SQL without look-around: a mark stands after each digit that a second side follows, and pieces between matches give their places."""
    a = areas
    tail = rf"\s*{a.LINEAR_UNIT}?\s*{a.TIMES}\s*[0-9]"
    marked = lambda x: f"regexp_replace(regexp_replace({x}, '([0-9])({tail})', '\\1\x01\\2', 'g'), '([0-9])({tail})', '\\1\x01\\2', 'g')"
    head = lambda words: rf"(\b(?:{words})\s*[:\-]?\s*(?:DE\s+)?{a.NUMBER})(?:[^\x01]|$)"
    number = lambda x: f"try_cast(replace({x}, ',', '.') AS DOUBLE)"
    area = lambda x: f"CASE WHEN {number(x)} BETWEEN {a.AREAS[0]} AND {a.AREAS[1]} THEN {number(x)} END"
    named = lambda src, words: area(f"regexp_extract({src}, '{head(words)}', 2)")
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    # an ASCII letter that no text in upper case has stands for ², so that the end of a word is one there as well
    area_unit = a.AREA_UNIT.replace("²", "q")
    bare_area = a.BARE_AREA.replace(a.WORD_END, r"\b").replace("²", "q")

    def places(pattern: str) -> str:
        start = "coalesce(list_sum([length(x) FOR x IN s[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0)"
        around = f"substr(rest, greatest(st - {a.BEFORE}, 0) + 1, least(st, {a.BEFORE}) + length(w[i]) + {a.AFTER})"
        return f"""(SELECT id, i, w[i] AS w, a[i] AS a, b[i] AS b, {around} AS around, substr(rest, greatest(st - {a.BEFORE}, 0) + 1, least(st, {a.BEFORE})) AS before FROM (
    SELECT *, CAST({start} AS BIGINT) AS st FROM (
      SELECT id, rest, regexp_extract_all(rest, '{pattern}', 0) AS w, regexp_extract_all(rest, '{pattern}', 1) AS a, regexp_extract_all(rest, '{pattern}', {2 if pattern != bare_area else 1}) AS b, string_split_regex(rest, '{pattern}') AS s
      FROM rests), LATERAL unnest(range(1, len(w) + 1)) AS r(i)))"""

    side = lambda x: f"{number(x)} BETWEEN {a.SIDES[0]} AND {a.SIDES[1]}"
    said = f"replace(replace({listed(OFFERS)}[CAST((doc_id % 37 + 3 + n_chars % 90 + 5) % {len(OFFERS)} AS INTEGER) + 1], '$n', CAST(doc_id % 37 + 3 AS VARCHAR)), '$m', CAST(n_chars % 90 + 5 AS VARCHAR)) || '. ' || coalesce(text, '')"
    return rf"""
WITH src AS (SELECT doc_id AS id, replace(upper(strip_accents(trim(regexp_replace({said}, '\s+', ' ', 'g')))), '²', 'q') AS t FROM documents),
m AS (SELECT id, t, {marked("t")} AS k FROM src),
b AS (SELECT *, {named("k", a.BUILT_WORDS)} AS built, length(replace(string_split_regex(k, '{head(a.BUILT_WORDS)}')[1], '{chr(1)}', '')) AS st, regexp_extract(k, '{head(a.BUILT_WORDS)}', 1) AS p FROM m),
b2 AS (SELECT *, length(p) + length(regexp_extract(substr(t, st + length(p) + 1), '^\s*{area_unit}?', 0)) AS n FROM b),
rests AS MATERIALIZED (SELECT id, built, CASE WHEN built IS NULL THEN t ELSE substr(t, 1, st) || repeat(' ', n) || substr(t, st + n + 1) END AS rest FROM b2),
sides AS (SELECT * FROM (
  SELECT id, sure, width, length, row_number() OVER (PARTITION BY id ORDER BY sure DESC, kind, i) AS r FROM (
    SELECT id, kind, i, {number("a")} AS width, {number("b")} AS length,
      CASE WHEN regexp_matches(around, '{a.OTHER_THINGS}') THEN NULL WHEN regexp_matches(around, '{a.STRONG_WORDS}') OR regexp_matches(w, 'FRENTE|FONDO') THEN 1 WHEN regexp_matches(around, '{a.WEAK_WORDS}') THEN 0 END AS sure
    FROM (SELECT 1 AS kind, * FROM {places(a.FRONT_AND_DEPTH)} UNION ALL SELECT 2, * FROM {places(a.SIDE_BY_SIDE)}) WHERE {side("a")} AND {side("b")})
  WHERE sure IS NOT NULL) WHERE r = 1),
bare AS (SELECT id, min_by(v, i) AS bare FROM (SELECT id, i, {area("a")} AS v, before FROM {places(bare_area)}) WHERE v IS NOT NULL AND NOT regexp_matches(before, '{a.OTHER_THINGS}') GROUP BY id),
found AS (
  SELECT id, built, {named("k", a.LOT_WORDS)} AS lot, {named("k", a.AREA_WORDS)} AS other FROM (SELECT *, {marked("rest")} AS k FROM rests)),
told AS (
  SELECT f.id, built, lot IS NULL AND width IS NOT NULL AS by_sides, width, length, sure, coalesce(lot, width * length, other, bare) AS lot FROM found f LEFT JOIN sides USING (id) LEFT JOIN bare USING (id))
SELECT id, CASE WHEN by_sides THEN width END AS lot_width_m, CASE WHEN by_sides THEN length END AS lot_length_m, lot AS lot_area_m2, built AS built_area_m2,
  CASE WHEN built IS NOT NULL AND lot IS NOT NULL THEN 'multiple_sources' WHEN built IS NOT NULL THEN 'explicit_built_area' WHEN by_sides THEN 'lot_dimensions' WHEN lot IS NOT NULL THEN 'explicit_lot_area' ELSE 'unknown' END AS area_source,
  CASE WHEN by_sides AND sure = 0 THEN 'MEDIUM' WHEN built IS NOT NULL OR lot IS NOT NULL THEN 'HIGH' END AS area_confidence
FROM told"""


@query(_areas_sql())
def market_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts behind an offer of each kind."""
    said = offer(F.col("text"), F.col("doc_id") % 37 + 3, F.col("n_chars") % 90 + 5)
    return areas.areas(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), said.alias("text")))


#: JSON around a document's text; $a and $b are a plausible latitude and longitude, $x is no latitude.
SHAPES = (
    '{"lon":$b,"origen":{"lat":$x,"lon":$b},"lat":$a}', '[[{"mapa":{"coordinates":[$b,$a]}}]]', '{"z":{"punto":{"lat":$x,"long":$b}},"a":[1,null,{"latitud":"$a","longitud":"$b"}]}',
    '{"coordenadas":"$a , $b","lat":0}', '{"uno":{"dos":{"tres":{"cuatro":{"lng":$b,"latitude":$a}}}},"lat":$x,"lon":$b}', '{"coordinates":[$x,$x],"otra":"{}","lat":"","lon":$b}',
)


@query(rf"""
WITH docs AS (
  SELECT doc_id, '{{"pagina":' || json_object('texto', coalesce(text, '')) || ',"ficha":' || replace(replace(replace([{", ".join(f"'{s}'" for s in SHAPES)}][CAST(doc_id % {len(SHAPES)} AS INTEGER) + 1],
    '$a', '1.' || CAST(n_chars % 90 + 10 AS VARCHAR)), '$b', '-77.' || CAST(doc_id % 90 + 10 AS VARCHAR)), '$x', '95.5') || '}}' AS j FROM documents),
t AS (SELECT doc_id, t.id, t.parent, t.key, t.type, json_extract_string(t.value, '$') AS v FROM docs, json_tree(docs.j) t),
own AS (
  SELECT doc_id, parent AS id, [max(CASE WHEN key = 'latitude' THEN v END), max(CASE WHEN key = 'latitud' THEN v END), max(CASE WHEN key = 'lat' THEN v END)] AS lats,
    [max(CASE WHEN key = 'longitude' THEN v END), max(CASE WHEN key = 'longitud' THEN v END), max(CASE WHEN key = 'lng' THEN v END), max(CASE WHEN key = 'lon' THEN v END), max(CASE WHEN key = 'long' THEN v END)] AS lons,
    coalesce(max(CASE WHEN key = 'coordinates' THEN v END), max(CASE WHEN key = 'coordenadas' THEN v END)) AS pair
  FROM t WHERE parent IS NOT NULL GROUP BY doc_id, parent),
named AS (SELECT doc_id, id, try_cast([x FOR x IN lats IF x IS NOT NULL AND x NOT IN ('', '0')][1] AS DOUBLE) AS lat, try_cast([x FOR x IN lons IF x IS NOT NULL AND x NOT IN ('', '0')][1] AS DOUBLE) AS lon, pair FROM own),
pairs AS (
  SELECT doc_id, id, 1 AS kind, lat, lon FROM named
  UNION ALL SELECT doc_id, id, 2, try_cast(json_extract_string(pair, '$[1]') AS DOUBLE), try_cast(json_extract_string(pair, '$[0]') AS DOUBLE) FROM named WHERE starts_with(pair, '[')
  UNION ALL SELECT doc_id, id, 3, try_cast(json_extract_string(pair, '$[0]') AS DOUBLE), try_cast(json_extract_string(pair, '$[1]') AS DOUBLE) FROM named WHERE starts_with(pair, '[')
  UNION ALL SELECT doc_id, id, 4, try_cast(trim(string_split(pair, ',')[1]) AS DOUBLE), try_cast(trim(string_split(pair, ',')[2]) AS DOUBLE) FROM named WHERE NOT starts_with(pair, '[')),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id, kind) AS r FROM pairs WHERE lat BETWEEN -5 AND 15 AND lon BETWEEN -82 AND -66)
SELECT d.doc_id, lat, lon FROM docs d LEFT JOIN best b ON b.doc_id = d.doc_id AND r = 1""")
def json_points(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of a JSON around each document's whole text, at several depths, in several orders."""
    k = F.col("doc_id")
    shape = F.get(F.array(*map(F.lit, SHAPES)), F.pmod(k, F.lit(len(SHAPES))).cast("int"))
    for name, value in (("$a", F.concat(F.lit("1."), (F.col("n_chars") % 90 + 10).cast("string"))), ("$b", F.concat(F.lit("-77."), (k % 90 + 10).cast("string"))), ("$x", F.lit("95.5"))):
        shape = F.replace(shape, F.lit(name), value)
    page = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("texto")))
    whole = F.concat(F.lit('{"pagina":'), page, F.lit(',"ficha":'), shape, F.lit("}"))
    point = json_point(whole)
    return table(spark, sf, "documents").select("doc_id", point.alias("p")).select("doc_id", "p.lat", "p.lon")
