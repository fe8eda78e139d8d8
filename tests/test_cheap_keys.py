"""Keys and lines by their cheap ways equal those by the plain patterns, also for rare white space, and classified ads take no long way for each line."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terrado.catalogue import portal_pages
from terrado.extract import classifieds
from terrado.functions import text as T

TEXTS = [
    None, "", " ", "a", " a  b ", "a\tb", "a\t\tb", "a b", "a  b", "a b", "a  b c  d", "é  è", "é　è", "m² y m³", "ñ\x85o", "x y\x0bz",
    "a\nb", "a\r\nb", "a\rb", "a\x0bb\fc", "a\x1cb\x1dc\x1ed", "a\x85b", "a b c", "\n\n", "árbol\r\n\nb ", "bárrio SECTOR", "barrío", "ſector", "se​ctor",
]


def test_cheap_ways_equal_plain_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    t = F.col("t")
    plain = F.trim(F.regexp_replace(t, T.BLANK_RUNS, " "))
    split = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\R|[\x1c-\x1e\x85]"), T.strip), lambda x: x != "")
    key = F.upper(T.unaccent(F.trim(F.regexp_replace(F.translate(t, "²³", "23"), T.BLANK_RUNS, " "))))
    said = T.key_says(t, ["BARRIO", "SECTOR"])
    shown = rows.select("t", T.squeeze(t).alias("a"), plain.alias("b"), T.lines(t).alias("c"), split.alias("d"), T.upper_key(t, superscripts=True).alias("e"), key.alias("f"), said.alias("g"), key.rlike("BARRIO|SECTOR").alias("h"))
    for r in shown.collect():
        assert (r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h), repr(r.t)


def test_headlines_with_a_long_s(spark):
    rows = spark.createDataFrame([(1, ["Casa Fſe 12", "2024-01-02 - Casas Venta"]), (2, ["casa fse 7", "x"]), (3, ["casa", "FSE 8", "-"]), (4, ["casa 9", "x"])], "id int, l array<string>")
    found = {r.id: r.h and r.h.titulo for r in rows.select("id", classifieds.headline(F.col("l")).alias("h")).collect()}
    assert found == {1: "Casa", 2: "casa", 3: "casa", 4: None}


def test_no_pattern_of_many_classes_runs_for_each_line(spark, tmp_path):
    """White space beyond Latin-1 is looked for by pattern only behind a test for it, and offers are told by words, not by one long alternation."""
    spark.range(3).selectExpr("id AS doc_id", "'Casa' AS text", "4L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = portal_pages.classified_ads(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "PERMUTA|" not in plan and "ARRIENDO" in plan
    long = [m.start() for m in re.finditer(re.escape(T.BLANK_RUNS), plan)]
    assert long and all("Contains(" in plan[max(at - 2500, 0) : at] for at in long)
