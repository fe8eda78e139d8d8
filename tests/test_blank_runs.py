"""White space and accents by cheap ways are what the patterns say, and label keys are made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrado.catalogue import extraction
from terrado.functions import text


def test_strip_squeeze_unaccent_as_patterns(spark):
    odd = ["", " ", "a b", " a  b \n", "\x1cx\x1c", "　é́ ", "\x85a\x0bb\t\tc\x85", "a​b ᠎", "ñ²  Ç", "x\r\n", None]
    every = odd + [f"{chr(c)}a{chr(c)}b{chr(c)}{chr(c)}" for c in [*range(0x300), *range(0x1600, 0x1700), *range(0x1800, 0x1810), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    rows = spark.createDataFrame([(t,) for t in every], "t string")
    t = F.col("t")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    plain = lambda form: F.regexp_replace(F.translate(t, *text._unaccent_table(form)), r"\p{Mn}+", "")  # noqa: E731, SLF001
    same = rows.select(
        text.strip(t).eqNullSafe(strip(t)).alias("strip"),
        text.squeeze(t).eqNullSafe(strip(F.regexp_replace(t, r"(?U)\s+", " "))).alias("squeeze"),
        text.unaccent(t).eqNullSafe(plain("NFD")).alias("nfd"),
        text.unaccent(t, "NFKD").eqNullSafe(plain("NFKD")).alias("nfkd"),
    )
    assert [r.asDict() for r in same.distinct().collect()] == [{"strip": True, "squeeze": True, "nfd": True, "nfkd": True}]


def test_labels_share_their_keys(spark, tmp_path):
    """The type's label is looked up once, not once for each type of the list."""
    spark.createDataFrame([(1, "p", "b", 3)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    plan = extraction.listing_page_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.count("tipo de inmueble") <= 2
