from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrado.functions import geo, numbers, text
from terrado.functions.similarity import text_similarity


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_address_keys_agree(spark):
    assert one(spark, "Carrera 24 # 18-40", text.address_key) == one(spark, "Cra. 24 No. 18-40", text.address_key)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("1.104 m2", 1104.0), ("1.234,56", 1234.56), ("118.65 m2", 118.65), ("100 m2", 100.0), ("1.234.567", None), ("sin", None), (None, None)],
)
def test_colombian_decimal(spark, given, expected):
    assert one(spark, given, numbers.colombian_decimal) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("  Casa&nbsp;en\tventa \n", "Casa en venta"), ("120 m&sup2;", "120 m²"), ("   ", None), (None, None)],
)
def test_clean_text(spark, given, expected):
    assert one(spark, given, text.clean_text) == expected


@pytest.mark.parametrize(("given", "expected"), [("Villa Flor II etapa", "villa flor 2"), ("Ñandú XXIII", "nandu 23"), ("", ""), (None, "")])
def test_place_key(spark, given, expected):
    assert one(spark, given, text.place_key) == expected


@pytest.mark.parametrize(("given", "expected"), [("o'higgins de PASTO", "O'Higgins De Pasto"), ("santa mónica", "Santa Mónica")])
def test_title_case(spark, given, expected):
    assert one(spark, given, text.title_case) == expected


def test_barrio_keys(spark):
    assert one(spark, "Barrio  San-Luis", text.barrio_filter_key) == "san luis"
    assert one(spark, "Vereda La Laguna", text.barrio_catalog_key) == "la laguna"
    assert one(spark, "..", text.barrio_filter_key) is None


def test_place_text(spark):
    assert one(spark, " barrio de Palermo, precio negociable", text.place_text) == "Palermo"


def test_lines(spark):
    assert one(spark, " a \r\n\n b\t", text.lines) == ["a", "b"]


@pytest.mark.parametrize(
    ("given", "street"),
    [("Carrera 5 # 12-34", True), ("Manzana 3 lote 7", True), ("La Colina, Pasto, Narino", False), (None, False)],
)
def test_street_level(spark, given, street):
    assert one(spark, given, lambda x: geo.is_street_level(text.address_key(x))) is street


def test_haversine_and_closeness(spark):
    row = spark.range(1).select(
        F.round(geo.haversine_metres(F.lit(1.2136), F.lit(-77.2811), F.lit(1.2136), F.lit(-77.2801))).alias("m"),
        geo.haversine_metres(F.lit(None).cast("double"), F.lit(1), F.lit(1), F.lit(1)).alias("none"),
        geo.relative_close(F.lit(100), F.lit(109)).alias("close"),
        geo.relative_close(F.lit(0), F.lit(0)).alias("zero"),
        geo.hash_distance(F.lit("ffffffffffffffff"), F.lit("7fffffffffffffff")).alias("bits"),
    ).first()
    assert (row.m, row.none, row.close, row.zero, row.bits) == (111.0, None, True, False, 1)


def test_similarity_is_symmetric(spark):
    rows = spark.createDataFrame([("casa grande en el centro", "gran casa del centro"), ("", "x"), ("igual", "Igual")], "a string, b string")
    out = rows.select(text_similarity(F.col("a"), F.col("b")).alias("x"), text_similarity(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r.x == r.y for r in out)
    assert (out[1].x, out[2].x) == (0.0, 1.0)


def test_coordinates(spark):
    found = one(spark, "1.2136, -77.2811", numbers.coordinates)
    assert (found.lat, found.lon) == (1.2136, -77.2811)
    assert one(spark, "99.5, 10.1", numbers.coordinates) is None
