"""No partner of a listing is left out, however many listings share its keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrado.catalogue import matching
from terrado.operators import entity
from tests.test_pairs_once import market

N = 1205


def crowd(spark, tmp_path):
    """More customers of one city and neighbourhood than a candidate list takes."""
    spark.range(0, N * 600, 600).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_numeric_score_scores_every_pair(spark, tmp_path):
    found = matching.numeric_score(spark, crowd(spark, tmp_path)).agg(F.count("*"), F.count_distinct("a", "b"), F.min("puntaje"), F.max("puntaje")).first()
    assert tuple(found) == (N * (N - 1) // 2, N * (N - 1) // 2, 68, 68)


def test_detect_duplicates_finds_every_pair(spark, tmp_path):
    found = matching.detect_duplicates(spark, crowd(spark, tmp_path)).agg(F.count("*"), F.count_distinct("publicacion_id", "candidata_id")).first()
    assert tuple(found) == (N * (N - 1) // 2,) * 2


@pytest.mark.parametrize(("some", "unit", "cell"), [(False, 500, 2000), (True, 500, 2000), (False, 1, 3), (True, 2, 5)])
def test_same_pairs_as_unlimited_lists(spark, monkeypatch, some, unit, cell):
    """Some ask only, some have images, some no city; also where equal listings are several units and keys several cells."""
    monkeypatch.setattr(entity, "UNIT", unit)
    monkeypatch.setattr(entity, "CELL", cell)
    listings, hashes = market(spark)
    probes = listings.where("id % 3 = 0") if some else None
    wanted = {(r.a, r.b) for r in entity.unordered_pairs(entity.candidate_pairs(listings, hashes, probes)).collect()}
    units = entity.alike_units(listings, hashes, probes)
    assert units.count() < 150 or unit == 1
    found = [(r.a, r.b) for r in entity.each_pair(entity.pairs_of_units(units).select("a", "b", "a_members", "b_members")).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_edges_equal_those_of_single_pairs(spark):
    listings, hashes = market(spark)
    listings = listings.withColumns({"latitud": F.when(F.col("latitud").isNotNull(), F.lit(1.2) + F.col("id") % 3 / 1000).cast("decimal(10,7)"), "descripcion": F.when(F.col("id") % 4 < 2, F.concat(F.lit("amplia y luminosa "), (F.col("id") % 5).cast("string")))})
    hashes = hashes.withColumns({"hash_contenido": F.concat(F.lit("f"), F.col("publicacion_id") % 3), "hash_perceptual": F.lit("00000000000000ff")})
    pairs = entity.unordered_pairs(entity.candidate_pairs(listings, hashes))
    wanted = entity.classify(entity.score_pairs(entity.compare_images(pairs, hashes), listings))
    found = entity.detect_duplicates(listings, hashes)
    assert found.columns == wanted.columns and wanted.count() > 10
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
