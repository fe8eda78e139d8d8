"""Pairs of listings are made once, and none is shuffled."""

from __future__ import annotations

import random

import pytest

from terrado.catalogue import matching
from terrado.operators import entity

ROW = "id long, ciudad string, barrio string, direccion string, tipo_inmueble string, ph string, antiguedad string, descripcion string, latitud decimal(10,7), longitud decimal(10,7), m2 decimal(10,2), m2_construido decimal(10,2), habitaciones int, banios int, parqueadero int, estrato int, pisos int, precio decimal(15,0), administracion decimal(15,0)"
IMAGE = "publicacion_id long, evidencia_id long, hash_contenido string, hash_perceptual string"


def market(spark, n: int = 150):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        place = (1, -77) if rng.random() < 0.3 else (None, None)
        some = [rng.choice(["Pasto", " pasto", "Cali", None]), rng.choice([None, "A", "b", "c"]), rng.choice([None, None, "calle 1", "kr 2"])]
        rows.append((i, *some, "Casa", None, None, None, *place, 50 + i % 3, None, i % 2, i % 2, None, i % 4, None, 100 + i % 5, None))
    hashes = [(i, i, "f", None) for i in range(n) if rng.random() < 0.1]
    from decimal import Decimal

    rows = [tuple(Decimal(v) if k in (8, 9, 10, 17) and v is not None else v for k, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(hashes, IMAGE)


@pytest.mark.parametrize(("most", "some", "few"), [(7, False, 300_000), (20, True, 300_000), (7, True, 0)])
def test_same_pairs_as_distinct(spark, monkeypatch, most, some, few):
    """Also where only one end asks or only one end finds the other, and where candidates are too many to broadcast."""
    monkeypatch.setattr(entity, "FEW_CANDIDATES", few)
    listings, hashes = market(spark)
    probes = listings.where("id % 3 = 0") if some else None
    wanted = {(r.a, r.b) for r in entity.unordered_pairs(entity.candidate_pairs(listings, hashes, probes, most)).collect()}
    found = [(r.a, r.b) for r in entity.paired_once(listings, hashes, probes, most).select("a", "b").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_no_pair_is_shuffled(spark, tmp_path):
    spark.range(1, 400).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    for query in (matching.numeric_score, matching.blocking_pairs):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        above = plan[: plan.index("Generate explode")]
        assert "Exchange hashpartitioning" not in above, query.__name__
