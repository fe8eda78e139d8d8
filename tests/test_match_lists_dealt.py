"""Match lists: as many tasks as listings ask for, and the lists of a plain walk."""

from __future__ import annotations

import pytest
from terrado.operators import matches


@pytest.mark.parametrize("few", [0, 1000])
def test_lists_are_dealt_by_listings(spark, monkeypatch, few):
    monkeypatch.setattr(matches, "LISTINGS", 10)
    monkeypatch.setattr(matches, "BROADCAST", few)
    states = ("confirmada", "pendiente", "descartada")
    rows = [(k, k % 90, 3 * k % 97, float(60 + k % 5), states[k % 3], 0) for k in range(200)]
    edges = spark.createDataFrame(rows, "id long, publicacion_id long, candidata_id long, puntaje double, estado string, imagenes_coincidentes int")
    edges = edges.withColumn("puntaje", edges.puntaje.cast("decimal(5,2)"))
    ids = [*range(80), 7, 7, 500, None]
    found = matches.match_lists(spark.createDataFrame([(i,) for i in ids], "id long"), edges)
    assert found.rdd.getNumPartitions() == -(-len(ids) // 10)
    expected = []
    for i in ids:
        ends = [(s != "confirmada", -p, k, y) for k, a, b, p, s, _ in rows for x, y in ((a, b), (b, a)) if s != "descartada" and x == i]
        expected.append((i is None, i or 0, [(k, y) for _, _, k, y in sorted(ends)]))
    assert sorted((r.id is None, r.id or 0, [(x.edge_id, x.otra_id) for x in r.coincidencias]) for r in found.collect()) == sorted(expected)
