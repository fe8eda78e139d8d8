from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrado.operators import buildings, curate, entity, graph, location, search, windows
from terrado.schemas import split_valid

PLACES = [
    ("torobajo", "Torobajo", "barrio"),
    ("villaflor 2", "Villaflor II", "barrio"),
    ("las violetas 2", "Las Violetas II", "barrio"),
    ("palermo", "Palermo", "barrio"),
    ("versalles", "Versalles", "barrio"),
    ("parque infantil", "Parque Infantil", "barrio"),
    ("la laguna", "La Laguna", "corregimiento"),
    ("gualmatan", "Gualmatán", "corregimiento"),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(PLACES)], "key string, canonical string, kind string, ord long")


CASES = [
    # candidate, title, description, city -> value, confidence, outside
    (("Toro bajo", None, None, None), ("Torobajo", 95, None)),
    (("Villa Flor 2", None, None, None), ("Villaflor II", 95, None)),
    (("Violetas Ii", None, None, None), ("Las Violetas II", 95, None)),
    (("Vereda La Laguna", None, None, None), ("La Laguna", 100, None)),
    (("San Luis", None, None, None), (None, 0, None)),
    (("sector Palermo norte", None, None, None), ("Palermo", 90, None)),
    ((None, None, "Casa en el barrio Palermo, amplia", None), ("Palermo", 90, None)),
    ((None, "Lote Gualmatan", None, None), ("Gualmatán", 85, None)),
    ((None, None, "frente al parque infantil", None), (None, 0, None)),
    ((None, None, "apartamento por Unicentro", None), ("Unicentro", 80, None)),
    (("Palermo", None, None, "Chachagüí"), (None, 100, "Chachagui")),
    ((None, None, "hermosa casa en bello sector", None), (None, 0, None)),
    ((None, "Casa en Bello, Antioquia", None, None), (None, 100, "Bello")),
    (("Conjunto Palermo", None, None, None), (None, 0, None)),
]


def test_locations(spark, places):
    rows = spark.createDataFrame([(i, c, t, d, None, city) for i, ((c, t, d, city), _) in enumerate(CASES)], "id long, candidate string, title string, description string, address string, city string")
    out = {r.id: (r.value, r.confidence, r.outside) for r in location.resolve_locations(rows, places).collect()}
    assert out == {i: e for i, (_, e) in enumerate(CASES)}


def test_buildings(spark, places):
    names = spark.createDataFrame([("torres de aquine", "Torres de Aquine", 0), ("versalles", "Versalles", 1), ("nuevo", "Nuevo", 2), ("aquine", "Aquine", 3)], "key string, canonical string, ord long")
    rows = spark.createDataFrame(
        [
            (1, ["Apartamento en Torres de Aquine"], None),
            (2, ["Casa en Versalles"], None),
            (3, ["Torres de Aquine, no es PH"], None),
            (4, ["Apartamento nuevo"], None),
            (5, [None], "Conjunto Torres de Aquine"),
            (6, ["Torres de Aquine sin administración"], None),
        ],
        "id long, texts array<string>, complex_name string",
    )
    out = {r.id: r.ph for r in buildings.detect_buildings(rows, buildings.usable_names(names, places)).collect()}
    assert out == {1: "Torres de Aquine", 2: None, 3: None, 4: None, 5: "Torres de Aquine", 6: None}


def test_filters_as_typed():
    assert search.leading_integer("12abc") == 12
    assert search.count_filter("3+") == ("ge", 3)
    assert search.count_filter("x") is None
    assert search.money_filter("$ 250") == 250_000_000
    assert search.money_filter("0") == 0
    assert search.area_filter("1,5 m") == 1.5
    assert search.area_filter("0") is None
    assert search.day_filter("2024-02-30") is None
    assert search.day_filter("2024-02-29") == date(2024, 2, 29)


FIELDS = dict.fromkeys(entity.FIELDS)


def scored(spark, first: dict, second: dict, count: int = 0, near: int = 0, least: float | None = None):
    kinds = {"latitud": "double", "longitud": "double", "m2": "double", "m2_construido": "double", "precio": "double", "administracion": "double", "habitaciones": "int", "banios": "int", "parqueadero": "int", "estrato": "int", "pisos": "int"}
    schema = "id long, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in entity.FIELDS)
    rows = [(i, *[(FIELDS | x)[f] for f in entity.FIELDS]) for i, x in ((1, first), (2, second))]
    pairs = spark.createDataFrame([(1, 2, count, near, None)], "a long, b long, count int, near_count int, minimum_distance int")
    return entity.score_pairs(pairs, spark.createDataFrame(rows, schema), least)


def signals(df):
    row = df.first()
    return float(row.puntaje), [r.signal for r in row.razones]


def test_score_policies(spark):
    base = {"ciudad": "Pasto", "direccion": "Carrera 5 # 12-34", "m2": 80.0, "precio": 200e6, "habitaciones": 3, "banios": 2, "tipo_inmueble": "Casa"}
    score, names = signals(scored(spark, base, base | {"precio": 350e6}, count=1))
    assert "different_price" in names
    score, names = signals(scored(spark, base, base | {"precio": 210e6}, count=1))
    assert score >= 80 and "very_similar_price" in names and "same_address" in names
    edge = entity.classify(scored(spark, base, base | {"precio": 210e6}, count=1)).first()
    assert edge.estado == "confirmada"
    edge = entity.classify(scored(spark, base, base | {"precio": 210e6}, near=3)).first()
    assert edge.estado == "pendiente"
    score, _ = signals(scored(spark, {"latitud": 1.2, "longitud": -77.2, "tipo_inmueble": "Casa"}, {"latitud": 1.2, "longitud": -77.2, "tipo_inmueble": "Casa"}))
    assert score == 34
    score, names = signals(scored(spark, {"m2": 0.0}, {"m2": 0.0}))
    assert names == ["different_area"] and score == 0


def test_pruning_loses_no_pair(spark):
    text = "casa amplia con patio y garaje en el centro de la ciudad"
    base = {"ciudad": "Pasto", "barrio": "Centro", "direccion": "Calle 20 # 5-10", "descripcion": text, "m2": 90.0, "precio": 100e6, "habitaciones": 3, "banios": 2}
    other = base | {"direccion": "Calle 20 # 5-11", "descripcion": text + " negociable"}
    whole, pruned = scored(spark, base, other), scored(spark, base, other, least=60.0)
    assert signals(whole)[0] >= 60
    assert signals(whole) == signals(pruned)
    assert scored(spark, base, {"ciudad": "Cali"}, least=60.0).count() == 0


def test_image_matching(spark):
    a = [("x", "00000000000000ff"), ("y", "ffffffffffffffff"), ("x", None)]
    b = [("x", "00000000000000fe"), ("z", "fffffffffffffff0"), (None, "0000000000000000")]
    rows = [(1, i, *x) for i, x in enumerate(a)] + [(2, i, *x) for i, x in enumerate(b)]
    hashes = spark.createDataFrame(rows, "publicacion_id long, evidencia_id long, hash_contenido string, hash_perceptual string")
    out = entity.compare_images(spark.createDataFrame([(1, 2), (3, 2)], "a long, b long"), hashes)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 1, 1, 1), (3, 2, 0, 0, None)}


def test_groups_split_and_components(spark):
    schema = "id long, publicacion_id long, candidata_id long, estado string"
    edges = spark.createDataFrame([(1, 1, 2, "confirmada"), (2, 2, 3, "descartada"), (3, 3, 4, "confirmada"), (4, 5, 6, "pendiente"), (5, 4, 9, "confirmada")], schema)
    assert {(r.publicacion_id, r.inmueble_id) for r in graph.groups(edges).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (9, 3)}
    members = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4, 9, 11)], "publicacion_id long, inmueble_id long")
    assert {(r.publicacion_id, r.parte) for r in graph.split_groups(members, edges).collect()} == {(3, 0), (4, 0), (9, 0), (1, 1), (2, 1)}


@pytest.mark.parametrize("n", [1, 2, 17])
def test_components_of_a_chain(spark, n):
    chain = spark.range(n).select(F.col("id").alias("publicacion_id"), (F.col("id") + 1).alias("candidata_id"))
    out = graph.connected_components(chain).collect()
    assert {r.node for r in out} == set(range(n + 1)) and {r.component for r in out} == {0}


def test_run_lengths(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, None, 1])], "i long, v int")
    out = windows.run_length(rows.withColumn("g", F.lit(1)), ["g"], [F.col("i")], F.col("v") == 1).orderBy("i").collect()
    assert [r.racha for r in out] == [1, 2, 0, 1, 2, 3, 0, 1]
    kept = windows.until_run(rows.withColumn("g", F.lit(1)), ["g"], [F.col("i")], F.col("v") == 1, 3)
    assert kept.count() == 6


def test_json_patches(spark):
    rows = spark.createDataFrame([('{"a":"1"}',), (None,), ("no json",)], "j string")
    out = [r.x for r in rows.select(curate.json_set(F.col("j"), "k", F.lit("v")).alias("x")).collect()]
    assert out == ['{"a":"1","k":"v"}', '{"k":"v"}', '{"k":"v"}']


def test_constraints_split(spark):
    schema = "id long, precio decimal(15,0), m2 double, m2_construido double, habitaciones int, banios int, parqueadero int, administracion double, link_origen string"
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None, "x"), (2, None, -1.0, None, None, None, None, None, "x"), (3, None, None, None, None, None, None, None, None)], schema)
    good, bad = split_valid(rows)
    assert [r.id for r in good.collect()] == [1]
    assert {(r.id, r.motivo) for r in bad.collect()} == {(2, "m2_negativo"), (3, "link_vacio")}


def test_pools_give_all_candidates(spark):
    """Blocking by pools equals the join of all with all."""
    import random

    rng = random.Random(4)
    people = [(i, rng.choice([None, "A", "B"]), rng.choice([None, "x", "y", "z"]), rng.choice([None, "d", "e"]), rng.choice([None, 1.0]), rng.choice([None, 2.0])) for i in range(40)]
    rows = spark.createDataFrame(people, "id long, ciudad string, barrio string, direccion string, latitud double, longitud double")
    hashed = {i for i in range(40) if rng.random() < 0.2}
    hashes = spark.createDataFrame([(i,) for i in hashed], "publicacion_id long")
    expected = set()
    for p in people:
        found = []
        for c in people:
            city = p[1] is None or c[1] is None or p[1] == c[1]
            either = (p[2] and p[2] == c[2]) or (p[3] and p[3] == c[3]) or (None not in p[4:] and None not in c[4:]) or c[0] in hashed
            if c[0] != p[0] and city and either:
                found.append(c[0])
        expected |= {(p[0], c) for c in sorted(found, reverse=True)[:7]}
    assert {(r.probe, r.candidate) for r in entity.candidate_pairs(rows, hashes, most=7).collect()} == expected
