"""Operators that keep listings in order, case by case."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from terrado.operators import upkeep


def one(spark, column, **values):
    frame = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()})
    return frame.select(column.alias("x")).first().x


def test_link_status(spark):
    status = lambda text: one(spark, upkeep.link_status(F.col("t")), t=text)
    assert status('{"link_check": {"ok": "true", "detalle": "d"}}')[:2] == (None, "d")
    assert status('{"link_check": {"ok": true}, "link_check_manual": {"ok": false, "marcado_en": "hoy"}}')[:] == (False, None, "hoy", True)
    assert status('{"link_check": {"ok": true}, "link_check_manual": {"ok": "no"}}')[0] is True
    assert status('{"link_check": [1]}') is None and status("no json") is None and status(None) is None


def test_availability(spark):
    of = lambda url, body: tuple(one(spark, upkeep.availability(F.col("u"), F.col("b")), u=url, b=body))
    assert of("https://x/LOGIN/", "casa") == (None, "sesion_perdida_durante_el_chequeo")
    assert of("https://x/1", "Este contenido no está disponible") == (False, "contenido_no_disponible")
    assert of(None, None) == (True, "contenido_visible")


def test_formats(spark):
    assert one(spark, upkeep.format_cop(F.col("v")), v=-1234567.5) == "-$ 1.234.568"
    assert one(spark, upkeep.format_cop(F.lit(None).cast("double"))) == "—"
    assert [one(spark, upkeep.format_count(F.col("v"), " m²"), v=v) for v in (1200.0, 0.5, 10.25, 100.0)] == ["1.200 m²", "0,5 m²", "10,25 m²", "100 m²"]
    assert one(spark, upkeep.format_moment(F.col("v")), v=datetime.datetime(2024, 1, 5, 15, 4)) == "5/01/2024, 3:04 p. m."
    assert [one(spark, upkeep.job_progress(F.col("v"), F.lit(600)), v=v) for v in (0, 300, 6000)] == [2, 50, 95]


def test_names(spark):
    assert one(spark, upkeep.smart_title(F.col("v")), v="conjunto -ph- narino,  vip") == "Conjunto PH Nariño VIP"
    assert one(spark, upkeep.clean_name(F.col("v")), v=": Torres del Sol, venta apartamento") == "Torres Del Sol"
    assert one(spark, upkeep.clean_name(F.col("v")), v="a venta") is None


def test_links_and_coordinates(spark):
    links = one(spark, upkeep.stored_links(F.col("o"), F.col("m")), o=" http://a ", m="http://b\n\n http://c ")
    assert [tuple(x) for x in links] == [("Origen", "http://a"), ("Adicional 1", "http://b"), ("Adicional 3", "http://c")]
    find = lambda t: one(spark, upkeep.json_coordinates(F.col("t")), t=t)
    assert tuple(find('{"a": [{"latitude": 1.21, "x": "y", "longitude": "-77,28"}]}')) == (1.21, -77.28)
    assert tuple(find('{"coordinates": [-77.28, 1.21]}')) == (1.21, -77.28) == tuple(find('{"coordenadas": "1.21, -77.28"}'))
    assert find('{"lat": 95, "lng": 1}') is None and find("") is None


def test_groups_keep_their_ids(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "node long, component long")
    members = spark.createDataFrame([(2, 70), (3, 60)], "publicacion_id long, inmueble_id long")
    out = {r.publicacion_id: (r.inmueble_id, r.previos) for r in upkeep.keep_group_ids(parts, members).collect()}
    assert out == {1: (70, [60]), 2: (70, [60]), 3: (70, [60]), 8: (8, []), 9: (8, [])}


def test_evidence_files(spark, tmp_path):
    for name in ("12/a.png", "12/b.txt", "7/c.JPG", "7/d.html"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    found = {(r.publicacion_id, r.name, r.length, r.uploadable) for r in upkeep.evidence_files(spark, str(tmp_path)).collect()}
    assert found == {(12, "a.png", 3, True), (7, "c.JPG", 3, True)}
    assert [r.name for r in upkeep.evidence_files(spark, str(tmp_path), "{html,htm}").collect()] == ["d.html"]


def test_catalogs_and_schedule(spark):
    names = spark.createDataFrame([("Óscar", True), ("ana", False), ("Zoe", None), ("olga", True)], "nombre string, activo boolean")
    assert [r.nombre for r in upkeep.by_name(names).collect()] == ["ana", "olga", "Óscar", "Zoe"]
    assert {r.nombre for r in upkeep.active(names).collect()} == {"Óscar", "olga"}
    assert one(spark, upkeep.due_portals(F.col("d")), d=datetime.date(2024, 1, 5)) == ["facebook"]
    assert len(one(spark, upkeep.due_portals(F.col("d")), d=datetime.date(2024, 1, 1))) == 5 and one(spark, upkeep.due_portals(F.col("d")), d=datetime.date(2024, 1, 2)) == []
    assert one(spark, upkeep.hashable_image(F.col("w"), F.lit(150)), w=200) and not one(spark, upkeep.hashable_image(F.lit(None).cast("int"), F.lit(150)))
    listed = spark.range(100)
    first = upkeep.unchecked_sample(listed, listed.where("id < 90"), 5, seed=3)
    assert {r.id for r in first.collect()} <= set(range(90, 100)) and first.collect() == first.collect()


def test_notes(spark):
    rows = spark.createDataFrame([(1, "vieja", None), (2, "b", None), (3, None, None)], "id long, notas string, fecha_nota timestamp")
    told = spark.createDataFrame([(1, " nueva ", datetime.datetime(2024, 1, 2)), (1, "antes", datetime.datetime(2024, 1, 1)), (2, "  ", datetime.datetime(2024, 1, 3))], "publicacion_id long, contenido string, fecha_creacion timestamp")
    assert {r.id: r.notas for r in upkeep.with_notes(rows, told).collect()} == {1: "nueva", 2: "b", 3: None}
    over = spark.createDataFrame([(1, "  ", datetime.datetime(2024, 1, 2)), (3, "x", datetime.datetime(2024, 1, 2))], "id long, nota string, cuando timestamp")
    assert {r.id: (r.notas, r.fecha_nota is None) for r in upkeep.overwrite_notes(rows, over).collect()} == {1: (None, True), 2: ("b", True), 3: ("x", False)}
