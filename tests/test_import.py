from __future__ import annotations

from pyspark.sql import functions as F

from terrado.plans import sheet_import as plan
from terrado.sources.xlsx import map_headers

HEAD = ["Precio", "Link", "Barrio", "Estrato", "Estrato del anuncio", "Descripcion", "LOCALIZACION COORDENADAS", "raro"]
ROWS = [
    (1, ["200", "https://www.fincaraiz.com.co/a", "Toro bajo", "3", None, "casa", "1,21, -77,28", None], "nsssssss"),
    (2, ["caro", "x", "Palermo", "3", None, None, None, None], "ssssssss"),
    (3, ["100", None, "Palermo", None, None, None, None, None], "nsssssss"),
    (4, ["100", "x", "Ipiales", None, None, None, None, None], "nsssssss"),
    (5, ["100", " http://facebook.com/2 ", "PH - torres de o'higgins", "alto", "4", "Casa en Torres de Aquine", None, None], "nsssnsss"),
    (6, ["100", "http://facebook.com/2", None, None, None, "casa en Chachagui", None, None], "nsssssss"),
    (7, ["100", "stored", None, None, None, None, None, None], "nsssssss"),
]


def test_rows_gate_and_insert(spark):
    columns, unmatched = map_headers(HEAD, plan.HEADERS, plan.IGNORED, lambda h: h.strip().lower())
    assert unmatched == ["raro"] and columns["estrato_anuncio"] == 4
    sheet = spark.createDataFrame([(n, cells, list(kinds)) for n, cells, kinds in ROWS], "row int, cells array<string>, kinds array<string>")
    places = spark.createDataFrame([("torobajo", "Torobajo", "barrio", 0)], "key string, canonical string, kind string, ord long")
    names = spark.createDataFrame([("torres de aquine", "Torres de Aquine", 0)], "key string, canonical string, ord long")
    rows = plan.listing_rows(plan.typed_rows(sheet, columns), places, names).cache()
    out = {r.fila: r for r in rows.collect()}
    assert {k: r.skip_reason for k, r in out.items()} == {1: None, 2: "sin_precio", 3: "sin_link", 4: "fuera_de_pasto", 5: None, 6: "fuera_de_pasto", 7: None}
    assert (out[1].barrio, out[1].fuente_nombre, out[1].latitud, out[1].longitud, out[1].estrato) == ("Torobajo", "Fincaraiz", 1.21, -77.28, None)
    assert (out[5].ph, out[5].barrio, out[5].estrato, out[5].link_origen, out[5].fuente_nombre) == ("Torres De O'Higgins", None, 4, "http://facebook.com/2", "Facebook Marketplace")
    sources = spark.createDataFrame([(1, "Fincaraiz"), (2, "Cliente")], "id long, nombre string")
    stored = spark.createDataFrame([(9, 2, None, "stored")], "id long, fuente_id long, codigo_externo string, link_origen string")
    assert sorted(r.fila for r in plan.to_insert(rows, sources, stored).collect()) == [1, 5]
    assert {(r.motivo, r.fuente_nombre, r.n) for r in plan.preview(rows.where(F.col("fila") < 3)).collect()} == {("importable", "Fincaraiz", 1), ("sin_precio", "Cliente", 1)}
