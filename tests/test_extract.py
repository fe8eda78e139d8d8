from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrado.extract import listing_pages, portals
from terrado.extract.rules import after_label
from terrado.sources.pages import decode_page, embedded_json, property_data, read_page
from terrado.sources.xlsx import map_headers, read_sheet, read_xlsx, workbook


def fields(spark, portal, text):
    return portals.extract(spark.createDataFrame([(1, text)], "id long, text string"), portal).first().asDict()


def test_classified(spark):
    r = fields(spark, "amorel", "Casa en venta VALOR $ 165.000.000 negociable. Tres habitaciones, 2 baños, sin garaje. Área construida: 120 m². 3 pisos. Administración: $ 90.000")
    assert (r["precio"], r["negociable"], r["tipo_inmueble"], r["ciudad"]) == (165_000_000, True, "Casa", "Pasto")
    assert (r["habitaciones"], r["banios"], r["parqueadero"], r["pisos"], r["administracion"]) == (3, 2, 0, 3, 90_000)
    assert r["m2_construido"] == 120.0
    assert fields(spark, "amorel", "Lote, 85,5 millones")["precio"] == 85_500_000
    assert fields(spark, "amorel", None)["precio"] is None


def test_marketplace(spark):
    r = fields(spark, "facebook", "Apartamento, precio 250.000.000, baño social y baño principal, segundo piso, garaje doble, adm 120 mil")
    assert (r["precio"], r["tipo_inmueble"], r["banios"], r["pisos"], r["parqueadero"], r["administracion"]) == (250_000_000, "Apartamento", 2, 2, 2, 120_000)
    assert fields(spark, "facebook", "Lote 450 millones")["precio"] == 450_000_000
    assert fields(spark, "facebook", "Lote 180000000")["precio"] == 180_000_000
    assert fields(spark, "facebook", "Lote, llamar 3101234567")["precio"] is None
    assert fields(spark, "facebook", "LOCALIZADA")["tipo_inmueble"] == "Local"


@pytest.mark.parametrize(("text", "floors"), [("5 piso", None), ("3 pisos", 3), ("casa de tres pisos", 3)])
def test_floors_need_the_plural(spark, text, floors):
    assert fields(spark, "ciencuadras", text)["pisos"] == floors


def test_portal_json(spark):
    page = r'x{\"propertyId\":\"123-M4\",\"commonNeighborhood\":\"NA\",\"neighborhood\":\"Palermo\",\"coordinates\":{\"lon\":-77.28,\"lat\":1.21}}'
    r = fields(spark, "metrocuadrado", page)
    assert (r["codigo_externo"], r["barrio"]) == ("123-M4", "Palermo")
    row = spark.createDataFrame([(page,)], "h string").select(portals.source_point(portals.unescaped_source(F.col("h"))).alias("p")).first()
    assert (row.p.lat, row.p.lon) == (1.21, -77.28)


@pytest.mark.parametrize(
    ("title", "category", "description", "why"),
    [
        ("Vendo casa", "Casas Ventas", "bonita", None),
        ("Casa", "Casas Arriendo", "", "categoria_no_es_venta"),
        ("Vendo o permuto", "Casas Ventas", "", "oferta_mixta_no_es_venta_pura"),
        ("Casa", None, "amplia", "sin_palabra_venta"),
    ],
)
def test_sale_gates(spark, title, category, description, why):
    row = spark.createDataFrame([(title, category, description)], "t string, c string, d string")
    assert row.select(portals.amorel_sale(F.col("t"), F.col("c"), F.col("d")).alias("x")).first().x == why


def test_denied_operations_do_not_count(spark):
    rows = spark.createDataFrame([("Se vende, no se arrienda",), ("Vendo o arriendo",), ("Casa",)], "d string")
    assert [r.x for r in rows.select(portals.market_sale(F.lit(None), F.col("d")).alias("x")).collect()] == [None, "no_es_venta_pura", "sin_palabra_venta"]


def test_labels_and_pages(spark):
    rows = spark.createDataFrame([(["Área: 80 m2", "Estrato", " ", "4"],)], "l array<string>")
    r = rows.select(after_label("area")(F.col("l")).alias("a"), after_label("Estrato:")(F.col("l")).alias("e"), after_label("piso")(F.col("l")).alias("n")).first()
    assert (r.a, r.e, r.n) == ("80 m2", "4", None)
    html = '<p>Uno &amp; dos<script>no</script></p><a href="/x">tres</a><img src="i.jpg"><script id="__NEXT_DATA__" type="j">{"props":{"pageProps":{"data":{"a":[1]}}}}</script>'
    assert read_page(html) == (["/x"], ["i.jpg"], "Uno & dos\ntres")
    assert read_page(None) == ([], [], "")
    page = spark.createDataFrame([(html,), ("<p>",)], "h string")
    assert [bool(r.j) for r in page.select(embedded_json(F.col("h")).alias("j")).collect()] == [True, False]
    assert [r.v for r in page.select(F.to_json(property_data(F.col("h"))).alias("v")).collect()] == ['{"a":[1]}', None]
    assert decode_page("año".encode("cp1252")) == "año" == decode_page("año".encode())


def test_workbooks_round_trip(spark, tmp_path):
    data = workbook({"Ventas": spark.createDataFrame([(1, "a<b", None), (2, None, 1.5)], "id long, t string, x double"), "Más": spark.range(1)})
    assert list(read_sheet(data, "Ventas")) == [[("s", "id"), ("s", "t"), ("s", "x")], [("s", "1"), ("s", "a<b"), None], [("s", "2"), None, ("s", "1.5")]]
    path = tmp_path / "v.xlsx"
    path.write_bytes(data)
    assert [r.cells for r in read_xlsx(spark, str(path)).orderBy("row").collect()] == [["id", "t", "x"], ["1", "a<b", None], ["2", None, "1.5"]]
    with pytest.raises(ValueError, match="no sheet"):
        list(read_sheet(data, "otra"))
    assert map_headers(["Precio ", "raro", ""], {"precio": {"precio"}}, set(), lambda h: h.strip().lower()) == ({"precio": 0}, ["raro"])


def test_listing_page(spark):
    lines = ["Casa en venta en La Colina, Pasto", "Baños", "", "2", "Área Construida", "1.200,5 m2", "Estrato", "Sin definir", "Antigüedad", "más de 20 años", "Administración", "$ 90.000", "Descripción", "Casa de 3 pisos", "amplia", "Código Fincaraíz: 77-A", "$ 350.000.000"]
    pages = [
        (1, "https://x.co/casa-pasto/123", "Casa en venta en La Colina, Pasto", "\n".join(lines), '{"lat": 1.21, "lng": -77.28}'),
        (2, "https://x.co/cali/5", "Casa en Cali", "$ 350.000.000", None),
        (3, "https://x.co/pasto/5", None, "", None),
        (4, None, None, None, None),
    ]
    found = {r.id: r for r in listing_pages.records(spark.createDataFrame(pages, "id long, url string, title string, text string, html string")).collect()}
    r = found[1]
    assert (r.codigo_externo, r.precio, r.tipo_inmueble, r.barrio, r.skip_reason) == ("77-A", 90_000, "Casa", "La Colina", None)
    assert (r.banios, r.m2, r.m2_construido, r.estrato, r.antiguedad, r.pisos, r.administracion) == (2, 1200.5, 1200.5, None, "más de 20 años", 3, 90_000)
    assert r.descripcion == "Casa de 3 pisos amplia" and (r.latitud, r.longitud) == (1.21, -77.28)
    assert {i: x.skip_reason for i, x in found.items()} == {1: None, 2: "fuera_de_pasto", 3: "sin_precio", 4: "fuera_de_pasto"}
    window = spark.range(1).select(listing_pages.result_window(F.lit("Mostrando 1 - 21 de 1.250 resultados")).alias("w")).first().w
    assert tuple(window) == (1, 21, 1250)


def test_more_fields(spark):
    r = fields(spark, "amorel", "Casa en CONJUNTO CERRADO ALTOS DE NARINO valor 90 millones, estrato 4. Antigüedad: 10 años")
    assert (r["estrato"], r["conjunto"], r["antiguedad"]) == (4, "Conjunto Cerrado Altos De", "10 Años")
    r = fields(spark, "facebook", "Apartamento estrato 3 para estrenar")
    assert (r["estrato"], r["antiguedad"]) == (3, "Para Estrenar")
    said = spark.range(1).select(portals.seller(F.array(F.lit("Casa"), F.lit("Información del vendedor"), F.lit(" Ana  Paz "))).alias("s")).first().s
    assert said == "Ana Paz"
