"""Whole records of portals, image lists and places, on pages whose fields are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrado.extract import classifieds, galleries, headed_pages, json_pages, listing_pages
from terrado.functions.text import place_key

PAGES = "id long, url string, text string, tipo string, images array<struct<url:string,width:double,height:double>>"


@pytest.fixture(scope="module")
def catalogs(spark):
    places = spark.createDataFrame([("La Colina", "barrio", 1), ("Pandiaco", "barrio", 2), ("Genoy", "corregimiento", 3)], "canonical string, kind string, ord long")
    names = spark.createDataFrame([("Altos de Aranda", 1)], "canonical string, ord long")
    return places.withColumn("key", place_key(F.col("canonical"))), names.withColumn("key", place_key(F.col("canonical")))


def shown(*urls):
    return [(u, 0.0, 0.0) for u in urls]


AD = """Inicio
Vendo casa en Pandiaco FSE 1234
2024-05-06 - Casas Venta
Detalles de la Publicación
Casa de 3 habitaciones, 2 baños, barrio La Colina consta de sala
Conjunto Altos de Aranda valor $ 250.000.000 negociable
3001234567
Contacte al vendedor
Arriendos"""


def test_ads(spark, catalogs):
    api = "/clasificados/api/v1/anuncio"
    pages = [
        (1, "https://amorelpasto.com/x/publicacion/77", AD, "Casa", shown(f"{api}/9/thumb", "logo.png", f"{api}/9/imagen", f"{api}/8/thumb", f"{api}/8/thumb?2")),
        (2, "https://amorelpasto.com/x/publicacion/78", "AMOREL\nLote en Genoy\nFSE 9\n2024-01-02\n-\nLotes Ventas\nnada", None, None),
        (3, "https://amorelpasto.com/x/publicacion/79?a", "Detalles de la publicación\nFSE 12-3 Lote en venta en Pleno Centro, valor 90 millones", None, []),
        (4, None, None, None, None),
        (5, "u", AD.replace("sala", "sala, permuto"), None, shown(" ", "")),
        (6, "u", "Casa en Chachagui, se vende, $ 90.000.000\nMunicipio de Chachagui", None, None),
    ]
    found = {r.id: r for r in classifieds.records(spark.createDataFrame(pages, PAGES), *catalogs).collect()}
    r = found[1]
    assert (r.codigo_externo, r.titulo, r.fecha, r.categoria, r.tipo_inmueble) == ("AMOREL 77", "Vendo casa en Pandiaco", "2024-05-06", "Casas Venta", "Casa")
    assert r.descripcion == "Casa de 3 habitaciones, 2 baños, barrio La Colina consta de sala Conjunto Altos de Aranda valor $ 250.000.000 negociable"
    assert (r.precio, r.negociable, r.habitaciones, r.banios, r.ciudad, r.barrio, r.ph, r.direccion) == (250_000_000, True, 3, 2, "Pasto", "La Colina", "Altos de Aranda", "La Colina, Pasto, Nariño")
    assert r.imagenes == [f"https://amorelpasto.com{api}/9/imagen", f"https://amorelpasto.com{api}/8/thumb"] and r.skip_reason is None
    r = found[2]
    assert (r.codigo_externo, r.titulo, r.fecha, r.categoria, r.tipo_inmueble, r.skip_reason) == ("AMOREL 78", "Lote en Genoy", "2024-01-02", "Lotes Ventas", "Lote", "sin_precio")
    r = found[3]
    assert (r.codigo_externo, r.titulo, r.precio, r.barrio, r.skip_reason) == ("FSE 12-3", "Lote en venta en Pleno Centro,", 90_000_000, None, None)
    assert (found[4].titulo, found[4].skip_reason, found[4].imagenes) == (None, "sin_palabra_venta", [])
    assert (found[5].skip_reason, found[5].imagenes) == ("oferta_mixta_no_es_venta_pura", [])
    assert (found[6].ciudad, found[6].skip_reason) == ("Chachagui", "fuera_de_pasto")


def test_json_pages(spark, catalogs):
    listing = '{"propertyId":"12-M3","title":"Apartamento en Venta, PANDIACO, Pasto","salePrice":320000000,"commonNeighborhood":"NA","neighborhood":"LA COLINA","city":{"id":1,"nombre":"Pasto"},"area":"80,5","areac":75,"rooms":"3","bathrooms":2,"stratum":4,"builtTime":"Entre 0 y 5 años","adminPrice":0,"comment":"Sala y\\u00e1rea\\nAltos de Aranda","coordinates":{"lon":-77.28,"lat":1.21},"image":"https://multimedia.metrocuadrado.com/a/1_p.jpg?x=1","imageMobile":"https://multimedia.metrocuadrado.com/a/1_h.jpg"}'
    pages = [
        (1, "https://x.co/a/12-M3", "Número de piso 4", "<script>" + listing.replace('"', '\\"') + "</script>"),
        (2, "https://x.co/apto-M77?y", "Casa en Venta, La Colina, Pasto\n$ 150.000.000\nAntigüedad: 9 años", "<p>"),
        (3, "https://x.co/z", "", None),
        (4, None, None, '{"salePrice":5,"city":{"nombre":"Bogota"},"title":"Casa"}'),
    ]
    found = {r.id: r for r in json_pages.records(spark.createDataFrame(pages, "id long, url string, text string, html string"), *catalogs).collect()}
    r = found[1]
    assert (r.codigo_externo, r.titulo, r.precio, r.tipo_inmueble, r.barrio, r.ph) == ("12-M3", "Apartamento en Venta, PANDIACO, Pasto", 320_000_000, "Apartamento", "Pandiaco", "Altos de Aranda")
    assert (r.m2, r.m2_construido, r.habitaciones, r.banios, r.estrato, r.antiguedad, r.pisos, r.administracion) == (80.5, 75.0, 3, 2, 4, "Entre 0 y 5 años", 4, None)
    assert r.descripcion == "Sala yárea Altos de Aranda" and (r.latitud, r.longitud) == (1.21, -77.28) and r.direccion == "Pandiaco, Pasto, Nariño"
    assert r.imagenes == ["https://multimedia.metrocuadrado.com/a/1_p.jpg"]
    r = found[2]
    assert (r.codigo_externo, r.precio, r.tipo_inmueble, r.barrio, r.antiguedad, r.skip_reason) == ("apto-M77", 150_000_000, "Casa", "La Colina", "9 años", None)
    assert (found[3].codigo_externo, found[3].skip_reason, found[4].skip_reason) == ("z", "sin_precio", "fuera_de_pasto")


def test_comments_are_read_whole(spark):
    long = "a" * 200_000
    rows = spark.createDataFrame([("uno\\ndos",), (long,), ("mal \\q",), (None,)], "c string")
    assert [r.x for r in rows.select(json_pages.comment_text(F.col("c")).alias("x")).collect()] == ["uno dos", long, "mal \\q", None]


def test_best_resolutions(spark):
    new = "https://d.cloudfront.net/resizedImages/{}/site/media/listing/a/photos/a_1_false_foto.jpg"
    images = [("/repo/img/th.outside190x100.__infocdn__a.jpg", 0.0, 0.0), ("/repo/img/th.outside640x480.__infocdn__a.jpg", 0.0, 0.0), ("/repo/img/10x10/b.jpg", 0.0, 0.0), ("/repo/img/logo.png", 900.0, 900.0), ("data:x", 0.0, 0.0), (new.format("100x60"), 0.0, 0.0), (new.format("900x600"), 0.0, 0.0), ("/repo/img/c.jpg", 50.0, 50.0), ("/repo/img/d.jpg", None, None)]
    rows = spark.createDataFrame([(1, "https://x", images), (2, None, None)], "id long, url string, images array<struct<url:string,width:double,height:double>>")
    found = {r.id: r.imagenes for r in galleries.galleries(rows, "fincaraiz").collect()}
    base = "https://www.fincaraiz.com.co/repo/img/"
    # the first is below the least size, so the second is the first version of its image
    assert found == {1: [base + "th.outside640x480.__infocdn__a.jpg", new.format("900x600"), base + "d.jpg"], 2: []}
    rows = spark.createDataFrame([(1, "https://x", [("a.jpg", 0.0, 0.0), ("/a.jpg", 0.0, 0.0), ("b.svg", 0.0, 0.0), ("//h/Logo.png", 0.0, 0.0)])], rows.schema)
    assert galleries.galleries(rows, "ciencuadras").first().imagenes == ["https://www.ciencuadras.com/a.jpg"]


TITLED = "id long, url string, title string, text string, html string, images array<struct<url:string,width:double,height:double>>"


def test_headed_pages(spark, catalogs):
    text = "Código: C-9\nValor de compra: $ 300.000.000\n3 Habitaciones\nBaños: 2\nÁrea privada\n80,5 m2\nEstrato: 4\nDescripción\nCasa de tres pisos en Altos de Aranda\nGastos\nadministración: $ 90.000"
    pages = [
        (1, "u", "Casa en venta, La Colina", text, '{"latitude": 91.5, "longitude": 3, "coordinates": [-77.28, 1.21]}', shown("/a.jpg")),
        (2, "u", "Casa", "Pandiaco, Pasto, Nariño\nPrecio: $ 5.000.000", '<p data-lat="1.2" x data-lng="-77.3">', None),
        (3, "u", None, "lote ubicado en pasto en Genoy, cerca", None, None),
        (4, "u", "Finca, El Encanto", "$ 90.000.000 casa en Sandona", None, None),
    ]
    found = {r.id: r for r in headed_pages.records(spark.createDataFrame(pages, TITLED), *catalogs).collect()}
    r = found[1]
    assert (r.codigo_externo, r.precio, r.tipo_inmueble, r.barrio, r.ph, r.direccion, r.ciudad) == ("C-9", 300_000_000, "Casa", "La Colina", "Altos de Aranda", "La Colina, Pasto, Nariño", "Pasto")
    assert (r.habitaciones, r.banios, r.m2, r.estrato, r.pisos, r.administracion, r.latitud, r.longitud, r.skip_reason) == (3, 2, 80.5, 4, 3, 90_000, 1.21, -77.28, None)
    assert r.imagenes == ["https://www.ciencuadras.com/a.jpg"] and r.descripcion == "Casa de tres pisos en Altos de Aranda"
    assert (found[2].barrio, found[2].latitud, found[2].skip_reason) == ("Pandiaco", 1.2, None)
    assert (found[3].tipo_inmueble, found[3].direccion, found[3].skip_reason) == ("Lote", "Genoy, Pasto, Nariño", "sin_precio")
    assert found[4].tipo_inmueble == "Finca"


def test_places_of_listing_pages(spark, catalogs):
    data = '<script id="__NEXT_DATA__" type="j">{"props":{"pageProps":{"data":%s}}}</script>'
    pages = [
        (1, "http://x/pasto/1", "Casa", "$ 90.000.000\nUbicación: Pandiaco, Pasto", data % '{"locations":{"location_main":[{"name":"La Colina"}]},"address":"Cra 1"}', shown("/repo/img/a.jpg")),
        (2, "http://x/pasto/2", "Casa", "$ 90.000.000\nUbicación Principal\nPasto, Pandiaco", None, None),
        (3, "http://x/pasto/3", "Casa en venta en La Colina, Pasto", "$ 90.000.000", data % '{"address":"Calle 1 barrio genoy, sur"}', None),
        (4, "http://x/pasto/4", None, "$ 90.000.000", data % '{"address":"Calle 9"}', None),
        (5, "http://x/pasto/5", None, "$ 90.000.000", data % '{"locations":{"location_main":{"name":"Edificio Sol"}}}', None),
        (6, None, None, None, None, None),
    ]
    found = {r.id: r for r in listing_pages.located(spark.createDataFrame(pages, TITLED), *catalogs).collect()}
    assert {i: (r.barrio, r.ph, r.direccion) for i, r in found.items()} == {
        1: ("La Colina", None, "La Colina, Pasto, Nariño"),
        2: ("Pandiaco", None, "Pandiaco, Pasto, Nariño"),
        3: ("Genoy", None, "Genoy, Pasto, Nariño"),
        4: (None, None, "Calle 9"),
        5: (None, "Edificio Sol", "Edificio Sol, Pasto, Nariño"),
        6: (None, None, "Pasto, Nariño"),
    }
    assert found[1].imagenes == ["https://www.fincaraiz.com.co/repo/img/a.jpg"] and found[6].skip_reason == "fuera_de_pasto"
