"""Whole records of the portal whose headings name type and neighbourhood ("Casa en venta, El dorado")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.extract.galleries import galleries
from terrado.extract.listing_pages import section
from terrado.extract.placing import placed
from terrado.extract.portals import CIENCUADRAS
from terrado.extract.rules import after_label, decimal, first
from terrado.functions.numbers import first_integer, plausible
from terrado.functions.text import let, squeeze
from terrado.functions.text import lines as lines_of

# Property types, the first that stands in a text counts; what follows the description.
TYPES = ("Apartamento", "Casa", "Lote", "Oficina", "Local", "Apartaestudio", "Edificio", "Consultorio", "Finca")
AFTER_DESCRIPTION = ("zonas comunes", "explorar cercanias", "¿aun tienes dudas?", "contactar vendedor", "caracteristicas", "gastos", "calcula tu credito")
# Words beside a number, by field, in the order in which they are tried.
COUNTS = {"habitaciones": ("Habitaciones", "Alcobas"), "banios": ("Baños", "Banos", "Baño", "Bano"), "parqueadero": ("Parqueaderos", "Parqueadero", "Garajes", "Garaje")}
# How a text names its place, and a page its point (latitude first but for the last).
PLACES = (r"(?i)ubicado en Nariño en Pasto en\s+([^,]+)", r"(?i)Pasto en\s+([^,]+)")
POINTS = (
    r'(?is)"latitude"\s*:\s*(-?\d+(?:\.\d+)?).*?"longitude"\s*:\s*(-?\d+(?:\.\d+)?)',
    r'(?is)"lat"\s*:\s*(-?\d+(?:\.\d+)?).*?"lng"\s*:\s*(-?\d+(?:\.\d+)?)',
    r"""(?is)data-lat\s*=\s*["'](-?\d+(?:\.\d+)?)["'].*?data-lng\s*=\s*["'](-?\d+(?:\.\d+)?)["']""",
    r"""(?is)data-latitude\s*=\s*["'](-?\d+(?:\.\d+)?)["'].*?data-longitude\s*=\s*["'](-?\d+(?:\.\d+)?)["']""",
    r"(?is)coordenadas?\s*[:=]\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)",
)
GEOJSON = r'(?i)"coordinates"\s*:\s*\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]'

FIELDS = ("codigo_externo", "precio", "tipo_inmueble", "descripcion", "m2", "m2_construido", *COUNTS, "estrato", "antiguedad", "pisos", "administracion", "latitud", "longitud", "ciudad")


def _tidy(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def page_point(source: Column) -> Column:
    """struct lat, lon: of the first pattern whose match is plausible."""

    def read(pattern: str, lat: int, lon: int) -> Column:
        side = lambda k: F.regexp_extract(source, pattern, k).try_cast("double")
        point = F.struct(side(lat).alias("lat"), side(lon).alias("lon"))
        return let(point, lambda p: F.when(plausible(p["lat"], p["lon"]), p))

    return F.coalesce(*[read(p, 1, 2) for p in POINTS], read(GEOJSON, 2, 1))


def said_barrio(title: Column, lines: Column, text: Column) -> Column:
    """What the heading says after its first comma; else what the first line with the city says besides it; else the text."""
    heading = _tidy(F.regexp_extract(title, r"(?s)^[^,]*,(.*)$", 1))
    at_city = F.filter(lines, lambda x: x.contains("Pasto"))
    other = lambda x: (x != "") & ~F.lower(x).contains("pasto") & ~F.lower(x).contains("nariño")
    part = lambda found: F.get(F.filter(F.transform(F.split(F.get(found, F.lit(0)), ","), lambda x: _tidy(x)), other), F.lit(0))
    in_line = let(at_city, lambda found: F.when(F.size(found) > 0, F.struct(part(found).alias("b"))))
    return F.when(heading.isNotNull(), heading).otherwise(F.when(in_line.isNotNull(), in_line["b"]).otherwise(first(PLACES, _tidy)(F.concat_ws(" ", title, text, F.array_join(lines, " ")))))


def listings(pages: DataFrame) -> DataFrame:
    """Pages (id, url, title: the heading, text, html) with FIELDS, titulo, barrio as said, direccion and skip_reason (sin_precio or null). Null texts are empty."""
    rows = pages.withColumns({"_t": F.coalesce("text", F.lit("")), "titulo": _tidy(F.col("title"))}).withColumn("_lines", lines_of(F.col("_t")))
    t, lines, title = F.col("_t"), F.col("_lines"), F.col("titulo")
    head = F.when(title.contains(","), F.element_at(F.split(title, ",", 2), 1))
    stands = [F.when(head.rlike(rf"(?iU)\b{k}\b"), k) for k in TYPES]
    whole = F.lower(F.concat_ws(" ", title, t))
    counted = lambda words: first([p for w in words for p in (rf"(?i){w}\s*[:\-]?\s*(\d+)", rf"(?i)(\d+)\s+{w}")], lambda x: x.try_cast("int"))(t)
    point = page_point(F.concat_ws("\n", F.coalesce("html", F.lit("")), t))
    rows = rows.withColumns({"descripcion": section("Descripción", AFTER_DESCRIPTION)(lines), "_point": point, "barrio": said_barrio(title, lines, t), "ciudad": F.lit("Pasto")})
    rows = rows.withColumns(
        {
            "codigo_externo": CIENCUADRAS["codigo_externo"](t),
            "precio": CIENCUADRAS["precio"](t),
            "tipo_inmueble": F.coalesce(*stands, *[F.when(whole.contains(k.lower()), k) for k in TYPES]),
            "m2": decimal(after_label("Área privada")(lines)),
            "m2_construido": decimal(after_label("Área construida")(lines)),
            **{name: counted(words) for name, words in COUNTS.items()},
            "estrato": first_integer(after_label("Estrato")(lines)),
            "antiguedad": after_label("Antigüedad")(lines),
            "pisos": CIENCUADRAS["pisos"](F.col("descripcion")),
            "administracion": CIENCUADRAS["administracion"](t),
            "latitud": F.col("_point.lat"),
            "longitud": F.col("_point.lon"),
            "direccion": F.concat_ws(", ", "barrio", F.lit("Pasto"), F.lit("Nariño")),
        }
    )
    return rows.withColumn("skip_reason", F.when(F.coalesce(F.col("precio") <= 0, F.lit(True)), "sin_precio")).select("id", "url", "titulo", *FIELDS, "barrio", "direccion", "skip_reason")


def records(pages: DataFrame, places: DataFrame, names: DataFrame) -> DataFrame:
    """Pages (id unique, url, title, text, html, images) with all fields, ph, the catalog's barrio, imagenes and skip_reason (sin_precio, fuera_de_pasto). The address stays as said."""
    said = listings(pages).withColumnRenamed("direccion", "_direccion")
    out = placed(said, places, names, ["descripcion"], "descripcion", address="_direccion")
    return out.join(galleries(pages, "ciencuadras"), "id", "left").select("id", "url", "titulo", *FIELDS, "barrio", "ph", "direccion", "ubicacion", "imagenes", "skip_reason")
