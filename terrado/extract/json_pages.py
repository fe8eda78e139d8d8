"""Whole records of the portal whose pages hold the listing as JSON inside their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.extract.galleries import galleries, media_links
from terrado.extract.placing import placed
from terrado.extract.portals import source_point
from terrado.extract.rules import decimal, first, money
from terrado.functions.text import clean_text, squeeze, title_case
from terrado.sources.pages import unescaped_source

# Property types, the first that stands in a title counts; names that are no neighbourhood.
TYPES = ("Apartamento", "Apartaestudio", "Casa lote", "Casa", "Lote", "Bodega", "Local Comercial", "Local", "Oficina", "Consultorio", "Finca", "Edificio de Oficinas", "Edificio")
NO_BARRIO, NO_TITLE_BARRIO = ("NA", "N/A", "OTROS"), ("NA", "N/A")
# Keys of the source and labels of the text.
CODE, CODE_IN_URL = r'(?is)"propertyId"\s*:\s*"([^"]+)"', (r"(?i)/([^/]*M\d+)(?:\?|#|$)", r"/([^/]+)$")
TITLE, TITLE_IN_TEXT = r'(?is)"title"\s*:\s*"([^"]+)"', r"(?i)([A-Za-zÁÉÍÓÚÑáéíóúñ ]+ en Venta,[^\n\r]+)"
TYPE, CITY = (rf'(?is)"{k}"\s*:\s*\{{[^{{}}]*"nombre"\s*:\s*"([^"]+)"' for k in ("propertyType", "city"))
BARRIO, BARRIO_IN_TITLE = (r'(?is)"commonNeighborhood"\s*:\s*"([^"]+)"', r'(?is)"neighborhood"\s*:\s*"([^"]+)"'), r"(?iU)en Venta,\s*([^,]+),\s*Pasto"
PRICE, PRICE_IN_TEXT = r'(?i)"salePrice"\s*:\s*(\d+)', r"\$\s*([\d\.]+)"
COMMENT = r'(?is)"comment"\s*:\s*"((?:[^"]*(?<!\\)\\")*+[^"]*)"'
AREAS = {"m2": "area", "m2_construido": "areac"}
COUNTS = {"habitaciones": "rooms", "banios": "bathrooms", "parqueadero": "garages", "estrato": "stratum"}
AGE, AGE_IN_TEXT, FLOOR, FEE = r'(?is)"builtTime"\s*:\s*"([^"]+)"', r"(?iU)Antig[üu]edad:\s*([^\n\r]+)", r"(?iU)N[uú]mero de piso\s+(\d+)", r'(?i)"adminPrice"\s*:\s*(\d+)'

FIELDS = ("codigo_externo", "titulo", "precio", "tipo_inmueble", "ciudad", "descripcion", *AREAS, *COUNTS, "antiguedad", "pisos", "administracion", "latitud", "longitud")


def comment_text(raw: Column) -> Column:
    """A JSON string's content as text; one that is no JSON keeps its other escapes."""
    read = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))
    plain = F.replace(F.replace(raw, F.lit("\\n"), F.lit(" ")), F.lit('\\"'), F.lit('"'))
    return F.nullif(squeeze(F.coalesce(read, plain)), F.lit(""))


def listings(pages: DataFrame) -> DataFrame:
    """Pages (id, url, text, html) with FIELDS, barrio as said and skip_reason (sin_precio or null). Null pages are empty."""
    rows = pages.withColumns({"_s": unescaped_source(F.coalesce(clean_source(F.col("html")), F.lit(""))), "_t": F.coalesce("text", F.lit("")), "_u": F.coalesce("url", F.lit(""))})
    s, t, whole = F.col("_s"), F.col("_t"), (lambda x: x.try_cast("int"))
    rows = rows.withColumns({"titulo": F.coalesce(first([TITLE])(s), first([TITLE_IN_TEXT])(t)), "_point": source_point(s), "_barrio": first(BARRIO)(s)})
    from_title = first([BARRIO_IN_TITLE])(F.col("titulo"))
    stands = lambda kind: F.col("titulo").rlike(rf"(?iU)\b{kind}\b")
    price = F.coalesce(F.nullif(first([PRICE], lambda x: x.try_cast("bigint"))(s), F.lit(0)), F.nullif(money(F.nullif(F.regexp_extract(t, PRICE_IN_TEXT, 1), F.lit(""))), F.lit(0)))
    rows = rows.withColumns(
        {
            "codigo_externo": F.coalesce(first([CODE])(s), first(CODE_IN_URL)(F.col("_u"))),
            "precio": price,
            "tipo_inmueble": F.coalesce(first([TYPE])(s), *[F.when(stands(k), k) for k in TYPES]),
            "barrio": title_case(F.coalesce(F.when(~F.upper("_barrio").isin(*NO_BARRIO), F.col("_barrio")), F.when(~F.upper(from_title).isin(*NO_TITLE_BARRIO), from_title))),
            "ciudad": F.coalesce(first([CITY])(s), F.lit("Pasto")),
            "descripcion": comment_text(F.nullif(F.regexp_extract(s, COMMENT, 1), F.lit(""))),
            **{name: first([rf'(?i)"{key}"\s*:\s*"?(\d+(?:[\.,]\d+)?)"?'], decimal)(s) for name, key in AREAS.items()},
            **{name: first([rf'(?i)"{key}"\s*:\s*"?(\d+)"?'], whole)(s) for name, key in COUNTS.items()},
            "antiguedad": F.coalesce(first([AGE])(s), first([AGE_IN_TEXT])(t)),
            "pisos": first([FLOOR], whole)(t),
            "administracion": F.nullif(first([FEE], lambda x: x.try_cast("bigint"))(s), F.lit(0)),
            "latitud": F.col("_point.lat"),
            "longitud": F.col("_point.lon"),
        }
    )
    return rows.withColumn("skip_reason", F.when(F.col("precio").isNull(), "sin_precio")).withColumn("images", media_links(s)).select("id", "url", *FIELDS, "barrio", "images", "skip_reason")


def clean_source(html: Column) -> Column:
    """Quotes and ampersands that stand as character references in a page's JSON."""
    for said, meant in (("&quot;", '"'), ("&#34;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        html = F.replace(html, F.lit(said), F.lit(meant))
    return html


def records(pages: DataFrame, places: DataFrame, names: DataFrame) -> DataFrame:
    """Pages (id unique, url, text, html) with all fields, ph, the catalog's barrio, direccion, imagenes and skip_reason (sin_precio, fuera_de_pasto)."""
    found = listings(pages)
    said = found.withColumn("_address", F.concat_ws(", ", "barrio", "ciudad", F.lit("Nariño")))
    # the address asked about is the one said; the one kept is made of what was found
    out = placed(said, places, names, ["titulo", "descripcion"], "descripcion", address="_address")
    made = F.concat_ws(", ", "barrio", "ciudad", F.lit("Nariño"))
    return out.join(galleries(found, "metrocuadrado"), "id", "left").withColumn("direccion", made).select("id", "url", *FIELDS, "barrio", "ph", "direccion", "ubicacion", "imagenes", "skip_reason")
