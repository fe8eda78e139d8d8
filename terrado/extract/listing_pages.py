"""Whole records of the portal whose pages are lines of labels and values, with the reason why a page is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.extract.galleries import galleries
from terrado.extract.placing import placed
from terrado.extract.rules import Rule, after_label, decimal, first, money
from terrado.functions.numbers import first_integer
from terrado.functions.text import blank_to_null, label_key, let, squeeze, title_case
from terrado.functions.text import lines as lines_of
from terrado.operators.upkeep import json_coordinates, territorial
from terrado.sources.pages import property_data

# Property types, the first that stands in a text counts.
TYPES = ("Apartamento", "Casa Lote", "Casa", "Lote", "Oficina", "Local", "Apartaestudio", "Edificio", "Consultorio", "Finca", "Bodega")
# What follows the description.
AFTER_DESCRIPTION = ("codigo fincaraiz", "completa tus datos", "contactar", "casa en venta", "apartamento en venta", "lote en venta", "estas en:", "descarga la app")
# Labels by field, in the order in which they are tried.
AREA_LABELS = {"m2_construido": ("Área Construida", "Área"), "m2_privado": ("Área Privada", "Área del terreno")}
NUMBER_LABELS = {"habitaciones": ("Habitaciones", "Habs.", "Hab"), "banios": ("Baños", "Baño"), "parqueadero": ("Parqueaderos", "Parqueadero", "Garajes", "Garaje")}
# Patterns of the whole text.
CODE = (r"(?iU)Código\s+Fincara[íi]z\s*:\s*([A-Za-z0-9\-]+)", r"(?iU)Código\s*:\s*([A-Za-z0-9\-]+)", r"(?i)Cod\.?\s*:\s*([A-Za-z0-9\-]+)")
PRICE = (r"\$\s*([\d\.]{5,})", r"(?i)Precio\s+de\s+Venta\s*\$?\s*([\d\.]{5,})", r"(?i)Valor\s+de\s+venta\s*:\s*\$?\s*([\d\.]{5,})")
FEE = (r"(?i)\+\s*\$\s*([\d\.]+)\s*admin", r"(?iU)administraci[oó]n\s*[:\$]?\s*([\d\.]+)", r"(?i)vigilancia\s*[:\$]?\s*([\d\.]+)")
TOTAL = (r"(?i)de\s+([\d\.,]+)\s+resultados", r"(?i)([\d\.,]+)\s+resultados")
WINDOW = r"(?i)([\d\.,]+)\s*[-–]\s*([\d\.,]+)\s+de\s+([\d\.,]+)\s+resultados"
PLACE = (r"(?iU)en\s+venta\s+en\s+(.+?),\s*pasto", r"(?iU)en\s+(.+?),\s*pasto")
BARRIO_IN_ADDRESS = r"(?iU)\bBarrio\s+([A-Za-zÁÉÍÓÚÑáéíóúñ0-9\s.\-]+?)(?:\s{2,}|,|\.|$|\s+Estrato\b|\s+Ubicaci[oó]n\b|\s+Deposito\b|\s+Garaje\b)"
PLACE_IN_TEXT = r"(?iU)([A-Za-zÁÉÍÓÚÑáéíóúñ\s.]++),\s*Pasto,\s*Nariño"
FLOORS = r"(?i)(\d+)\s*(?:pisos|piso|niveles|nivel)"


def known_type(text: Column, whole_word: bool = True) -> Column:
    """The first type of the list that stands in a text."""
    stands = (lambda t: text.rlike(rf"(?iU)\b{t}\b")) if whole_word else (lambda t: F.lower(text).contains(t.lower()))
    return F.coalesce(*[F.when(stands(t), t) for t in TYPES])


def labelled(names: tuple[str, ...], parse: Rule) -> Callable[[Column, Column], Column]:
    """From lines and their keys: the value after the first of some labels that parses."""
    return lambda lines, keys: F.coalesce(*[let(after_label(n, 5)(lines, keys), parse) for n in names])


def section(start: str, ends: tuple[str, ...]) -> Rule:
    """From lines: those after the line that is the start, up to one that begins as an end does; null if nothing is between."""

    def rule(lines: Column) -> Column:
        def between(ls: Column) -> Column:
            keys = F.transform(ls, label_key)
            begun = F.array_position(keys, label_key(F.lit(start))).cast("int")
            rest, rest_keys = F.slice(ls, begun + 1, F.size(ls)), F.slice(keys, begun + 1, F.size(ls))
            is_end = lambda k: F.greatest(*[k.startswith(e) for e in ends]) if len(ends) > 1 else k.startswith(ends[0])
            stop = F.array_position(F.transform(rest_keys, is_end), True).cast("int")
            kept = F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)
            return F.when(begun > 0, F.nullif(squeeze(F.array_join(kept, " ")), F.lit("")))

        return let(lines, between)

    return rule


def result_window(text: Column) -> Column:
    """struct first, last, total of a result list; null unless all are there and in order."""
    first_, last, total = (money(F.nullif(F.regexp_extract(text, WINDOW, k), F.lit(""))) for k in (1, 2, 3))
    return F.when((first_ > 0) & (last >= first_) & (total > 0), F.struct(first_.alias("first"), last.alias("last"), total.alias("total")))


def _read(pages: DataFrame, place: str) -> DataFrame:
    # each step's columns are made once; an expression that stands in several others would be made in each
    rows = pages.withColumn("lines", lines_of(F.coalesce("text", F.lit("")))).withColumn("_keys", F.transform("lines", label_key))
    text, title, lines, keys = F.coalesce("text", F.lit("")), F.col("title"), F.col("lines"), F.col("_keys")
    told = {"_type": "Tipo de Inmueble", "_stratum": "Estrato", "_fee": "Administración", "_floors": "Cantidad de pisos"}
    rows = rows.withColumns({name: after_label(label, 5)(lines, keys) for name, label in told.items()})
    last_step = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*?/(\d+)/*(?:[?#].*)?$", 1)
    said_type, stratum = F.col("_type"), F.col("_stratum")
    rows = rows.withColumns(
        {
            "codigo_externo": F.coalesce(first(CODE, blank_to_null)(text), F.nullif(last_step, F.lit(""))),
            "precio": first(PRICE, money)(text),
            "descripcion": section("Descripción", AFTER_DESCRIPTION)(lines),
            "tipo_inmueble": F.coalesce(known_type(said_type), said_type, known_type(title), known_type(F.concat_ws(" ", title, text), False)),
            "barrio": first(PLACE, blank_to_null)(title),
            **{name: labelled(names, decimal)(lines, keys) for name, names in AREA_LABELS.items()},
            **{name: labelled(names, first_integer)(lines, keys) for name, names in NUMBER_LABELS.items()},
            "estrato": F.when(~F.lower(stratum).rlike("sin definir|preg"), first_integer(stratum)),
            "antiguedad": after_label("Antigüedad", 5)(lines, keys),
            "administracion": F.coalesce(F.nullif(money(F.col("_fee")), F.lit(0)), first(FEE, money)(text)),
            "punto": json_coordinates(F.coalesce("html", F.lit(""))),
        }
    )
    return rows.withColumns(
        {
            "m2": F.coalesce("m2_privado", "m2_construido"),
            "pisos": F.coalesce(first_integer(F.col("_floors")), F.regexp_extract("descripcion", FLOORS, 1).try_cast("int")),
            "skip_reason": F.when(~territorial(F.col("url"), title, F.col("html"), place), "fuera_de_pasto").when(F.coalesce(F.col("precio") <= 0, F.lit(True)), "sin_precio"),
        }
    )


FIELDS = ("codigo_externo", "precio", "tipo_inmueble", "barrio", "descripcion", "m2", "m2_construido", "habitaciones", "banios", "parqueadero", "estrato", "antiguedad", "pisos", "administracion")


def records(pages: DataFrame, place: str = "pasto") -> DataFrame:
    """pages (id, url, title, text, html) with all fields and skip_reason (fuera_de_pasto, sin_precio; null for a listing)."""
    return _read(pages, place).select("id", *FIELDS, F.col("punto.lat").alias("latitud"), F.col("punto.lon").alias("longitud"), "skip_reason")


def json_text(data: Column, *path: str) -> Column:
    """A variant's text at a path of names, through the first item where a member is an array; null unless it is a text."""
    ways = ["$"]
    for name in path:
        ways = [f"{way}.{name}{item}" for way in ways for item in ("", "[0]")]
    found = [F.try_variant_get(data, way, "variant") for way in ways]
    return F.nullif(squeeze(F.coalesce(*[F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")) for v in found])), F.lit(""))


def said_place(lines: Column, title: Column, text: Column, data: Column) -> Column:
    """struct barrio, direccion: from the page's data, then labels, the title and the text; the first that says anything counts."""
    address = json_text(data, "address")
    named = F.nullif(squeeze(F.regexp_extract(address, BARRIO_IN_ADDRESS, 1)), F.lit(""))
    named = title_case(F.when(~named.isin("-", "N/A"), named))
    structured = F.coalesce(json_text(data, "locations", "location_main", "name"), json_text(data, "locations", "neighbourhood", "name"), named)
    in_city = lambda barrio: F.concat(barrio, F.lit(", Pasto, Nariño"))
    full = F.concat_ws(" ", F.coalesce(title, F.lit("")), text)
    ways = [in_city(structured), after_label("Ubicación Principal", 3)(lines), after_label("Ubicación", 3)(lines), in_city(first(PLACE, blank_to_null)(title)), F.nullif(F.regexp_extract(full, PLACE_IN_TEXT, 0), F.lit(""))]
    place = F.coalesce(*[F.nullif(squeeze(w), F.lit("")) for w in ways])
    parts = F.filter(F.transform(F.split(place, ","), squeeze), lambda x: (x != "") & ~label_key(x).isin("pasto", "narino"))
    barrio = F.get(parts, F.lit(0))
    return F.struct(barrio.alias("barrio"), F.when(place.isNotNull(), F.concat_ws(", ", barrio, F.lit("Pasto"), F.lit("Nariño"))).otherwise(F.coalesce(address, F.lit("Pasto, Nariño"))).alias("direccion"))


def located(pages: DataFrame, places: DataFrame, names: DataFrame, place: str = "pasto") -> DataFrame:
    """Pages (id unique, url, title, text, html, images) with the fields of records(), and ph, the catalog's barrio, direccion, ubicacion, imagenes."""
    rows = _read(pages, place).withColumns({"titulo": F.col("title"), "ciudad": F.lit("Pasto"), "_data": property_data(F.coalesce("html", F.lit("")))})
    rows = rows.withColumn("_place", said_place(F.col("lines"), F.col("title"), F.coalesce("text", F.lit("")), F.col("_data")))
    rows = rows.withColumns({"barrio": F.col("_place.barrio"), "_direccion": F.col("_place.direccion"), "latitud": F.col("punto.lat"), "longitud": F.col("punto.lon")})
    rows = rows.select("id", "url", "titulo", "ciudad", *FIELDS, "latitud", "longitud", "_direccion", "skip_reason")
    out = placed(rows, places, names, ["descripcion"], "descripcion", address="_direccion", building_as_barrio=True)
    return out.join(galleries(pages, "fincaraiz"), "id", "left").select("id", "url", *FIELDS, "ph", "ciudad", "direccion", "ubicacion", "latitud", "longitud", "imagenes", "skip_reason")
