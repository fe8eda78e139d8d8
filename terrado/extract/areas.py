"""Lot and built areas in free texts of the marketplace, by ordered passes over spans.

A pass looks for one kind of evidence. What the built area's pass has used is masked,
so the same number never counts as a lot as well; later passes run only while no lot
has been found. Nothing is estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.extract.rules import plain_decimal
from terrado.functions.spans import first_span, masked, spans
from terrado.functions.text import clean_text, let, upper_key

# fixed values: units, words and patterns that say what a number measures (texts are in upper case, without accents)
LINEAR_UNIT = r"(?:MTS?|METROS?|M)"
AREA_UNIT = r"(?:MT2|M2|M\.2|MTS2|MTS\.?|M²|METROS\s+CUADRADOS|METROS\s*2|METROS)"
SURFACE_UNIT = r"(?:MT2|M2|M\.2|MTS2|MTS\.?|M²|METROS\s+CUADRADOS|METROS\s*2)"
TIMES = r"(?:X|\*|POR|×)"
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
BUILT_WORDS = r"AREA\s+CONSTRUIDA|AREA\s+PRIVADA|CONSTRUIDOS?|CONSTRUCCION|CONSTRUIDA"
LOT_WORDS = r"AREA\s+(?:DEL\s+)?LOTE|AREA\s+(?:DEL\s+)?TERRENO|LOTE|TERRENO|SOLAR"
AREA_WORDS = r"AREA\s+TOTAL|METROS\s+CUADRADOS|AREA|METROS"
NO_DIMENSION = rf"(?!\s*{LINEAR_UNIT}?\s*{TIMES}\s*[0-9])"
FRONT_AND_DEPTH = rf"\bFRENTE\s*[:\-]?\s*{NUMBER}\s*(?:{LINEAR_UNIT}\s*)?FONDO\s*[:\-]?\s*{NUMBER}\s*{LINEAR_UNIT}?"
SIDE_BY_SIDE = rf"{NUMBER}\s*{LINEAR_UNIT}?\s*(?:(?:DE\s+)?FRENTE)?\s*{TIMES}\s*{NUMBER}\s*{LINEAR_UNIT}?\s*(?:(?:DE\s+)?FONDO)?"
# a word ends here, ² counting as a part of it
WORD_END = r"(?:(?<!²)\b|(?<=²)(?!\w))"
BARE_AREA = rf"\b{NUMBER}\s*{SURFACE_UNIT}{WORD_END}"
OTHER_THINGS = (
    r"\b(?:PISCINA|CLOSETS?|VENTANAS?|PUERTAS?|GARAJE|HABITACION|HABITACIONES|PANTALLAS?|TELEVISOR|TELEVISORES|TV|MUEBLES?|ELECTRODOMESTICOS?|CAMAS?)\b"
)
STRONG_WORDS = r"\b(?:LOTE|TERRENO|SOLAR)\b"
WEAK_WORDS = r"\b(?:CASA|MEDIDAS|DIMENSIONES|APARTAMENTO|APARTAESTUDIO|INMUEBLE|PROPIEDAD)\b"
AREAS, SIDES = (5, 100_000), (1, 500)
BEFORE, AFTER = 40, 15
# end of fixed values

DETAILS = "struct<lot_width_m:double,lot_length_m:double,lot_area_m2:double,built_area_m2:double,area_source:string,area_confidence:string>"


def named_area(words: str) -> str:
    """A number behind one of the words that is no side of a pair of dimensions."""
    return rf"\b(?:{words})\s*[:\-]?\s*(?:DE\s+)?{NUMBER}{NO_DIMENSION}\s*{AREA_UNIT}?"


def _named(text: Column, words: str) -> Column:
    """struct start, length, value of the first such number; null if it is no area."""
    span = first_span(text, named_area(words))
    return let(span, lambda s: let(plain_decimal(s["found"]), lambda v: F.when(v.between(*AREAS), F.struct(s["start"].alias("start"), s["length"].alias("length"), v.alias("value")))))


def _dimensions(text: Column) -> Column:
    """struct width, length, sure: the first pair of sides that surely belongs to the property, else the first that may."""

    def judged(m: Column) -> Column:
        around = F.concat(m["before"], m["found"], m["after"])
        width, length = (plain_decimal(F.get(m["groups"], F.lit(k))) for k in (0, 1))
        sure = (
            F.when(around.rlike(OTHER_THINGS), F.lit(None).cast("boolean"))
            .when(around.rlike(STRONG_WORDS) | m["found"].rlike("FRENTE|FONDO"), True)
            .when(around.rlike(WEAK_WORDS), False)
        )
        return F.when(width.between(*SIDES) & length.between(*SIDES), F.struct(width.alias("width"), length.alias("length"), sure.alias("sure")))

    pairs = F.concat(*[spans(text, p, BEFORE, AFTER) for p in (FRONT_AND_DEPTH, SIDE_BY_SIDE)])
    able = F.filter(F.transform(pairs, judged), lambda d: d["sure"].isNotNull())
    return let(able, lambda ds: F.coalesce(F.get(F.filter(ds, lambda d: d["sure"]), F.lit(0)), F.get(ds, F.lit(0))))


def _bare(text: Column) -> Column:
    """The first number with a unit of surface that no other thing stands before."""
    value = lambda m: F.when(~m["before"].rlike(OTHER_THINGS), plain_decimal(F.get(m["groups"], F.lit(0))))
    return F.get(F.filter(F.transform(spans(text, BARE_AREA, BEFORE), value), lambda v: v.between(*AREAS)), F.lit(0))


def area_details(text: Column) -> Column:
    """struct lot_width_m, lot_length_m, lot_area_m2, built_area_m2, area_source, area_confidence of a listing's text.

    Sources: explicit_built_area, explicit_lot_area, lot_dimensions, multiple_sources
    (both a built and a lot area) or unknown. Confidence is MEDIUM where a pair of
    dimensions is the lot and only a weak word stands near it, else HIGH; null if
    nothing was found. Null and blank texts: unknown.
    """

    def found(built: Column, rest: Column) -> Column:
        def told(named: Column, sides: Column) -> Column:
            other = F.coalesce(_named(rest, AREA_WORDS)["value"], _bare(rest))
            by_sides = named.isNull() & sides.isNotNull()
            lot = F.coalesce(named, sides["width"] * sides["length"], other)

            def record(lot: Column) -> Column:
                source = (
                    F.when(built.isNotNull() & lot.isNotNull(), "multiple_sources")
                    .when(built.isNotNull(), "explicit_built_area")
                    .when(by_sides, "lot_dimensions")
                    .when(lot.isNotNull(), "explicit_lot_area")
                    .otherwise("unknown")
                )
                confidence = F.when(by_sides & ~sides["sure"], "MEDIUM").when(built.isNotNull() | lot.isNotNull(), "HIGH")
                return F.struct(
                    F.when(by_sides, sides["width"]).alias("lot_width_m"),
                    F.when(by_sides, sides["length"]).alias("lot_length_m"),
                    lot.alias("lot_area_m2"),
                    built["value"].alias("built_area_m2"),
                    source.alias("area_source"),
                    confidence.alias("area_confidence"),
                ).cast(DETAILS)

            return let(lot, record)

        return let(_named(rest, LOT_WORDS)["value"], lambda named: let(F.when(named.isNull(), _dimensions(rest)), lambda sides: told(named, sides)))

    def passes(source: Column) -> Column:
        return let(_named(source, BUILT_WORDS), lambda built: let(masked(source, built), lambda rest: found(built, rest)))

    return let(F.coalesce(upper_key(clean_text(text)), F.lit("")), passes)


def areas(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id and the fields of `area_details`, one row for each row."""
    found = rows.select(F.col(f"`{id_col}`").alias("id"), area_details(F.col(f"`{text_col}`").cast("string")).alias("area"))
    return found.select("id", "area.*")
