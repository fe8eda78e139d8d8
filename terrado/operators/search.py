"""Filtered listing search: filters given as texts, all of which must hold; orders and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrado.functions.text import barrio_filter_key, blank_to_null, is_blank, unaccent

# What asks for rows without a building or neighbourhood, and for rows with any building.
NO_BUILDING, ANY_BUILDING, NO_BARRIO = "__sin_ph", "ph", "__sin_barrio"
#: Prices below are in millions.
MILLIONS_BELOW = 100_000


def leading_integer(text: str | None) -> int | None:
    """The integer that a text begins with: 12abc is 12."""
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return int(found[1]) if found else None


def count_filter(text: str | None) -> tuple[str, int] | None:
    """("ge", n) of "n+", ("eq", n) of "n"."""
    text = (text or "").strip()
    number = leading_integer(text[:-1] if text.endswith("+") else text)
    return None if number is None else ("ge" if text.endswith("+") else "eq", number)


def money_filter(text: str | None) -> int | None:
    digits = re.sub(r"\D", "", text or "")
    if not digits:
        return None
    value = int(digits)
    return value * 1_000_000 if 0 < value < MILLIONS_BELOW else value


def area_filter(text: str | None) -> float | None:
    kept = re.sub(r"[^\d.]", "", (text or "").strip().replace(",", ".", 1))
    found = re.match(r"\d*\.?\d*", kept)[0]
    value = float(found) if found.strip(".") else 0.0
    return value if value > 0 else None


def day_filter(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text.strip()) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", (text or "").strip()) else None
    except ValueError:
        return None


@dataclass(frozen=True)
class ListingFilters:
    """Filters as they come from a form; blank ones are inactive."""

    id: str | None = None
    tipo_inmueble: str | None = None
    fuente_id: str | None = None
    fecha: str | None = None
    habitaciones: str | None = None
    banios: str | None = None
    parqueadero: str | None = None
    precio_min: str | None = None
    precio_max: str | None = None
    area_min: str | None = None
    area_max: str | None = None
    ph: str | None = None
    barrio: str | None = None
    ubicacion: str | None = None
    duplicados: str | None = None

    def active(self) -> dict[str, str]:
        return {f.name: v.strip() for f in fields(self) if (v := getattr(self, f.name)) and v.strip()}


def on_day(timestamp: Column, day: date) -> Column:
    """A calendar day as a half-open range, so that file statistics prune."""
    return (timestamp >= F.lit(day.isoformat()).cast("timestamp_ntz")) & (timestamp < F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))


def contains_folded(text: Column, part: str) -> Column:
    """LIKE %part% that ignores case and accents; % and _ in part keep their meaning."""
    folded = lambda c: F.lower(unaccent(c))
    return F.call_function("like", folded(text), folded(F.lit(f"%{part}%")))


def predicates(filters: ListingFilters) -> list[Column]:
    """Row predicates of all active filters but the one about duplicates."""
    f = filters.active()
    out: list[Column] = []
    for name in ("id", "fuente_id"):
        if (number := leading_integer(f.get(name))) is not None:
            out.append(F.col(name) == number)
    if "tipo_inmueble" in f:
        out.append(contains_folded(F.col("tipo_inmueble"), f["tipo_inmueble"]))
    if day := day_filter(f.get("fecha")):
        out.append(on_day(F.col("fecha_captura"), day))
    for name in ("habitaciones", "banios", "parqueadero"):
        if asked := count_filter(f.get(name)):
            out.append(F.col(name) >= asked[1] if asked[0] == "ge" else F.col(name) == asked[1])
    if value := money_filter(f.get("precio_min")):
        out.append(F.col("precio") >= value)
    if value := money_filter(f.get("precio_max")):
        out.append(F.col("precio") <= value)
    if value := area_filter(f.get("area_min")):
        out.append(F.col("m2") >= value)
    if value := area_filter(f.get("area_max")):
        out.append(F.col("m2") <= value)
    if "ph" in f:
        blank = is_blank(F.col("ph"))
        out.append({NO_BUILDING: blank, ANY_BUILDING: ~blank}.get(f["ph"], F.col("ph") == f["ph"]))
    barrio = f.get("barrio") or f.get("ubicacion")
    if barrio == NO_BARRIO:
        out.append(is_blank(F.col("barrio")))
    elif barrio:
        out.append(barrio_filter_key(F.col("barrio")) == barrio_filter_key(F.lit(barrio)))
    return out


def endpoints(edges: DataFrame) -> DataFrame:
    """Every listing that an edge touches, once."""
    return edges.select(F.col("publicacion_id").alias("id")).union(edges.select(F.col("candidata_id").alias("id"))).distinct()


def by_duplicates(listings: DataFrame, edges: DataFrame, wanted: str) -> DataFrame:
    """Listings with (con), without (sin), with confirmed or with pending matches: semi and anti joins on the united endpoints."""
    if wanted == "sin":
        return listings.join(endpoints(edges.where("estado <> 'descartada'")), "id", "left_anti")
    state = {"con": F.col("estado") != "descartada", "confirmadas": F.col("estado") == "confirmada", "pendientes": F.col("estado") == "pendiente"}.get(wanted)
    return listings if state is None else listings.join(endpoints(edges.where(state)), "id", "left_semi")


def search(listings: DataFrame, filters: ListingFilters, sources: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Listings that meet all filters, with the name of their source, latest first."""
    found = reduce(lambda df, p: df.where(p), predicates(filters), listings)
    if edges is not None and (wanted := filters.active().get("duplicados")):
        found = by_duplicates(found, edges, wanted)
    if sources is not None:
        found = found.join(sources.select(F.col("id").alias("fuente_id"), F.col("nombre").alias("fuente_nombre")), "fuente_id", "left")
    return found.orderBy(F.desc("fecha_captura"), F.desc("id"))


def ordered(df: DataFrame, column: str | None, direction: str | None, key: str = "id") -> DataFrame:
    """By one column, nulls last either way, then by key; without a direction by key only."""
    if not column or direction not in ("asc", "desc"):
        return df.orderBy(key)
    by = F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_last()
    return df.orderBy(by, key)


def page(df: DataFrame, number: int, size: int = 20, order: list[Column] | None = None) -> DataFrame:
    """A page of an ordered frame, from 1; smaller numbers count as 1."""
    first = (max(1, number) - 1) * size
    return (df.orderBy(*order) if order else df).offset(first).limit(size)


def rank_page(df: DataFrame, partition: list[str], order: list[Column], number: int, size: int = 20) -> DataFrame:
    """The same page of every partition."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    first = (max(1, number) - 1) * size
    return df.withColumn("place", place).where((F.col("place") > first) & (F.col("place") <= first + size))


def labelled(listings: DataFrame) -> DataFrame:
    """Listings with the labels that a table shows: barrio, building, short note, coordinates."""
    note = F.coalesce(blank_to_null(F.col("notas")), F.lit("Sin nota"))
    building = F.coalesce(blank_to_null(F.col("ph")), F.lit("Sin PH"))
    both = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    return listings.withColumns(
        {
            "barrio_label": F.coalesce(blank_to_null(F.col("barrio")), F.lit("Sin barrio")),
            "ph_label": F.when(building == "Si", "Sí").otherwise(building),
            "nota_label": F.when(F.length(note) > 72, F.concat(F.substring(note, 1, 72), F.lit("..."))).otherwise(note),
            "coordenadas_label": F.coalesce(blank_to_null(F.col("coordenadas")), F.when(both, F.concat_ws(", ", F.col("latitud").cast("string"), F.col("longitud").cast("string")))),
        }
    )
