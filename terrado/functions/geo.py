"""Distances, closeness and hash distances, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0

# Words that, with a number, make an address one of a street.
STREET_LEVEL = r"\b(?:cl|kr|av|transversal|tv|diagonal|dg|manzana|mz|lote|lt|torre|piso|apto|apartamento)\b\s*\d"


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    lat1, lon1, lat2, lon2 = (c.cast("double") for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_METRES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def relative_gap(a: Column, b: Column) -> Column:
    """Difference by the larger absolute value; null if either is null or zero."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((a != 0) & (b != 0), F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def relative_close(a: Column, b: Column, tolerance: float = 0.10) -> Column:
    """False, not null, if either is null or zero."""
    return F.coalesce(relative_gap(a, b) <= tolerance, F.lit(False))


def price_gap(a: Column, b: Column) -> Column:
    return relative_gap(F.abs(a.cast("double")), F.abs(b.cast("double")))


def is_street_level(address_key: Column) -> Column:
    return F.coalesce(address_key.rlike(STREET_LEVEL), F.lit(False))


def hash_bits(hexadecimal: Column) -> Column:
    """16 hex digits as a signed long."""
    return F.conv(hexadecimal, 16, -10).try_cast("bigint")


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b)))
