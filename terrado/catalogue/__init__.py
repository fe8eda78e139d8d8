"""The engine's operators as queries over the driver's tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrado.catalogue import analytic, capturing, extraction, keeping, market, matching, portal_pages, searching, textual

_PARTS = (searching, matching, analytic, textual, extraction, market, portal_pages, keeping, capturing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
