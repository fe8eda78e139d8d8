"""Exact order statistics of a column by histograms that are refined: no task and no driver holds its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a histogram; so few values are sorted as they are.
BUCKETS, FEW = 4096, 4096


def _cells(df: DataFrame, low: float, high: float) -> list:
    """Rows of a histogram of x between low and high: cell, n, least, most. At most BUCKETS of them."""
    # halves keep a width beyond the doubles finite; the place never falls as x grows, so a cell holds a run of values whatever the rounding
    half = high / 2 - low / 2
    share = (F.col("x") / 2 - low / 2) / half if half else (F.col("x") - low) / (high - low)
    cell = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    inside = df.where(F.col("x").between(low, high)).groupBy(cell.alias("cell"))
    return sorted(inside.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect(), key=lambda r: r.least)


def value_at(df: DataFrame, rank: int, low: float, high: float, below: int, n: int) -> float:
    """The value at a rank (from 0) of column x, of which n values lie from low to high and `below` under low."""
    while low < high:
        if n <= FEW:
            return sorted(r.x for r in df.where(F.col("x").between(low, high)).collect())[rank - below]
        for c in _cells(df, low, high):
            if rank < below + c.n:
                low, high, n = c.least, c.most, c.n
                break
            below += c.n
    return low


def exact_quantile_values(df: DataFrame, column: Column, ranks_of: tuple[float, ...] = (0.5,)) -> list[float | None]:
    """For each share the mean of the one or two values in the middle there, of those that are neither null nor NaN nor infinite; None without any.

    0.5 is the median. Each round reads the column once and leaves one cell of the
    last; what is collected is one row a cell, or at most FEW values.
    """
    x = column.cast("double")
    values = df.select(x.alias("x")).where(~F.isnan("x") & (F.abs("x") < float("inf")))
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return [None for _ in ranks_of]
    out = []
    for share in ranks_of:
        place = share * (n - 1)
        down, up = int(place), min(int(place) + (place > int(place)), n - 1)
        first = value_at(values, down, low, high, 0, n)
        out.append(first if up == down else _mean(first, _next(values, first, down)))
    return out


def _next(values: DataFrame, value: float, rank: int) -> float:
    """The value one rank up: the same if it fills that rank as well, else the least greater one."""
    upto, following = values.agg(F.count_if(F.col("x") <= value), F.min(F.when(F.col("x") > value, F.col("x")))).first()
    return value if upto > rank + 1 else following


def _mean(a: float, b: float) -> float:
    return 0.5 * a + 0.5 * b
