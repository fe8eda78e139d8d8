"""What the two classifiers share: a bounded sample of labelled rows and monotone calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample_labels(labels: DataFrame, label_col: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most `limit` labelled ids outside the held-out fold, by a hash of the id: doc_id, y (mean label), part (0 to 99)."""
    key = F.col(f"`{id_col}`")
    rows = labels.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull() & (fold(key, folds) != held_out))
    each = rows.groupBy(key.alias("doc_id")).agg(F.avg(F.col(f"`{label_col}`").cast("double")).alias("y"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    return each.orderBy(order, "doc_id").limit(limit).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)).cast("int"))


class Isotonic:
    """Pool-adjacent-violators fit of y on x, read by linear interpolation between the pools' means."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
        pools: list[list[float]] = []  # sum of x, sum of y, rows
        for a, b in zip(x, y, strict=True):
            pools.append([a, b, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[0] / p[2] for p in pools] or [0.0])
        # a pool of a few rows is not certain: half a row of either label is added
        self.y = np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[2] + 1.0) for p in pools] or [0.5]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
