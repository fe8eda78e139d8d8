"""Text similarity that has no native equal: Arrow-batched."""

from __future__ import annotations

import difflib
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrado.functions.text import address_key


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two keys, the smaller one first so that the order of a pair does not matter."""
    matcher = difflib.SequenceMatcher(None)
    out, last = [], None
    for x, y in zip(a, b, strict=True):
        first, second = (x, y) if x <= y else (y, x)
        if second != last:  # the matcher's index of its second text is costly
            matcher.set_seq2(second)
            last = second
        matcher.set_seq1(first)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


@cache
def _ratio():
    """Made at first use: workers import this module without a session."""
    return F.pandas_udf(_ratios, "double")


def key_similarity(a: Column, b: Column) -> Column:
    """Similarity of two keys: 0 if either is empty, 1 if equal, else by blocks."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(_ratio()(a, b))


def text_similarity(a: Column, b: Column) -> Column:
    return key_similarity(address_key(a), address_key(b))
