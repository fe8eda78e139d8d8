"""Matches with their place and surroundings, as native column expressions.

Spark's pattern functions give texts only. The first match's place comes from
`regexp_instr`; for all matches the pattern itself takes in what stands around each
of them, by a look-behind and a look-ahead of bounded length. So a text is read once
for each part, in time proportional to its length, and no positions are added up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_span(text: Column, pattern: str, group: int = 1) -> Column:
    """struct start (from 1), length, found (a group's text) of the first match; null without one."""
    whole = F.regexp_extract(text, pattern, 0)
    span = F.struct(F.regexp_instr(text, F.lit(pattern)).alias("start"), F.length(whole).alias("length"), F.regexp_extract(text, pattern, group).alias("found"))
    return F.when(text.rlike(pattern), span)


def masked(text: Column, span: Column) -> Column:
    """The text with blanks in place of a span, so that no later pass counts it again; unchanged for a null span."""
    return F.when(span.isNull(), text).otherwise(F.overlay(text, F.repeat(F.lit(" "), span["length"]), span["start"], span["length"]))


def spans(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """Array of struct before, found, after, groups (array): all matches from left to right, with so many characters around each.

    At a text's ends there are fewer. The surroundings may overlap other matches.
    """
    n = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups
    around = f"\\A(?s:.){{0,{max(before - 1, 0)}}}|(?s:.){{{before}}}" if before else ""
    # groups: n of the look-ahead, the text before, the match, its n groups, the text after
    full = f"(?={pattern})(?<=({around}))({pattern})(?=((?s:.){{0,{after}}}))"
    part = lambda k: F.regexp_extract_all(text, F.lit(full), F.lit(k))
    names = ["before", "found", *(f"g{k}" for k in range(n)), "after"]
    zipped = F.arrays_zip(*[part(n + 1 + k).alias(name) for k, name in enumerate(names)])
    found = F.transform(zipped, lambda m: F.struct(m["before"].alias("before"), m["found"].alias("found"), m["after"].alias("after"), F.array(*[m[f"g{k}"] for k in range(n)]).alias("groups")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<before:string,found:string,after:string,groups:array<string>>>"))
