"""A walk over the tree of a JSON text, level by level, as native column expressions.

Each level is an array of nodes, a node its path and its own JSON text. An object's
members are read in the document's order (a variant keeps its members by name, so
texts are walked, and variants only say what kind a member is). Of all nodes that
give something, the one whose path is least counts: paths are compared part by
part and an ancestor comes before what is in it, which is the order of a walk in
depth. No row leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrado.functions.numbers import plausible
from terrado.functions.text import let

MEMBERS, ITEMS = "map<string,string>", "array<string>"
#: Names of members, the first that says something counts.
LATITUDES, LONGITUDES, PAIRS = ("latitude", "latitud", "lat"), ("longitude", "longitud", "lng", "lon", "long"), ("coordinates", "coordenadas")


def _children(node: Column, mention: str) -> Column:
    """Array of struct path, text: members or items that are objects or arrays themselves and say one of the names."""
    path, text = node["path"], node["text"]
    is_object = F.startswith(text, F.lit("{"))
    # only where a string begins like an object or an array must variants tell them apart
    unclear = text.rlike(r'"\s*[{\[]')

    def holding(parts: Column) -> Column:
        kinds = F.when(unclear & is_object, F.map_values(F.from_json(text, "map<string,variant>"))).when(unclear, F.from_json(text, "array<variant>"))

        def child(both: Column, i: Column) -> Column:
            kind = F.schema_of_variant(both["kind"])
            # without a kind (members of one name make no variant) the text's first character says it
            holds = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), both["text"].rlike(r"^[{\[]"))
            return F.struct(F.concat(path, F.array(i)).alias("path"), F.when(holds & both["text"].rlike(mention), both["text"]).alias("text"))

        both = F.arrays_zip(parts.alias("text"), F.coalesce(kinds, F.array().cast("array<variant>")).alias("kind"))
        return F.filter(F.transform(both, child), lambda c: c["text"].isNotNull())

    texts = F.when(is_object, F.map_values(F.from_json(text, MEMBERS))).otherwise(F.from_json(text, ITEMS))
    return let(F.coalesce(texts, F.array().cast(ITEMS)), holding)


def first_in_walk(document: Column, found: Callable[[Column], Column], result: str, names: tuple[str, ...]) -> Column:
    """What `found` (of an object's members, as map of texts) gives for the first object, in a walk in depth, for which it is not null.

    result: the type of what is found. names: members without any of which an object
    gives nothing; what doesn't say them is not read. Null, invalid and scalar JSON: null.
    """
    mention = rf'"(?:{"|".join(names)})"\s*:'
    nodes, best = "array<struct<path:array<int>,text:string>>", f"struct<path:array<int>,value:{result}>"
    text = F.trim(F.regexp_replace(document.cast("string"), r"^\s+", ""))
    start = F.when(text.rlike(r"^[{\[]"), F.array(F.struct(F.array().cast("array<int>").alias("path"), text.alias("text")))).otherwise(F.array())
    zero = F.struct(start.cast(nodes).alias("nodes"), F.lit(None).cast(best).alias("best"))
    # a tree has no more levels than brackets that open
    levels = F.length(text) - F.length(F.translate(text, "{[", ""))

    def down(state: Column, _: Column) -> Column:
        def give(node: Column) -> Column:
            members = F.when(F.startswith(node["text"], F.lit("{")), F.from_json(node["text"], MEMBERS))
            return let(let(members, found), lambda v: F.when(v.isNotNull(), F.struct(node["path"].alias("path"), v.alias("value"))))

        here = F.array_min(F.filter(F.transform(state["nodes"], give), lambda x: x.isNotNull())).cast(best)
        least = F.array_min(F.array_compact(F.array(state["best"], here))).cast(best)
        # once something is found, only nodes before it can still matter
        before = lambda b: F.filter(state["nodes"], lambda n: b.isNull() | (n["path"] < b["path"]))
        children = lambda ns: F.flatten(F.transform(ns, lambda n: _children(n, mention)))
        return let(least, lambda b: F.struct(children(before(b)).cast(nodes).alias("nodes"), b.alias("best")))

    steps = F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))
    walk = F.aggregate(steps, zero, lambda s, i: F.when(F.size(s["nodes"]) == 0, s).otherwise(down(s, i)), lambda s: s["best"]["value"])
    return F.when(text.rlike(mention), walk)


def _number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def _first_named(members: Column, names: tuple[str, ...]) -> Column:
    """The first of these members that is not empty, zero, false or null."""
    empty = ("", "0", "0.0", "-0.0", "false", "[]", "{}", "null")

    def said(name: str) -> Column:
        value = F.try_element_at(F.map_values(F.map_filter(members, lambda k, _: k == name)), F.lit(-1))
        return let(value, lambda v: F.when(~v.isin(*empty), v))

    return F.coalesce(*map(said, names))


def _pair(lat: Column, lon: Column) -> Column:
    return let(F.struct(lat.alias("lat"), lon.alias("lon")), lambda p: F.when(plausible(p["lat"], p["lon"]), p))


def _point(members: Column) -> Column:
    """struct lat, lon that an object names itself; of a listed pair the longitude comes first if both orders fit."""
    texted = r"(-?\d+(?:[.,]\d+)?)\s*,\s*(-?\d+(?:[.,]\d+)?)"

    def of_list(both: Column) -> Column:
        return F.coalesce(_pair(F.get(both, F.lit(1)), F.get(both, F.lit(0))), _pair(F.get(both, F.lit(0)), F.get(both, F.lit(1))))

    def of_pair(pair: Column) -> Column:
        listed = let(F.transform(F.slice(F.from_json(pair, ITEMS), 1, 2), _number), of_list)
        return F.when(F.startswith(pair, F.lit("[")), listed).when(~F.startswith(pair, F.lit("{")), _pair(*(_number(F.regexp_extract(pair, texted, k)) for k in (1, 2))))

    named = _pair(_number(_first_named(members, LATITUDES)), _number(_first_named(members, LONGITUDES)))
    return F.coalesce(named, let(_first_named(members, PAIRS), of_pair))


def json_point(document: Column) -> Column:
    """struct lat, lon: the first plausible pair in a JSON text, at any depth and in any order of members.

    An object's own members come before those of the objects in it: a latitude and
    a longitude under their names, then `coordinates` as a list (longitude first if
    both orders fit) or as a text. Of members with one name the last counts.
    """
    return first_in_walk(document, _point, "struct<lat:double,lon:double>", (*LATITUDES, *PAIRS))
