"""Connected components and groups of matched listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrado.sources.tables import drop_table, materialize

MAX_ROUNDS = 60
#: Links that one task solves (some 20 MB): listings of a city, or the groups that a change touches.
FEW = 200_000
#: A node with more than this share of all links is a hub; there are twice as many of them at most as shares in the whole.
HUB = 1 / 1000


def _nodes(links: DataFrame) -> DataFrame:
    """Of each node a: s, the smallest of it and its neighbours; n, how many of its links lead to larger ones, leaf to smaller ones."""
    both = links.selectExpr("a", "b AS m", "1L AS n", "0L AS leaf").union(links.selectExpr("b", "a", "0L", "1L"))
    return materialize(both.groupBy("a").agg(F.min("m").alias("m"), F.sum("n").alias("n"), F.sum("leaf").alias("leaf")).selectExpr("a", "least(a, m) AS s", "n", "leaf"))


def _state(nodes: DataFrame) -> tuple[int, int]:
    """Links, and nodes that are neither a root only nor a leaf of one root only."""
    found = nodes.agg(F.coalesce(F.sum("leaf"), F.lit(0)), F.count_if((F.col("leaf") > 1) | ((F.col("leaf") == 1) & (F.col("n") > 0)))).first()
    return found[0], found[1]


def _with_least(links: DataFrame, key: str, found: DataFrame, total: int) -> DataFrame:
    """links with the s that `found` (a written table of key, s, n: how many links have it) has for their key.

    A hub's links would all be one task's, so hubs, if there are any, are broadcast; their number is bounded by HUB.
    """
    most = max(1000, int(total * HUB))
    hubs = found.where(F.col("n") > most).select(key, "s")
    if hubs.isEmpty():
        return links.join(found.select(key, "s"), key).select("a", "b", "s")
    marked = links.join(F.broadcast(hubs), key, "left")
    rest = marked.where("s IS NULL").select("a", "b").join(found.where(F.col("n") <= most).select(key, "s"), key)
    return marked.where("s IS NOT NULL").select("a", "b", "s").union(rest.select("a", "b", "s"))


def _in_one_task(links: DataFrame) -> DataFrame:
    """node, component of few links, by union and find."""
    kind = links.schema["a"].dataType
    fields = pa.schema({"node": to_arrow_type(kind), "component": to_arrow_type(kind)})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(node):
            while (up := above.setdefault(node, node)) != node:
                above[node] = above[up]
                node = up
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                least, other = sorted((root(a), root(b)))
                above[other] = least
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, fields.field(0).type), pa.array([root(n) for n in nodes], fields.field(1).type)], schema=fields)

    return links.coalesce(1).mapInArrow(solve, f"node {kind.simpleString()}, component {kind.simpleString()}")


def connected_components(edges: DataFrame, a: str = "publicacion_id", b: str = "candidata_id", max_rounds: int = MAX_ROUNDS, few: int = 0) -> DataFrame:
    """node, component (smallest reachable node) of all nodes of the edges, whose ends have an order and are not null.

    Every round links each node's larger neighbours and then its smaller ones to
    the smallest (large star, small star), which keeps the components and never
    adds links. Rounds are written to the shared folder; only counts come to the
    driver. Edges from a node to itself, repeated and reversed ones do no harm.
    Up to `few` links are solved in one task, which holds them all.
    """
    links = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    if few and links.count() <= few:
        return _in_one_task(links)
    for k in range(max_rounds + 1):
        nodes = _nodes(links)
        total, unsettled = _state(nodes)
        if not unsettled or k == max_rounds:
            drop_table(nodes)
            break
        # links that become alike here are made one at the end of the round; there are never more of them than before
        large = materialize(_with_least(links, "a", nodes.where("n > 0"), total).selectExpr("s AS a", "b").where("a < b"))
        root = materialize(large.groupBy("b").agg(F.min("a").alias("s"), F.count("*").alias("n")))
        # a node's own link to the smallest, and those of its other smaller neighbours
        small = _with_least(large, "b", root, total)
        new = materialize(small.selectExpr("explode(array(struct(s AS a, b), struct(s AS a, a AS b))) AS link").select("link.a", "link.b").where("a < b").distinct())
        for done in (nodes, large, root, links):
            drop_table(done)
        links = new
    if unsettled:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(links.select("a", "a").distinct())


def groups(edges: DataFrame, respect_review: bool = True) -> DataFrame:
    """publicacion_id, inmueble_id: listings joined by confirmed edges; discarded ones never join.

    With respect_review off, an edge that was confirmed again (recomputed) joins although it was discarded.
    """
    state = F.col("estado") if respect_review or "estado_calculado" not in edges.columns else F.coalesce("estado_calculado", "estado")
    found = connected_components(edges.where(state == "confirmada"), few=FEW)
    return found.toDF("publicacion_id", "inmueble_id")


def split_groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups rebuilt from their confirmed edges: publicacion_id, inmueble_id, parte.

    The largest part of a group keeps its id (parte 0), the others are new
    groups (parte 1, 2, ...; by size, then smallest member); single listings leave.
    """
    first = members.select(F.col("publicacion_id").alias("publicacion_id"), F.col("inmueble_id").alias("g1"))
    second = members.select(F.col("publicacion_id").alias("candidata_id"), F.col("inmueble_id").alias("g2"))
    inside = edges.where("estado = 'confirmada'").join(first, "publicacion_id").join(second, "candidata_id").where("g1 = g2")
    parts = connected_components(inside, few=FEW).toDF("publicacion_id", "component")
    sized = members.join(parts, "publicacion_id").groupBy("inmueble_id", "component").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("inmueble_id").orderBy(F.desc("size"), "component")) - 1
    return members.join(parts, "publicacion_id").join(sized.select("inmueble_id", "component", place.alias("parte")), ["inmueble_id", "component"]).select("publicacion_id", "inmueble_id", "parte")
