"""Exact top-k search: a dual tree over cover trees.

Vectors become integers, floor(256 x). Pivots from a bounded sample deal all rows
into cells of the nearest pivot, so a cell has a centre and a radius. Each cell of
queries first meets the cell of candidates whose centre promises most; that gives
each query a kth score to beat. Of all other pairs of cells those are left out
whose bound, from the centres' product and the radii, is below the worst kth score
of the queries' cell. What is left is searched in blocks: queries and candidates
are indexed by a cover tree each, and the trees are walked together under the same
bound for every pair of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrado.llm.common import drop_table, materialize, parts, slices

K, EVERY = 5, 50
SCALE = 256
#: Rows of a block, on average.
QUERY_BLOCK, BLOCK = 4096, 8192
#: Rows of a cell, on average, as long as the pivots are fewer than PIVOTS. They are the first of the rows by a hash.
CELL, PIVOTS = 2048, 1024
#: Points of a leaf of candidates and of queries, and by how much the radius shrinks from a level to the next.
LEAF, QUERY_LEAF, SHRINK = 64, 4, 0.6


def upper_bound(product, norm_a, radius_a, norm_b, radius_b):  # noqa: ANN001, ANN201  numbers or arrays
    """No product of a point within radius_a of one centre with one within radius_b of the other is greater."""
    top = product + norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
    return top + 1e-9 * (np.abs(top) + norm_a * norm_b + 1)


class Node:
    """Points within `radius` of `centre`: a leaf has their numbers, an inner node its children."""

    __slots__ = ("centre", "children", "norm", "points", "radius", "stacked", "worst")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray | None, children: list[Node] | None):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf
        self.stacked = None
        if children:
            self.stacked = (np.array([c.centre for c in children]), np.array([c.radius for c in children]), np.array([c.norm for c in children]))


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, leaf: int = LEAF, shrink: float = SHRINK) -> Node:
    """Every child covers its points within `shrink` times its parent's radius; the children's centres are further apart than that.

    Children of few points are gathered into leaves under their parent's centre, so no subtree is a chain of single points.
    """
    points = np.arange(len(x)) if points is None else points
    own = x[points]
    centre = own[np.argmin(((own - own.mean(0)) ** 2).sum(1))]
    away = np.sqrt(((own - centre) ** 2).sum(1))
    radius = float(away.max())
    if len(points) <= leaf or radius == 0:
        return Node(centre, radius, points, None)
    left, far, reach = points, away, shrink * radius
    children: list[Node] = []
    few: list[np.ndarray] = []
    while len(left):
        at = x[left[np.argmax(far)]]  # the furthest point is in no child yet
        distance = np.sqrt(((x[left] - at) ** 2).sum(1))
        inside = distance <= reach
        if inside.sum() * 4 <= leaf:
            few.append(left[inside])
        else:
            children.append(cover_tree(x, left[inside], leaf, shrink))
        far, left = far[~inside], left[~inside]
    if few:
        rest = np.concatenate(few)
        distance = np.sqrt(((x[rest] - centre) ** 2).sum(1))
        order = np.argsort(distance, kind="stable")
        for i in range(0, len(rest), 16 * leaf):
            part = rest[order[i : i + 16 * leaf]]
            children.append(Node(centre, float(distance[order[i : i + 16 * leaf]].max()), part, None))
    return Node(centre, radius, None, children)


class Search:
    """The k best candidates of each query: higher score first, then smaller id; its own id is left out. kth: scores below which nothing counts."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K, kth: np.ndarray | None = None):
        self.q, self.c, self.query_ids, self.ids, self.k = queries, candidates, query_ids, ids, k
        largest = max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
        # products of floats are exact below 2**53; beyond, Python's integers are
        self.exact = queries.shape[1] * float(largest) ** 2 < 2**53
        self.qf, self.cf = queries.astype(float), candidates.astype(float)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64 if self.exact else object)] * len(queries)
        self.best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        self.kth = np.full(len(queries), -np.inf) if kth is None else kth.astype(float)
        self.compared = 0

    def run(self) -> Search:
        if len(self.q) and len(self.c):
            self.walk(cover_tree(self.qf, leaf=QUERY_LEAF), cover_tree(self.cf))
        return self

    def bounds(self, a: Node, b: Node) -> np.ndarray:
        """For each child of b, no product of a point of a with one of its points is greater."""
        centres, radii, norms = b.stacked
        return upper_bound(centres @ a.centre, a.norm, a.radius, norms, radii)

    def walk(self, a: Node, b: Node) -> None:
        """The node of the larger radius is opened; a pair that the worst kth score of a's queries rules out is not visited."""
        if b.children and (not a.children or b.radius >= a.radius):
            top = self.bounds(a, b)
            for i in np.argsort(-top, kind="stable"):
                if top[i] < self.worst(a):
                    break
                self.walk(a, b.children[i])
        elif a.children:
            centres, radii, norms = a.stacked
            top = upper_bound(centres @ b.centre, norms, radii, b.norm, b.radius)
            for child, most in zip(a.children, top, strict=True):
                if most >= self.worst(child):
                    self.walk(child, b)
        else:
            self.compare(a, b)

    def worst(self, a: Node) -> float:
        return self.kth[a.points].min() if a.points is not None else min(self.worst(c) for c in a.children)

    def compare(self, a: Node, b: Node) -> None:
        self.compared += len(a.points) * len(b.points)
        if self.exact:
            products = self.qf[a.points] @ self.cf[b.points].T
        else:
            products = self.q[a.points].astype(object) @ self.c[b.points].astype(object).T
        ids = self.ids[b.points]
        fits = (products >= self.kth[a.points][:, None]).astype(bool) & (ids != self.query_ids[a.points][:, None])
        for at in np.flatnonzero(fits.any(1)):
            i, row, good = a.points[at], products[at], np.flatnonzero(fits[at])
            if len(good) > 8 * self.k and self.exact:
                least = np.partition(row[good], len(good) - self.k)[len(good) - self.k]
                good = good[row[good] >= least]
            new = row[good].astype(np.int64) if self.exact else row[good]
            scores = np.concatenate([self.scores[i], new])
            names = np.concatenate([self.best[i], ids[good]])
            order = np.array(sorted(range(len(names)), key=lambda j: (-scores[j], names[j]))[: self.k]) if len(names) < 64 else np.lexsort((names, -scores))[: self.k]
            self.scores[i], self.best[i] = scores[order], names[order]
            if len(order) == self.k:
                self.kth[i] = max(self.kth[i], float(scores[order[-1]]) if self.exact else np.nextafter(float(scores[order[-1]]), -np.inf))


def _whole(vector: str) -> Column:
    return F.expr(f"size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64) for c in chunks] or [np.zeros(0, np.int64)])
    return flat.reshape(-1, width)


class Pivots:
    """Centres of cells, by the vectors' length; cell 0 of every length has its centre at the origin, for lengths that the sample missed."""

    def __init__(self, sample: list[list[int]]):
        self.by_length: dict[int, np.ndarray] = {}
        for d in {len(v) for v in sample}:
            self.by_length[d] = np.unique(np.array([v for v in sample if len(v) == d], float), axis=0)

    def centres(self, d: int) -> np.ndarray:
        return np.vstack([np.zeros((1, d)), self.by_length.get(d, np.zeros((0, d)))])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance from the centre; the origin only where there is no pivot."""
        centres = self.centres(x.shape[1])
        first = min(1, len(centres) - 1)
        cell = first + np.argmin((centres[first:] ** 2).sum(1)[None, :] - 2 * x @ centres[first:].T, axis=1)
        return cell, np.sqrt(((x - centres[cell]) ** 2).sum(1)) * (1 + 1e-9)


def placed_rows(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows (row, id, d, v) with cell and far, their distance from its centre."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            lengths = np.asarray(batch.column(2))
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                cell, far = pivots.nearest(_matrix(part.column(3), int(d)).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["row", "id", "d", "v", "cell", "far"])

    return rows.select("row", "id", "d", "v").mapInArrow(over, "row long, id long, d int, v array<long>, cell int, far double")


def cell_pairs(query_cells: DataFrame, cells: DataFrame, pivots: Pivots) -> DataFrame:
    """d, q, c, top: each cell of queries (d, q, q_far) with each cell of candidates (d, c, c_far); no product is over top. PIVOTS squared rows a length at most."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, q, q_far, c, c_far = (np.asarray(batch.column(i)) for i in range(5))
            top = np.zeros(len(d))
            for n in np.unique(d):
                at, centres = np.flatnonzero(d == n), pivots.centres(int(n))
                x, y, norms = centres[q[at]], centres[c[at]], np.sqrt((centres**2).sum(1))
                top[at] = upper_bound((x * y).sum(1), norms[q[at]], q_far[at], norms[c[at]], c_far[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(top)], names=["d", "q", "c", "top"])

    both = query_cells.join(cells, "d").select("d", "q", "q_far", "c", "c_far")
    return both.mapInArrow(over, "d int, q int, c int, top double")


def _met(queries: DataFrame, pairs: DataFrame, placed: DataFrame, cells: DataFrame, k: int, chunks: int, block: int) -> DataFrame:
    """query_id, query_row, vec_id, score: the k best of each query in the cells that pairs (d, q, c) has for its cell. queries: row, id, d, v, q, kth."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_row", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        d = len(left["v"][0])
        query_ids, query_rows, ids = np.asarray(right["id"]), np.asarray(right["row"]), np.asarray(left["id"])
        found = Search(_matrix(right["v"], d), query_ids, _matrix(left["v"], d), ids, k, np.asarray(right["kth"])).run()
        sizes = [len(x) for x in found.best]
        return pa.table(
            [
                pa.array(np.repeat(query_ids, sizes), pa.int64()),
                pa.array(np.repeat(query_rows, sizes), pa.int64()),
                pa.array(np.concatenate(found.best).astype(np.int64), pa.int64()),
                pa.array([int(s) for x in found.scores for s in x], pa.int64()),
            ],
            names=names,
        )

    part = lambda row, n: F.pmod(F.xxhash64(row), n)
    # a block is a part of a cell, and meets the chunks of queries that come to it
    sized = cells.select("d", "c", F.ceil(F.col("n") / block).alias("blocks"))
    asked = queries.join(pairs, ["d", "q"]).join(sized, ["d", "c"]).select("d", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), part("row", F.lit(chunks)).alias("chunk"), "row", "id", "v", "kth")
    wanted = pairs.select("d", "c").distinct().join(sized, ["d", "c"])
    offered = placed.withColumnRenamed("cell", "c").join(wanted, ["d", "c"]).select("d", "c", part("row", F.col("blocks")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "v")
    keys = ("d", "c", "b", "chunk")
    return offered.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, query_row long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    k: int = K,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
    cell: int = CELL,
    most_pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of every row whose id is divisible by `every`.

    Rows whose id is null, or whose vector is null, empty or has null or
    non-finite components, take no part; vectors of different lengths don't
    meet. Ties go to the smaller id. Rows that repeat an id are candidates each,
    and none of them is a candidate of that id's own query, which is one query
    for each such row. Vectors of a norm squared of 2**63 or more take no part
    either: a product with one may not fit a long, while any two others' does.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & _whole("v")).withColumn("norm", F.expr(f"aggregate(v, 0D, (t, x) -> t + pow(floor({SCALE}D * least(greatest(x, -1e18D), 1e18D)), 2))"))
    rows = rows.where(F.col("norm") < 2.0**63)
    integers = F.expr(f"transform(v, x -> cast(floor({SCALE}D * least(greatest(x, -1e15D), 1e15D)) as long))")
    rows = materialize(rows.select("id", integers.alias("v"), F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")))
    is_query = F.col("id") % every == 0
    n, m = rows.agg(F.count("*"), F.count_if(is_query)).first()
    pivots = Pivots([r["v"] for r in rows.orderBy(F.xxhash64("row", F.lit("pivot")), "row").limit(min(most_pivots, parts(n, cell))).select("v").collect()])
    placed = materialize(placed_rows(rows, pivots))
    drop_table(rows)
    cells = materialize(placed.groupBy("d", F.col("cell").alias("c")).agg(F.max("far").alias("c_far"), F.count("*").alias("n")))
    queries = materialize(placed.where(is_query).withColumnRenamed("cell", "q").withColumn("kth", F.lit(float("-inf"))))
    query_cells = queries.groupBy("d", "q").agg(F.max("far").alias("q_far"))
    pairs = materialize(cell_pairs(query_cells, cells.select("d", "c", "c_far"), pivots))
    chunks = parts(m, query_block)
    # the first cell of each: that of the highest bound with enough candidates
    enough = F.when(F.col("n") > k, F.col("top"))
    first = pairs.join(cells.select("d", "c", "n"), ["d", "c"]).groupBy("d", "q").agg(F.max_by("c", F.struct(enough.isNotNull(), "top", "c")).alias("c"))
    first = materialize(first)
    seeds = materialize(_met(queries, first, placed, cells, k, chunks, block))
    kth = ranked(seeds, k).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("kth"))
    # a score that a double can't hold is rounded down
    kth = kth.withColumn("kth", F.when(F.abs("kth") >= 2.0**53, F.col("kth") - F.abs("kth") * 1e-15).otherwise(F.col("kth")))
    queries = materialize(queries.drop("kth").join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))
    worst = queries.groupBy("d", "q").agg(F.min("kth").alias("worst"))
    open_ = pairs.join(worst, ["d", "q"]).where("top >= worst").join(first, ["d", "q", "c"], "left_anti").select("d", "q", "c")
    rest = _met(queries, materialize(open_), placed, cells, k, chunks, block)
    return ranked(seeds.union(rest), k).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
