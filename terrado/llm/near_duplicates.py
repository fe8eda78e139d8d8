"""Near-duplicates: all pairs of texts at a Jaccard similarity of their word shingles, joined to groups.

Texts whose SimHash fingerprints share a deletion variant (`simhash`) meet first,
and what meets is checked exactly. Two bits of 64 reach few of the similar texts,
so the rest meets by its sets: each text is the set of hashes (64 bits) of its shingles, in one order for all
texts. Two texts at the similarity share a shingle early in both sets (prefix
filter), at places that leave enough of both behind it (positional filter), so
each set is indexed under its first shingles and those that share one meet by an
equality join. Any order is exact; shingles that are common in a sample come
last, so templates fill few buckets. A shingle of one text only is counted and
then left out of the join. With SimHash's pairs each text is compared with the text of
its bucket that has the shingle earliest; then all pairs of a bucket whose texts are
not yet in one group. A pair is dropped if the parity bitmaps of both sets differ
in so many bits that they can't be similar enough (each shared member cancels
out); what is left is decided on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import content_of, drop_table, few, free_name, materialize, slices, utf8
from terrado.llm.components import connected_components
from terrado.llm.simhash import fingerprint, fingerprint_links, shingle_hashes
from terrado.llm.simhash import SHINGLE as SIMHASH_SHINGLE

SHINGLE, SIMILARITY = 5, 0.8
#: Against rounding, where products of the similarity are compared with whole numbers.
EPSILON = 1e-6
#: One text in so many is sampled for common shingles, which are in so many texts of the sample; so many at most are put last.
SAMPLED, COMMON, LISTED = 16, 8, 100_000
#: Texts of a part of a large bucket, each of which meets the whole bucket.
PART = 512
#: Bits of a parity bitmap, at least; a long set has more than twice as many bits as members.
BITS = 1024


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles (A-Z lower-cased, words parted by ASCII white space); texts of fewer words are one shingle."""
    words = text.lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= size:
        found = [h(join(words))]
    elif size == 5:
        found = [h(b"%b %b %b %b %b" % w) for w in zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)]
    else:
        found = [h(join(words[i : i + size])) for i in range(len(words) - size + 1)]
    return np.unique(np.array(found, np.uint64))


def ordered(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the order of all texts: by hash, then common shingles (sorted hashes) by their rank."""
    out = found >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hit = common[at] == found
        out[hit] = rank[at[hit]] | np.uint64(1 << 63)
    return np.unique(out)


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets at the similarity each has one of their common members among so many of its first."""
    return size - math.ceil(similarity * size - EPSILON) + 1


def parity(found: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them: a bit is 1 if an odd number of members has it."""
    bits = max(BITS, 1 << (2 * len(found)).bit_length())
    odd = (np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def unlike_bits(x: str, y: str) -> Column:
    """Bits in which two bitmaps differ; one of twice the words is folded onto itself first, and 0 counts for others."""
    fold = "if(size({0}) = 2 * size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
    counted = "if(size(u) = size(v), aggregate(zip_with(u, v, (p, q) -> bit_count(p ^ q)), 0, (t, n) -> t + n), 0)"
    return F.expr(f"transform(array({fold.format(x, y)}), u -> transform(array({fold.format(y, x)}), v -> {counted})[0])[0]")


def common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of rows (content, text): sorted hashes, and the rank of each (the rarest first)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, size).view(np.int64))], names=["h"])

    sample = rows.where(f"pmod(xxhash64(content), {SAMPLED}) = 0").select("text")
    often = sample.mapInArrow(over, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = often.orderBy(F.desc("n"), "h").limit(LISTED).select("h").toArrow().column(0).to_numpy().view(np.uint64)
    by_hash = np.argsort(found)
    return found[by_hash], (len(found) - by_hash).astype(np.uint64)


def _verified(links: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the links a, b whose sets of shingles are similar enough. rows: doc_id, content, text, each pair of the first two once."""
    marks = nodes.select("node", "size", "bits")
    both = links.join(marks.toDF("a", "a_size", "x"), "a").join(marks.toDF("b", "b_size", "y"), "b")
    differ = unlike_bits("x", "y")
    all_ = F.col("a_size") + F.col("b_size")
    links = materialize(both.where((all_ - differ) / 2 >= similarity / (1 + similarity) * all_ - EPSILON).select("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = materialize(nodes.select("node", "content", "first").join(ends, "node", "left_semi"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [shingles(t, size) for t in utf8(batch.column(1))]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "found"])

    texts = rows.join(few(ends), "content").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")
    sets = materialize(texts.mapInArrow(sets_of, "node long, found array<long>"))
    pairs = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    good = pairs.where(shared >= (similarity - EPSILON) * (F.size("x") + F.size("y") - shared)).select("a", "b")
    good = materialize(good)
    for done in (sets, ends, links):
        drop_table(done)
    return good


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes (node, fp) that connect all whose fingerprints SimHash links: those of one fingerprint by the smallest, linked ones by theirs."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.select("node", "fp").join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    linked = fingerprint_links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return same.union(linked.select(F.least("x", "y"), F.greatest("x", "y")))


def similar_links(nodes: DataFrame, rows: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b that connect all nodes (node, content, first, size, bits, fp, prefix: the first of the ordered set) at the similarity, all of them at it."""

    def fits(size: str, at: str, other_size: str, other_at: str) -> Column:
        """What is left from a shared shingle on can reach the similarity."""
        return F.expr(f"least({size} - {at}, {other_size} - {other_at}) * {1 + similarity}D >= ({size} + {other_size}) * {similarity}D - {EPSILON}D")

    index = nodes.selectExpr("node", "size", "posexplode(prefix) AS (at, key)")
    # of two texts that fit the smaller one is early, so buckets without an early one hold no pair
    early = F.max(fits("size", "at", "size", "at"))
    again = materialize(index.groupBy("key").agg(F.count("*").alias("n"), early.alias("early")).where("n > 1 AND early").select("key", "n"))
    met = materialize(index.join(again, "key"))
    drop_table(again)

    centres = met.groupBy("key").agg(F.min_by(F.struct("node", "size", "at"), F.struct("at", "node")).alias("c"))
    stars = met.join(centres, "key").where("node != c.node").where(fits("size", "at", "c.size", "c.at"))
    stars = stars.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
    tried = materialize(simhash_pairs(nodes).union(stars).distinct())
    links = _verified(tried, nodes, rows, size, similarity)

    # all other pairs of a bucket, but for those that SimHash and the stars have joined; a large bucket's in parts
    grouped = met.where("n > 2").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialize(grouped)
    mixed = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_ = materialize(grouped.join(mixed, "key", "left_semi").select("key", "node", "size", "at", "component", F.ceil(F.col("n") / PART).alias("parts")))
    x = open_.selectExpr("key", "pmod(xxhash64(node), parts) AS part", "node AS a", "size AS a_size", "at AS a_at", "component AS a_component")
    y = open_.selectExpr("key", "explode(sequence(0L, parts - 1)) AS part", "node AS b", "size AS b_size", "at AS b_at", "component AS b_component")
    pairs = x.join(y, ["key", "part"]).where("a < b AND a_component != b_component").where(fits("a_size", "a_at", "b_size", "b_at"))
    more = materialize(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    for done in (met, grouped, open_, tried):
        drop_table(done)
    if more.isEmpty():
        return links
    return links.union(_verified(more, nodes, rows, size, similarity))


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(F.col(f"`{id_col}`")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, repeated: bool | None = None) -> DataFrame:
    """One row per distinct text: content (its MD5), first (the smallest doc_id that has it), n_rows, component_id, keeps.

    component_id is the smallest doc_id of the group, and one text of each group
    keeps. Null and wordless texts are copies of each other. Null ids come last.
    Ids may be of any type that has an order. repeated: whether some repeat, if that is known.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), content_of(text_col).alias("content"), F.col(f"`{text_col}`").cast("string").alias("text"))
    repeated = repeats_ids(docs, id_col) if repeated is None else repeated
    once = rows.dropDuplicates(["doc_id", "content"]) if repeated else rows
    common, rank = common_shingles(rows, size)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column(2))
            found = [shingles(t, size) for t in texts]
            prints = np.array([fingerprint(shingle_hashes(t, SIMHASH_SHINGLE)) for t in texts], "<u8").view("<i8")
            bits = pa.array([parity(x) for x in found], pa.list_(pa.int64()))
            sets = [ordered(x, common, rank) for x in found]
            first = [s[: prefix_length(len(s), similarity)] for s in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), bits, pa.array(prints), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["doc_id", "content", "size", "bits", "fp", "prefix"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(sign, f"doc_id {kind}, content binary, size int, bits array<long>, fp long, prefix array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"]  # false comes before true
    distinct = signed.groupBy("content").agg(first.alias("first"), F.count("*").alias("n_rows"), *(F.first(x).alias(x) for x in ("size", "bits", "fp", "prefix")))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    parts = connected_components(similar_links(nodes, once, size, similarity))
    named = nodes.select("node", "content", "first", "n_rows").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("best"))
    out = named.join(best, "component").select("content", "first", "n_rows", F.col("best.first").alias("component_id"), (F.col("best.node") == F.col("node")).alias("keeps"))
    out = materialize(out)
    drop_table(nodes)
    return out


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: that of the smallest doc_id; all columns stay."""
    repeated = repeats_ids(docs, id_col)
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, repeated=repeated, **options)
    of, here, first, keeps = (free_name(docs, name) for name in ("content", "here", "first", "keeps"))
    judged = groups.where("n_rows > 1 OR NOT keeps").select(F.col("content").alias(here), F.col("first").alias(first), F.col("keeps").alias(keeps))
    judged = few(materialize(judged))
    rows = docs.withColumn(of, content_of(text_col))
    other = ~(F.col(keeps) & F.col(f"`{id_col}`").eqNullSafe(F.col(first)))
    kept = rows.join(judged, (F.col(of) == F.col(here)) & other, "left_anti")
    if repeated:  # rows that repeat id and text are copies, too
        kept = kept.dropDuplicates([id_col, of])
    return kept.drop(of)
