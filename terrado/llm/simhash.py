"""SimHash near-duplicates by deletion-variant signatures.

A signature is cut into fewer segments than the differences that are allowed, so
one segment differs in at most one place. Every segment is indexed under each of
its variants with one place left out; signatures that share a variant meet by an
equality of keys and are verified. The places of SimHash signatures are bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrado.llm.common import few, materialize, slices, texts_of, utf8
from terrado.llm.components import connected_components

#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, DISTANCE = 3, 2


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text (A-Z lower-cased, words parted by ASCII white space); repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], "<u8")
    join = b" ".join
    if size == 3:
        return np.array([h(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:], strict=False)], "<u8")
    return np.array([h(join(words[i : i + size]), seed) for i in range(len(words) - size + 1)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); one row per row of docs."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in utf8(batch.column(1))], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view("<i8"))], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(over, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links a, b that connect all fingerprints of `distinct` (column fp) at `distance` or fewer differing bits; 2 at most.

    64 bits are cut into two halves, of which one differs by a bit at most; each
    half is indexed under its 32 one-wildcard variants. A bucket of two is a
    pair to verify. In larger buckets all pairs would be too many, so their
    members are linked by whole-fingerprint variants, which decide exactly: two
    fingerprints differ by at most two bits if and only if some value is within
    one bit of both, so each joins the smallest that shares a value of its 65
    neighbours. All links are between fingerprints at the distance or joined by
    such a value, so none is false.
    """
    if distance > 2:
        raise ValueError("two halves with one wildcard each find at most two differing bits")
    # segment 0: low half, 1: high half; the key holds the half with one bit cleared, the bit's number and the segment
    bit = "explode(sequence(0, 63)) AS bit"
    variants = distinct.selectExpr("fp", bit).selectExpr(
        "fp", "xxhash64(bit, (fp & (if(bit < 32, 4294967295L, -4294967296L))) & ~shiftleft(1L, bit)) AS key"
    )
    # a bucket is summed up where its rows are, so one that holds very many is no single task's
    buckets = materialize(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    keys = few(materialize(buckets.where("n > 2").select("key")))  # counted: broadcast, or else both sides are shuffled and a hot key is split
    crowded = materialize(variants.join(keys, "key", "left_semi").select("fp").distinct())
    return pairs.union(_neighbour_links(crowded, distance))


def _neighbour_links(members: DataFrame, distance: int) -> DataFrame:
    """fp to the smallest member that shares a value within distance / 2 bits (all of them within `distance` of each other)."""
    if distance < 2:
        around = members.selectExpr("fp", "explode(transform(sequence(0, 63), bit -> xxhash64(bit, fp & ~shiftleft(1L, bit)))) AS value") if distance else members.selectExpr("fp", "fp AS value")
    else:
        around = members.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), bit -> fp ^ shiftleft(1L, bit)))) AS value")
    # a value is near 65 fingerprints at most
    return around.select("fp", F.min("fp").over(Window.partitionBy("value")).alias("a")).where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other.
    Repeated rows and copies share a fingerprint, which is one node of the
    graph. Null ids take part; they are never a component's smallest unless all are null.
    """
    found = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = connected_components(fingerprint_links(distinct.select("fp"), distance))
    # the smallest id of each component, then of each fingerprint that is in one
    named = members.join(distinct, members.node == distinct.fp).select("node", "component", "least")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    every = materialize(distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return found.join(every, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
