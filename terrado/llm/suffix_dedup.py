"""Suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

The suffixes of a corpus are too many to sort at once, so they are dealt out by
content. In the window of LENGTH bytes at each place the least hash of its GRAM-byte
strings is the window's anchor (of equal ones the last). Equal windows have equal
anchors at equal places, so they meet in the group of that anchor's hash, and
consecutive windows with one anchor are one run. Anchors that occur once are
done with. Runs whose whole context occurs again are removed whole. The other
runs of a group are sorted as suffixes that start at the anchor: a mergesort whose comparisons
find common extensions by binary search over prefix polynomial hashes, verified
on the bytes. They are sorted to the left of the anchor likewise, and neighbours
in both orders give the windows that stand elsewhere. Groups of more than CROWD
different contexts are not sorted in a task, as their neighbours may be many:
their windows are counted by a digest of 128 bits (BLAKE2), without a cap. Whole
contexts are compared by such a digest, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import drop_table, materialize, slices, texts_of, utf8

LENGTH = 200
#: Bytes of the strings among which anchors are chosen.
GRAM = 48
#: Different contexts of an anchor that are sorted in one task (some 0.7 MB; a walk over all neighbours of all is some seconds).
CROWD = 2_000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_CHUNK = (1 << 20) - 1
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, to n at least; a worker keeps the longest."""
    if not _tables or len(_tables[0][0]) <= n:
        _tables.clear()
        size = -(-(n + 1) // 262_144) * 262_144
        _tables.append((_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)))
    return _tables[0]


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128 bits for each of the strings between the places, as two numbers."""
    made = b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), stops.tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _prefix(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Start, number of windows, anchor, anchor's hash and the digest of the whole context, of each run of a text."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    parts: list[tuple[np.ndarray, ...]] = []
    step = _CHUNK - length
    for at in range(0, max(1, len(text) - length + 1), step):
        data = np.frombuffer(text, np.uint8, count=max(0, min(len(text) - at, _CHUNK - 1)), offset=at) if text else np.zeros(0, np.uint8)
        if len(data) < length:
            continue
        p, q = _tables_for(len(data))
        s = _prefix(data, p)
        n = len(data) - gram + 1
        h = _mixed((s[gram:] - s[:-gram]) * q[:n])
        packed = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        anchor = (_LOW - (_least(packed, length - gram + 1) & _LOW)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        anchor = anchor[start]
        end = np.append(start[1:], len(data) - length + 1)  # of the starts
        stop = end - 1 + length
        # the anchor's place and the number of windows go with the bytes
        shape = ((anchor - start) * (length + 1) + (end - start)).astype(np.uint64)
        k = digests(text, start + at, stop + at)
        k1, k2 = k[:, 0] + shape, k[:, 1] ^ shape
        parts.append((start + at, end - start, anchor + at, h[anchor], k1, k2))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty


class Contexts:
    """Contexts of one batch, laid end to end, with prefix hashes; positions are absolute in the buffer."""

    def __init__(self, contexts: list[bytes]):
        self.buffer = b"".join(contexts)
        lengths = np.array([len(c) for c in contexts])
        self.at = (np.cumsum(lengths) - lengths).tolist()
        p, q = _tables_for(len(self.buffer))
        self.s = memoryview(_prefix(np.frombuffer(self.buffer, np.uint8), p))
        self.q = memoryview(q)

    def same(self, a: int, b: int, n: int) -> bool:
        s, q = self.s, self.q
        return (s[a + n] - s[a]) * q[a] & _MASK == (s[b + n] - s[b]) * q[b] & _MASK

    def ahead(self, a: int, b: int, most: int) -> int:
        """Bytes that the strings from a and b have in common, `most` at most: binary search over the hashes, then the bytes."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) >> 1
            if self.same(a, b, mid):
                low = mid
            else:
                high = mid - 1
        while self.buffer[a : a + low] != self.buffer[b : b + low]:  # hashes collided
            low -= 1
        return low

    def behind(self, a: int, b: int, most: int) -> int:
        """The same to the left of a and b."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) >> 1
            if self.same(a - mid, b - mid, mid):
                low = mid
            else:
                high = mid - 1
        while self.buffer[a - low : a] != self.buffer[b - low : b]:
            low -= 1
        return low


def _outwards(at: int, order: list[int], shared: list[int]) -> Iterator[tuple[int, int]]:
    """The other members of a sorted order from one place outwards, with what they share with it, the most first."""
    up, down = at + 1, at - 1
    above = shared[at] if up < len(order) else -1
    below = shared[down] if down >= 0 else -1
    while above >= 0 or below >= 0:
        if above >= below:
            yield order[up], above
            above = min(above, shared[up]) if up + 1 < len(order) else -1
            up += 1
        else:
            yield order[down], below
            down -= 1
            below = min(below, shared[down]) if down >= 0 else -1


def _span(low: int, high: int) -> int:
    """Bits low to high."""
    return ((1 << (high + 1)) - 1) >> low << low if low <= high else 0


def repeated_in_group(c: Contexts, members: list[tuple[int, int, int, bool]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(member, least, greatest) distances from window start to anchor, of windows that another member has.

    A member: its anchor in the buffer, the least and greatest distance of its
    windows, and whether it is asked for. Members are sorted as suffixes from
    the anchor and, mirrored, to its left. With a member that shares `right`
    bytes to the right and `left` bytes to the left, the windows at distances
    length - right to left are shared. The neighbours in both orders bound all
    of these, and mostly cover what they bound at once.
    """
    buffer = c.buffer
    if len(members) == 2:
        (a, low_a, high_a, _), (b, low_b, high_b, _) = members
        right = c.ahead(a, b, length - max(low_a, low_b))
        least = length - right
        left = c.behind(a, b, min(high_a, high_b)) if least <= min(high_a, high_b) else -1
        return [(i, least, left) for i in (0, 1) if least <= left and members[i][3]]

    def by_right(i: int, j: int) -> int:
        a, b = members[i][0], members[j][0]
        most_a, most_b = length - members[i][1], length - members[j][1]
        common = c.ahead(a, b, min(most_a, most_b))
        return buffer[a + common] - buffer[b + common] if common < most_a and common < most_b else most_a - most_b

    def by_left(i: int, j: int) -> int:
        a, b = members[i][0], members[j][0]
        common = c.behind(a, b, min(members[i][2], members[j][2]))
        return buffer[a - common - 1] - buffer[b - common - 1] if common < members[i][2] and common < members[j][2] else members[i][2] - members[j][2]

    n = len(members)
    orders = [sorted(range(n), key=cmp_to_key(f)) for f in (by_right, by_left)]
    rights = [c.ahead(members[i][0], members[j][0], length - max(members[i][1], members[j][1])) for i, j in zip(orders[0], orders[0][1:], strict=False)]
    lefts = [c.behind(members[i][0], members[j][0], min(members[i][2], members[j][2])) for i, j in zip(orders[1], orders[1][1:], strict=False)]
    places = [{i: k for k, i in enumerate(order)} for order in orders]
    out: list[tuple[int, int, int]] = []
    for i, (anchor, low, high, asked) in enumerate(members):
        if not asked:
            continue
        from_right = _outwards(places[0][i], orders[0], rights)
        from_left = _outwards(places[1][i], orders[1], lefts)
        r, l = next(from_right), next(from_left)
        first, last = max(low, length - r[1]), min(high, l[1])
        full, mask = _span(first, last), 0
        while mask != full:
            if r is None or length - r[1] > last or l is None or l[1] < first:
                break  # what is left shares too little on one side
            left = c.behind(anchor, members[r[0]][0], min(high, members[r[0]][2]))
            mask |= _span(max(low, length - r[1]), left)
            right = c.ahead(anchor, members[l[0]][0], length - max(low, members[l[0]][1]))
            mask |= _span(max(low, length - right), min(high, l[1]))
            r, l = next(from_right, None), next(from_left, None)
        while mask:
            least = (mask & -mask).bit_length() - 1
            run = (~(mask >> least) & ((mask >> least) + 1)).bit_length() - 1
            out.append((i, least, least + run - 1))
            mask &= ~_span(least, least + run - 1)
    return out


def _stored(texts: DataFrame) -> DataFrame:
    """row, doc_id, z (text as compressed UTF-8): the corpus under stable row numbers, written once."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            z = pa.array([pack.compress(t) for t in utf8(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), z], names=["row", "doc_id", "z"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(numbered.mapInArrow(over, "row long, doc_id long, z binary"))


def _texts(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for z in column:
        yield unpack.decompress(z.as_py())


_RUN = "h long, k1 long, k2 long, row long, p int, n int, a int"


def _runs(stored: DataFrame, length: int, gram: int, only_hash: bool) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = runs_of(text, length, gram)
                held.append((found[3],) if only_hash else (*found[3:], np.full(len(found[0]), row), found[0], found[1], found[2]))
                size += len(found[0])
                if size > 100_000:
                    yield joined(held)
                    held, size = [], 0
            if held:
                yield joined(held)

    def joined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        arrays = [pa.array(x.view(np.int64)) for x in columns[:3]] + [pa.array(x.astype(np.int64)) for x in columns[3:4]] + [pa.array(x.astype(np.int32)) for x in columns[4:]]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "k1", "k2", "row", "p", "n", "a"][: len(arrays)])

    return stored.select("row", "z").mapInArrow(over, "h long" if only_hash else _RUN)


_CONTEXT = "h long, row long, p int, n int, a int, asked boolean, times long, context binary"


def _contexts(stored: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs (h, row, p, n, a, times)."""
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "p", "n", "a", "times")).alias("runs"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            size = 0
            for row, text, runs in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2), strict=True):
                for r in runs.as_py():
                    context = text[r["p"] : r["p"] + r["n"] - 1 + length]
                    for x, v in zip(out, (r["h"], row, r["p"], r["n"], r["a"], r["times"] == 1, r["times"], context), strict=True):
                        x.append(v)
                    size += len(context)
                if size > 4_000_000:
                    yield made(out)
                    out, size = [[] for _ in range(8)], 0
            yield made(out)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    names = ["h", "row", "p", "n", "a", "asked", "times", "context"]

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return stored.select("row", "z").join(by_row, "row").select("row", "z", "runs").mapInArrow(over, _CONTEXT)


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (row, s, e) of groups that fit a task."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        c = Contexts([r[5] for r in rows])
        found: list[tuple[int, int, int]] = []
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            group = rows[at:to]
            members = [(c.at[at + i] + a - p, a - (p + n - 1), a - p, asked) for i, (_, _, p, n, a, _, asked) in enumerate(group)]
            for i, least, greatest in repeated_in_group(c, members, length):
                _, row, _, _, a, _, _ = group[i]
                found.append((row, a - greatest, a - least + length))
            at = to
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["row", "s", "e"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches):
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size > 500_000 and r[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield spans(held)

    dealt = contexts.select("h", "row", "p", "n", "a", "context", "asked").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(over, "row long, s long, e long")


def _crowded_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (row, s, e) of groups of any size: windows counted by their digests."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for row, p, n, asked, times, context in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                i = np.arange(n)
                w = digests(context, i, i + length)
                for x, v in zip(out, (w[:, 0], w[:, 1], np.full(n, row), i + p, np.full(n, times if not asked else 1)), strict=True):
                    x.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in out], names=["w1", "w2", "row", "p", "times"])

    windows = contexts.select("row", "p", "n", "asked", "times", "context").mapInArrow(over, "w1 long, w2 long, row long, p long, times long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("w1", "w2")
    return windows.where("times = 1").join(twice, ["w1", "w2"], "left_semi").select("row", F.col("p").alias("s"), (F.col("p") + length).alias("e"))


def repeated_spans(stored: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """row, spans: array of (s, e), unordered and overlapping, of the bytes of each text that has any."""
    # written, so that both sides of the join below are plain exchanges and a very common anchor's rows are split
    again = materialize(_runs(stored, length, gram, True).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    runs = materialize(_runs(stored, length, gram, False).join(again, "h", "left_semi"))
    keys = runs.groupBy("h", "k1", "k2").agg(F.count("*").alias("times"), *(F.first(x).alias(x) for x in ("row", "p", "n", "a")))
    keys = materialize(keys)
    whole = runs.join(keys.where("times > 1").select("h", "k1", "k2"), ["h", "k1", "k2"], "left_semi")
    whole = whole.select("row", F.col("p").cast("long").alias("s"), (F.col("p").cast("long") + F.col("n") - 1 + length).alias("e"))
    groups = keys.groupBy("h").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("kinds > 1 AND fewest = 1").select("h", "kinds")
    wanted = keys.join(groups, "h").select("h", "row", "p", "n", "a", "times", "kinds")
    contexts = materialize(_contexts(stored, wanted, length).join(groups, "h"))
    partly = _sorted_groups(contexts.where(F.col("kinds") <= crowd), length)
    crowded = _crowded_groups(contexts.where(F.col("kinds") > crowd), length)
    return whole.union(partly).union(crowded).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed (array of start, end in bytes), kept (the other bytes, as binary).

    Texts are their UTF-8 bytes, null ones empty; what is shorter than `length`
    keeps all. Matches never cross rows; repeated rows are copies of each other.
    """
    stored = _stored(texts_of(docs, id_col, text_col))
    spans = repeated_spans(stored, length, gram, crowd)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, removed, kept = [], [], []
            for text, found in zip(_texts(batch.column(1)), batch.column(2), strict=True):
                gone = merged([(x["s"], x["e"]) for x in found.as_py() or ()])
                cuts = [0, *(x for span in gone for x in span), len(text)]
                sizes.append(len(text))
                removed.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    joined = stored.join(spans, "row", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(over, "doc_id long, n_bytes long, removed array<struct<start:long,`end`:long>>, kept binary")


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove_repeats(docs, **options)
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"])
    return done.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(text: bytes, all_windows: dict[bytes, int], length: int = LENGTH) -> tuple[int, int, int, str]:
    """What removal_report returns of a text, given the count of every window of the corpus; for tests."""
    spans = merged([(i, i + length) for i in range(len(text) - length + 1) if all_windows[text[i : i + length]] > 1])
    cuts = [0, *(x for span in spans for x in span), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()
