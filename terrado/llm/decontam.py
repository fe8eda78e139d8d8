"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

DataFrame functions only. Words are A-Z lower-cased runs of letters, digits and
characters beyond ASCII; a window is WINDOW consecutive words of a benchmark
item, or the whole item if it has fewer. Every window of a document is looked up
by a hash of three of its words, where the document is scanned: in a set that is
part of the plan, or in a broadcast table if the set is large. Only what is found
goes on, and is verified by a join on the windows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import WORD, ascii_lower, content_of, drop_table, few, free_name, let, materialize, words

#: Words in a window.
WINDOW = 10
#: The hash set is part of the plan up to so many windows and broadcast up to so many (8 bytes and their place in a hash table each);
#: beyond, hashes and places of all document windows are shuffled, without their words.
MAX_SET, MAX_BROADCAST = 20_000, 2_000_000


def _lowered(text: str) -> str:
    """SQL: a text in lower case, each character for itself: only a capital sigma would look at its neighbours."""
    return f"lower(replace({text}, 'Σ', 'σ'))"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: length, window, probe, items. Null and wordless items have none."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(ascii_lower(F.col(f"`{text_col}`").cast("string"))).alias("w"))
    n = F.size("w")
    length = F.least(n, F.lit(size))
    spans = rows.where(n > 0).select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), n - length)).alias("i"))
    text = F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ")
    return spans.select("item", "length", text.alias("window")).groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    max_set: int = MAX_SET,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hits (array of start, length in words), items (sorted strings).

    Null texts have no words. Repeated rows get a row each; what is found depends
    on the text alone, so it is joined by the text's MD5. An empty benchmark hits nothing.
    """
    grams = materialize(_with_probes(benchmark_windows(benchmark, item_col, item_text_col, size)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), content_of(text_col).alias("content"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = materialize(_seen(rows, grams, max_set, max_broadcast))
    report = materialize(_verified(seen, grams))
    drop_table(grams)
    none = F.array().cast("array<struct<start:int,length:int>>"), F.array().cast("array<string>")
    out = seen.join(report, "content", "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def _verified(seen: DataFrame, grams: DataFrame) -> DataFrame:
    """content, hits, items of the texts that have windows of the benchmark. seen: content, found (array of i, length, window)."""
    at = seen.where("size(found) > 0").select("content", F.explode("found").alias("c")).select("content", "c.i", "c.length", "c.window")
    hits = at.join(few(grams.select("window", "items")), "window")
    return hits.groupBy("content").agg(F.collect_set(F.struct(F.col("i").alias("start"), "length")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _literal(number: int) -> str:
    return f"{number}L" if number > -(2**63) else "(-9223372036854775807L - 1L)"


def _seen(rows: DataFrame, grams: DataFrame, max_set: int, max_broadcast: int) -> DataFrame:
    """rows (content, text and others) without text, with n_words and found: places whose hash is in the set (i, length, window).

    For the hash both sides are lower-cased in full, which is cheap, keeps the
    word boundaries and can only find more. The lambda binds the words, so that they are taken once.
    """
    counts = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    others = [c for c in rows.columns if c != "text"]
    total = sum(counts.values())
    n_words = F.expr(f"cast(size(regexp_extract_all({_lowered("coalesce(text, '')")}, r'{WORD}', 0)) as long)").alias("n_words")
    if not total:
        return rows.select(*others, n_words, F.lit(None).cast("array<struct<i:int,length:int,window:string>>").alias("found"))

    def starts(length: int) -> str:
        return f"if(size(w) >= {length}, sequence(0, size(w) - {length}), cast(array() as array<int>))"

    def probe(length: int) -> str:
        return f"xxhash64(get(w, i), get(w, i + {length // 2}), get(w, i + {length - 1}))"

    def over_words(body: str) -> str:
        return f"transform(array(regexp_extract_all({_lowered("coalesce(text, '')")}, r'{WORD}', 0)), w -> {body})[0]"

    if total <= max_set:
        listed: dict[int, list[str]] = {}
        for r in grams.select("length", "probe").distinct().collect():  # at most max_set rows
            listed.setdefault(r["length"], []).append(_literal(r["probe"]))
        found = [f"transform(filter({starts(n)}, i -> {probe(n)} IN ({', '.join(x)})), i -> named_struct('i', i, 'length', {n}))" for n, x in sorted(listed.items())]
        at = F.expr(over_words(f"named_struct('n_words', cast(size(w) as long), 'at', concat({', '.join(found)}))"))
        marked = rows.select(*others, "text", at.alias("_s"))
        return marked.select(*others, F.col("_s.n_words").alias("n_words"), F.when(F.size("_s.at") > 0, _exact("text", "_s.at")).alias("found"))
    every = ", ".join(f"transform({starts(n)}, i -> named_struct('i', i, 'length', {n}, 'probe', {probe(n)}))" for n in sorted(counts))
    places = rows.select("content", F.expr(f"inline({over_words(f'concat({every})')})"))
    met = places.join(few(materialize(grams.select("length", "probe").distinct()), max_broadcast), ["length", "probe"])
    at = materialize(met.groupBy("content").agg(F.collect_set(F.struct("i", "length")).alias("at")))
    return rows.join(few(at), "content", "left").select(*others, n_words, F.when(F.col("at").isNotNull(), _exact("text", "at")).alias("found"))


def _exact(text: str, at: str) -> Column:
    """The windows of a text at some places: i, length, window."""
    place = lambda w, c: F.struct(c["i"].alias("i"), c["length"].alias("length"), F.array_join(F.slice(w, c["i"] + 1, c["length"]), " ").alias("window"))
    return let(words(ascii_lower(F.col(text))), lambda w: F.transform(F.col(at), lambda c: place(w, c)))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    max_set: int = MAX_SET,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """docs without the rows whose text has a window of the benchmark; all columns stay, and rows without text.

    The MD5s of the texts that go are broadcast up to a counted bound, so the kept rows are not shuffled.
    """
    grams = materialize(_with_probes(benchmark_windows(benchmark, item_col, item_text_col, size)))
    rows = docs.select(content_of(text_col).alias("content"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # written before it is filtered, or else the condition would be pushed below what it tests and take that twice
    seen = materialize(_seen(rows, grams, max_set, max_broadcast).select("content", "found"))
    of = free_name(docs, "content")
    gone = materialize(_verified(seen, grams).select(F.col("content").alias(of)))
    for done in (grams, seen):
        drop_table(done)
    return docs.withColumn(of, content_of(text_col)).join(few(gone), of, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_probes(grams: DataFrame) -> DataFrame:
    of = lambda w: F.xxhash64(F.get(w, F.lit(0)), F.get(w, F.expr("length div 2").cast("int")), F.get(w, F.col("length") - 1))
    return grams.select("*", let(F.split(F.expr(_lowered("window")), " "), of).alias("probe"))


def hit_words(hits: Column) -> Column:
    """Number of words inside any hit."""
    covered = F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    return F.size(F.array_distinct(covered)).cast("long")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs."""
    found = find_contamination(docs, benchmark, **names)
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
