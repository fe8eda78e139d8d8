"""Similar names, phrases, exact ranks and pools against plain versions."""

from __future__ import annotations

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from terrado.operators import fuzzy, phrases, selection
from terrado.operators.windows import newest_of_each


def names_like(rng, n):
    parts = ["san", "villa", "torres de", "la", "el", "altos del", "bosque", "pasto", "rosal", "miraflores", "lorenzo", "ñandu", "2", "aquine", "pinar", "rio"]
    return sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)})


def test_close_names_equal_brute_force(spark):
    rng = random.Random(3)
    names = names_like(rng, 250)
    words = [w[:k] + rng.choice("abcx ") + w[k + 1 :] for w in rng.sample(names, 120) for k in [rng.randrange(len(w))]]
    words += ["a", "zzzz", "x" * 300, "villa " * 40, "san" * 90, names[0], names[0], None, ""]
    frame = spark.createDataFrame([(w, 1) for w in words], "key string, row int")
    catalog = spark.createDataFrame([(n, i, "r") for i, n in enumerate([*names, None, ""])], "key string, ord int, ratio string")
    made = {r.key: [x.key for x in r.near] for r in fuzzy.close_names(frame, catalog).collect()}
    want = {w: near for w in words if w and (near := difflib.get_close_matches(w, names, n=4, cutoff=0.62))}
    assert made == want
    assert len(want) > 100
    few = fuzzy.close_names(frame, catalog, most=1, least=0.9)
    assert {r.key: [x.key for x in r.near] for r in few.collect()} == {w: near for w in words if w and (near := difflib.get_close_matches(w, names, n=1, cutoff=0.9))}
    assert fuzzy.close_names(frame, catalog.limit(0)).count() == 0


def test_few_pairs_survive_the_bounds(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 16))) for _ in range(600)]
    frame = spark.createDataFrame([(w,) for w in sorted(set(pool))], "key string")
    n, survivors = frame.count(), fuzzy.able_pairs(frame, frame, 0.8).count()
    alike = sum(difflib.SequenceMatcher(None, a, b).ratio() >= 0.8 for a in pool[:40] for b in pool)
    assert alike <= survivors < n * n / 50


def brute_hits(text, keys):
    words = text.split(" ")
    return {k for k in keys for i in range(len(words)) if words[i : i + len(k.split(" "))] == k.split(" ")}


@pytest.mark.parametrize("most", [phrases.MAX_BROADCAST, 3])  # the automaton, and the join for larger catalogs
def test_phrases_equal_brute_force(spark, most):
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "ñ"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = [" ".join(rng.choice([*words, "x"]) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["", None, "x", "a" * 50, "a " * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    catalog = spark.createDataFrame([(k, i * 7 % 61, "v") for i, k in enumerate(keys)], "key string, ord int, id string").drop("id")
    hits = {(r.id, r.key) for r in phrases.phrase_hits(frame, catalog, "t", "doc", most).collect()}
    want = {(i, k) for i, t in enumerate(texts) if t for k in brute_hits(t, keys)}
    assert hits == want
    rank = {k: (len(k), -(i * 7 % 61)) for i, k in enumerate(keys)}
    longest = {r.id: r.hit.key for r in phrases.longest_phrases(frame, catalog, "t", "doc", most).collect()}
    assert longest == {i: max((k for j, k in want if j == i), key=rank.__getitem__) for i in {i for i, _ in want}}


def test_exact_median(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 8)
    monkeypatch.setattr(selection, "BUCKETS", 16)
    rng = random.Random(6)
    cases = [
        [rng.gauss(0, 1) for _ in range(501)], [rng.gauss(0, 1) for _ in range(500)], [7.0] * 300, [7.0] * 150 + [8.0] * 150, [2.0**k for k in range(-300, 300)], [1e308, -1e308] * 20,
        [5e-324 * k for k in range(40)], [1.0], [1.0, 2.0], [0.1] * 99 + [1e9], [float(rng.randint(0, 3)) for _ in range(1000)],
    ]
    for values in cases:
        frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double").repartition(3)
        assert selection.exact_quantile_values(frame, F.col("v")) == [statistics.median(values)]
    frame = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert selection.exact_quantile_values(frame, F.col("v"), (0.0, 0.25, 1.0)) == [0.0, 25.0, 100.0]
    assert selection.exact_quantile_values(frame.limit(0), F.col("v")) == [None]


def test_newest_of_each_in_two_levels(spark):
    rows = [(k, i) for i in range(3000) for k in ([0, 1] if i % 50 == 0 else [0])] + [(None, 5)]
    frame = spark.createDataFrame(rows, "k int, id long")
    made = newest_of_each(frame, ["k"], F.desc("id"), 10, F.col("id"), 8)
    want = {(k, i) for key in (0, 1, None) for k, i in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])[:10]}
    assert {(r.k, r.id) for r in made.collect()} == want
    # the common key is dealt out: no part has much more than its share
    parts = frame.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(8))).count().agg(F.max("count")).first()[0]
    assert parts < 2 * 3000 / 8
