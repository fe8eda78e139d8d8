"""Near-duplicates meet by SimHash's deletion variants first; the exact similarity decides, and what two bits don't reach meets by its sets."""

from __future__ import annotations

import random

import corpus_pipeline
from terrado.llm import near_duplicates, simhash


def test_simhash_pairs_connect_what_it_links(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(62) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(60)) for v in values[:20]] + [v ^ 3 for v in values[:10]] + values[:15] + [v ^ 0b111 << 20 for v in values[20:30]]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    pairs = [(r.a, r.b) for r in near_duplicates.simhash_pairs(nodes).collect()]
    assert all(a < b for a, b in pairs)
    above = list(range(len(values)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        above[root(a)] = root(b)
    mine = [root(x) for x in range(len(values))]
    above = list(range(len(values)))
    for x in range(len(values)):
        for y in range(x):
            if (values[x] ^ values[y]).bit_count() <= simhash.DISTANCE:
                above[root(x)] = root(y)
    theirs = [root(x) for x in range(len(values))]
    assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_the_stage_takes_simhash_and_checks_its_pairs(spark, monkeypatch):
    rng = random.Random(5)
    long = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    print_of = lambda words: simhash.fingerprint(simhash.shingle_hashes(" ".join(words).encode(), simhash.SHINGLE))
    apart = lambda x, y: (print_of(x) ^ print_of(y)).bit_count()
    near = next(w for w in ([*long[:-1], f"other{k}"] for k in range(1000)) if apart(long, w) <= simhash.DISTANCE)
    far = [f"x{rng.randrange(9000)}" for _ in range(100)]
    edited = next(w for w in ([*far[:50], *[f"new{k}"] * 3, *far[53:]] for k in range(1000)) if apart(far, w) > simhash.DISTANCE)
    # one fingerprint, but no shingle of five words in common
    once, often = ["one"] * 3, ["one"] * 50
    assert apart(once, often) == 0
    texts = [long, near, far, edited, once, often]
    seen = []

    def recorded(distinct, *args):
        seen.extend(r.fp & (1 << 64) - 1 for r in distinct.collect())
        return simhash.fingerprint_links(distinct, *args)

    monkeypatch.setattr(near_duplicates, "fingerprint_links", recorded)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts, 1)]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
    assert sorted(seen) == sorted({print_of(w) for w in texts})
