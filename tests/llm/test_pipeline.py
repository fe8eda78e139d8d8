"""The pipeline: every stage on what the one before has kept, against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from terrado.llm import packing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n=120: " ".join(rng.choice(words) for _ in range(n))
    passage = [text(30) for _ in range(4)]
    rows = {i: text() for i in range(300)}
    toxic = set(range(0, 300, 6))
    for i in toxic:
        rows[i] += " you idiot moron scum"
    copies = {}
    for k, i in enumerate(range(1, 60, 6), 400):
        copies[k] = i
        w = rows[i].split()
        rows[k] = " ".join(["new", *w[1:]])
    leaks = set(range(301, 320))
    for i in leaks:
        rows[i] = text(40) + " " + rng.choice(passage).upper() + " " + text(40)
    private = set(range(330, 340))
    for i in private:
        rows[i] = f"{text()} write to p{i}@mail.example.com or 10.0.{i % 200}.7"
    rows[900], rows[901] = None, "A short clean one."
    return rows, toxic, copies, leaks, private, passage


def test_stages(spark, tmp_path):
    rows, toxic, copies, leaks, private, passage = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", t and len(t)) for i, t in rows.items()], DOC)
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passage)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = set(rows)
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, str(tmp_path))
        left.write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        expected -= {"toxicity": toxic, "near_duplicates": {c for c, i in copies.items() if i in expected}, "decontamination": leaks}.get(name, set())
        assert {r.doc_id for r in left.select("doc_id").collect()} == expected, name
        if name != "packing":
            assert left.columns == docs.columns
            assert left.count() == len(expected)
        if name == "pii":
            texts = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
            assert not any(re.search(r"example\.com|10\.0\.\d+\.7", t or "") for t, _ in texts.values())
            assert all(n == len(t) for t, n in texts.values() if t is not None)
            assert all(t == rows[i] for i, (t, _) in texts.items() if i not in private)
    encode = packing.encoder(*packing.tokenizer_paths())
    total = Counter()
    for r in left.collect():
        total[r.doc_id] += r.length
    assert total == {i: len(encode(t or "")) // 4 + 1 for i, (t, _) in texts.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in left.collect())


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOC), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
