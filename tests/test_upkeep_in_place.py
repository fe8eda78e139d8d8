"""Groups kept up with changes, and tables merged bucket by bucket, against full rebuilds."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from terrado.operators import curate, graph, group_upkeep
from terrado.sources import buckets

EDGES = "publicacion_id long, candidata_id long, estado string"


def test_groups_equal_a_rebuild_after_changes(spark):
    rng = random.Random(7)
    state = {}
    for _ in range(80):
        a, b = sorted(rng.sample(range(60), 2))
        state[a, b] = rng.choice(["confirmada", "pendiente", "descartada"])
    frame = lambda s: spark.createDataFrame([(*k, v) for k, v in s.items()], EDGES)
    members = graph.groups(frame(state))
    for step in range(4):
        changed = {}
        for _ in range(6):
            pair = rng.choice(list(state)) if rng.random() < 0.7 else tuple(sorted(rng.sample(range(70), 2)))
            changed[pair] = rng.choice(["confirmada", "descartada", None])
        state = {k: v for k, v in {**state, **changed}.items() if v}
        pairs = spark.createDataFrame(list(changed), "publicacion_id long, candidata_id long")
        made = [tuple(r) for r in group_upkeep.maintain_groups(members, frame(state), pairs).collect()]
        assert sorted(made) == sorted(map(tuple, graph.groups(frame(state)).collect())), step
        members = spark.createDataFrame(made, "publicacion_id long, inmueble_id long")


def test_untouched_groups_are_not_read(spark):
    edges = spark.createDataFrame([(10 * g, 10 * g + 1, "confirmada") for g in range(50)], EDGES)
    members = graph.groups(edges)
    changed = spark.createDataFrame([(0, 11), (20, 21)], "publicacion_id long, candidata_id long")
    groups, listings = group_upkeep.touched_members(members, changed)
    assert {r[0] for r in groups.collect()} == {0, 10, 20}
    assert {r[0] for r in listings.collect()} == {0, 1, 10, 11, 20, 21}
    assert group_upkeep.touched_edges(edges, listings).count() == 3
    none = spark.createDataFrame([], "publicacion_id long, candidata_id long")
    assert group_upkeep.maintain_groups(members, edges, none).count() == 100


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                found.setdefault(int(folder.rsplit("=", 1)[1]), set()).add((n, os.stat(f"{folder}/{n}").st_mtime_ns))
    return found


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    path, schema, keys = str(tmp_path / "t"), "k long, j string, v int", ["k", "j"]
    old = spark.createDataFrame([(i, f"j{i % 3}", i) for i in range(300)] + [(None, "n", 1)], schema)
    buckets.write_buckets(old, path, keys, 16)
    before = files(path)
    assert set(before) == set(range(16))
    new = spark.createDataFrame([(5, "j2", -5), (1000, "x", 7), (None, "n", 2)], schema)
    touched = buckets.merge_buckets(path, new, keys, 16, lambda a, b: curate.upsert(a, b, keys))
    after = files(path)
    assert 0 < len(touched) <= 3
    assert all((before[k] == after[k]) == (k not in touched) for k in before)
    whole = curate.upsert(old, new, keys)
    rows = lambda df: sorted(map(repr, map(tuple, df.select("k", "j", "v").collect())))
    assert rows(buckets.read_buckets(spark, path)) == rows(whole)
    # the same merge again changes nothing, one of no rows touches nothing
    buckets.merge_buckets(path, new, keys, 16, lambda a, b: curate.upsert(a, b, keys))
    assert rows(buckets.read_buckets(spark, path)) == rows(whole)
    assert buckets.merge_buckets(path, new.limit(0), keys, 16, lambda a, b: curate.upsert(a, b, keys)) == []
    # rows that a merge leaves out are gone, also the last of a bucket
    every = buckets.read_buckets(spark, path).where(buckets.bucket_of(keys, 16) == touched[0])
    buckets.merge_buckets(path, every, keys, 16, lambda a, b: a.limit(0))
    assert rows(buckets.read_buckets(spark, path)) == rows(whole.where(buckets.bucket_of(keys, 16) != touched[0]))
    assert F is not None


def test_components_in_one_task_and_in_rounds_agree(spark):
    rng = random.Random(11)
    rows = [tuple(f"n{x}" for x in rng.sample(range(90), 2)) for _ in range(70)] + [("n1", "n1")]
    frame = spark.createDataFrame(rows, "a string, b string")
    rounds, one = (sorted(map(tuple, graph.connected_components(frame, "a", "b", few=n).collect())) for n in (0, 1000))
    assert rounds == one
