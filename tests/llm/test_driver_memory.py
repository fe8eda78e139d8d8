"""What takes the driver's memory: records of the tasks that rounds of components take, and the plan of the pseudonyms."""

from __future__ import annotations

import hashlib

from terrado.llm import pii
from terrado.llm.components import connected_components


def test_rounds_of_components_take_few_tasks(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {name: spark.conf.get(name) for name in held}
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, i) for i in range(51, 1300)], "a long, b long")
    context = spark.sparkContext
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        context.setJobGroup("components", "")
        parts = {r.node: r.component for r in connected_components(links).collect()}
    finally:
        context._jsc.clearJobGroup()
        for name, value in before.items():
            spark.conf.set(name, value)
    assert parts == {i: 0 for i in range(21)} | {i: 50 for i in range(50, 1300)}
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert tasks < 1500


def test_pseudonyms_are_planned_once(spark):
    rows = spark.createDataFrame([(1, "DE00 3704 0044 0532 0130 00 4111 1111 1111 1111 20 a@b.co")], "doc_id long, text string")
    made = pii.pseudonymise(rows, key="k")
    assert made._jdf.queryExecution().analyzed().toString().count("@pseudonym.invalid") == 1
    # what one step took for an IBAN is read again by the next ones
    assert made.first().text == "DE00 3704 0044 0532 0130 00 2322 4305 0193 5197 20 " + pseudonym_of("a@b.co")


def pseudonym_of(address: str) -> str:
    key = hashlib.sha256(b"k").hexdigest()
    return "u" + hashlib.sha256(f"{key}|email|{address}".encode()).hexdigest()[:20] + "@pseudonym.invalid"
