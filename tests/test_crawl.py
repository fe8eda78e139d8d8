"""A crawl's decisions: a table, a stream in any split and a stream that starts again give the same."""

from __future__ import annotations

import random

import pytest

from terrado.streaming.crawl import CARDS, Limits, crawl_decisions, crawl_stream

SCHEMA = "corrida long, listado long, scroll long, lugar long, item string, fuera boolean, existente boolean, separador boolean"
LIMITS = Limits(outside=4, existing=3, stalled=2, links=12)


def cards(seed):
    rng = random.Random(seed)
    rows = []
    for run in range(6):
        for listing in range(rng.randint(1, 4)):
            for scroll in range(rng.randint(1, 9)):
                near = rng.random() < 0.1
                rows += [
                    (run, listing, scroll, k, f"i{rng.randint(0, 14 if run % 2 else 300)}", rng.random() < 0.4, rng.choice([True, False, False, None]), near and k > 3)
                    for k in range(rng.randint(1, 8))
                ]
    return rows


def plain(rows):
    """The rules over one list, in order, with nothing but local variables."""
    out, seen, links = [], {}, {}
    at = None
    for run, listing, scroll, place, item, outside, known, separator in sorted(rows, key=lambda r: r[:4]):
        if at is None or at[0] != run:
            seen[run], links[run], ended = set(), 0, ""
        if at is None or at[:2] != (run, listing):
            foreign = existing = stalled = 0
            ended = "limite" if ended == "limite" else ""
            new = gone = 0
            line = False
        elif at[2] != scroll:
            stalled = 0 if new or gone else stalled + 1
            if not ended:
                ended = "separador" if line else "estancado" if stalled >= LIMITS.stalled else ""
            new = gone = 0
            line = False
        at = (run, listing, scroll)
        if ended:
            what = "detenida"
        elif separator:
            what, line = "separador", True
        elif item in seen[run]:
            what = "repetida"
        else:
            seen[run].add(item)
            if outside:
                what, foreign, gone = "fuera", foreign + 1, gone + 1
                ended = "inventario" if foreign >= LIMITS.outside else ended
            else:
                foreign = 0
                if known:
                    what, existing = "existente", existing + 1
                    ended = "guardado" if existing >= LIMITS.existing else ended
                else:
                    what, existing, new, links[run] = "nueva", 0, new + 1, links[run] + 1
                    ended = "limite" if links[run] >= LIMITS.links else ended
        out.append((run, listing, scroll, place, item, what, ended))
    return out


def test_table(spark):
    rows = cards(1)
    want = plain(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows] + [(None, *rows[0][1:], 2)], SCHEMA + ", links int").repartition(3)
    assert sorted(map(tuple, crawl_decisions(frame, LIMITS).collect())) == sorted(want)
    assert {w[5] for w in want} == {"nueva", "repetida", "fuera", "existente", "separador", "detenida"}
    assert {"inventario", "guardado", "separador", "estancado", "limite"} <= {w[6] for w in plain(cards(1) + [(9 + r[0], *r[1:]) for r in cards(2)])}
    assert crawl_decisions(frame.limit(0), LIMITS).collect() == []


@pytest.mark.parametrize("splits", [2, 5])
def test_stream_in_any_split_and_after_a_restart(spark, tmp_path, splits):
    rows = sorted(cards(3), key=lambda r: r[:4])
    edges = sorted(random.Random(splits).sample(range(1, len(rows)), splits - 1))
    parts = [rows[a:b] for a, b in zip([0, *edges], [*edges, len(rows)], strict=True)]
    source, sink, checkpoint = (str(tmp_path / name) for name in ("cards", "out", "checkpoint"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        for part in parts:  # each batch by a query of its own, which goes on from the checkpoint
            random.Random(4).shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            made = crawl_stream(spark.readStream.schema(SCHEMA).parquet(source), LIMITS)
            made.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(sink).awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(plain(rows))
    assert len(CARDS) == 8
