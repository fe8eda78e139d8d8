"""Queries of what a capture keeps between its runs and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.catalogue import matching, searching
from terrado.catalogue.common import edges, registry, table
from terrado.operators import curate, graph, group_upkeep
from terrado.sources import buckets
from terrado.sources.tables import materialize, shared_dir
from terrado.streaming import crawl

QUERIES, SQL, query = registry()

#: What a rebuild of all groups, and an upsert of the whole table, give.
SQL_GROUPS, SQL_MERGED = matching.SQL["connected_components"], searching.SQL["merge_preserve_review"]
LIMITS = crawl.Limits(outside=5, existing=4, stalled=3, links=30)


@query(f"""WITH RECURSIVE cards AS (
  SELECT CAST(user_id AS BIGINT) AS corrida, event_id // 2500 AS listado, event_id // 250 AS scroll, event_id AS lugar, regexp_extract(props, '[0-9]+') AS item,
    event_type = 'error' AS fuera, value > 20 AS existente, event_id % 250 > 240 AND event_type = 'view' AS separador FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY corrida ORDER BY listado, scroll, lugar) AS pos FROM cards WHERE corrida IS NOT NULL),
walk AS (
  SELECT DISTINCT corrida, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS listado, CAST(-1 AS BIGINT) AS scroll, CAST(NULL AS BIGINT) AS lugar, CAST(NULL AS VARCHAR) AS item, '' AS stopped, 0 AS outside, 0 AS existing, 0 AS stalled, 0 AS new_here,
    0 AS outside_here, false AS line, 0 AS links, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS decision FROM placed
  UNION ALL
  SELECT corrida, pos, listado, scroll, lugar, item,
    CASE WHEN decision = 'fuera' AND outside + 1 >= {LIMITS.outside} THEN 'inventario' WHEN decision = 'existente' AND existing + 1 >= {LIMITS.existing} THEN 'guardado' WHEN decision = 'nueva' AND links + 1 >= {LIMITS.links} THEN 'limite' ELSE stopped END,
    CASE decision WHEN 'fuera' THEN outside + 1 WHEN 'existente' THEN 0 WHEN 'nueva' THEN 0 ELSE outside END, CASE decision WHEN 'existente' THEN existing + 1 WHEN 'nueva' THEN 0 ELSE existing END, stalled,
    new_here + CAST(decision = 'nueva' AS INTEGER), outside_here + CAST(decision = 'fuera' AS INTEGER), line OR decision = 'separador', links + CAST(decision = 'nueva' AS INTEGER),
    CASE WHEN decision IN ('fuera', 'existente', 'nueva') THEN list_append(seen, item) ELSE seen END, decision
  FROM (SELECT *, CASE WHEN stopped <> '' THEN 'detenida' WHEN separador THEN 'separador' WHEN list_contains(seen, item) THEN 'repetida' WHEN fuera THEN 'fuera' WHEN existente THEN 'existente' ELSE 'nueva' END AS decision FROM (
    SELECT corrida, pos, listado, scroll, lugar, item, fuera, existente, separador, seen, links, stalled,
      CASE WHEN turned THEN CASE WHEN was = 'limite' THEN was ELSE '' END WHEN moved AND was = '' THEN CASE WHEN had_line THEN 'separador' WHEN stalled >= {LIMITS.stalled} THEN 'estancado' ELSE '' END ELSE was END AS stopped,
      CASE WHEN turned THEN 0 ELSE outside END AS outside, CASE WHEN turned THEN 0 ELSE existing END AS existing, CASE WHEN turned OR moved THEN 0 ELSE new_here END AS new_here,
      CASE WHEN turned OR moved THEN 0 ELSE outside_here END AS outside_here, CASE WHEN turned OR moved THEN false ELSE had_line END AS line
    FROM (
      SELECT w.corrida, c.pos, c.listado, c.scroll, c.lugar, c.item, c.fuera, c.existente, c.separador, w.seen, w.links, w.stopped AS was, w.outside, w.existing, w.new_here, w.outside_here, w.line AS had_line,
        c.listado <> w.listado AS turned, c.listado = w.listado AND c.scroll <> w.scroll AS moved,
        CASE WHEN c.listado <> w.listado THEN 0 WHEN c.scroll = w.scroll THEN w.stalled WHEN w.new_here > 0 OR w.outside_here > 0 THEN 0 ELSE w.stalled + 1 END AS stalled
      FROM walk w JOIN placed c ON c.corrida = w.corrida AND c.pos = w.pos + 1))))
SELECT corrida, listado, scroll, lugar, item, decision, stopped AS motivo FROM walk WHERE pos > 0""")
def crawl_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the cards of crawls: a user's events are a run."""
    k = F.col("event_id")
    whole = lambda n: F.floor(k / n).alias("x")
    cards = table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("corrida"),
        whole(2500).alias("listado"),
        whole(250).alias("scroll"),
        k.alias("lugar"),
        F.regexp_extract("props", "[0-9]+", 0).alias("item"),
        (F.col("event_type") == "error").alias("fuera"),
        (F.col("value") > 20).alias("existente"),
        ((k % 250 > 240) & (F.col("event_type") == "view")).alias("separador"),
    )
    return crawl.crawl_decisions(cards, LIMITS)


@query(SQL_GROUPS)
def groups_kept_up(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a former state of the edges, kept up with those that have changed since."""
    now = materialize(edges(spark, sf).select("publicacion_id", "candidata_id", "estado"))
    k = F.col("publicacion_id")
    before = now.withColumn("estado", F.when(k % 25 == 1, "confirmada").when(k % 25 == 3, "pendiente").otherwise(F.col("estado"))).where(k % 25 != 6)
    changed = now.where((k % 25).isin(1, 3, 6)).select("publicacion_id", "candidata_id")
    members = materialize(graph.groups(before))
    return group_upkeep.maintain_groups(members, now, changed)


@query(SQL_MERGED)
def merge_touched_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The merge that keeps reviewed states, on a table in buckets: only buckets with a changed edge are written."""
    old = edges(spark, sf).select("publicacion_id", "candidata_id", "puntaje", "estado")
    path, keys = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}", ["publicacion_id", "candidata_id"]
    buckets.write_buckets(old, path, keys, 64)
    again = old.where("publicacion_id % 2 = 0").withColumns({"puntaje": F.lit(99).cast("decimal(5,2)"), "estado": F.lit("pendiente")})
    more = old.where("publicacion_id % 7 = 0").withColumns({"candidata_id": -F.col("candidata_id"), "puntaje": F.lit(50).cast("decimal(5,2)"), "estado": F.lit("confirmada")})
    buckets.merge_buckets(path, again.union(more), keys, 64, curate.upsert_edges)
    return buckets.read_buckets(spark, path)
