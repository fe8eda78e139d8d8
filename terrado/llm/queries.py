"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrado.llm import clustering, conversations, decontam, licenses, packing, pages, pii, quality, simhash, suffix_dedup, topk, toxicity, url_filters
from terrado.llm.common import table


#: The queries' pseudonyms are made with the session's key, or with this public one where it has none.
PII_KEY_SETTING, PUBLIC_KEY = "spark.terrado.pii.key", "public key of the example queries"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_SETTING, PUBLIC_KEY)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_report(table(spark, sf_dir, "documents"), key=pii_key(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality": op2_quality,
        "op3_simhash": op3_simhash,
        "op4_topk": op4_topk,
        "op5_licenses": op5_licenses,
        "op6_pii": op6_pii,
        "op7_decontamination": op7_decontamination,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_conversations": op11_conversations,
        "op12_html": op12_html,
        "op13_clustering": op13_clustering,
    }


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS window
  FROM items, LATERAL unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT row, i, k, array_to_string(w[i : i + k - 1], ' ') AS window
  FROM docs, sizes, LATERAL unnest(range(1, len(w) - k + 2)) AS r(i)),
hits AS (SELECT p.row, p.i, p.k, v.item_id FROM places p JOIN windows v ON p.window = v.window AND p.k = v.k),
hit_words AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT DISTINCT row, i, k FROM hits), LATERAL unnest(range(i, i + k)) AS r(j) GROUP BY row),
hit_items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (row) LEFT JOIN hit_items t USING (row)
"""


def _op1_sql() -> str:
    """The rules as a CASE, the longest first, and the rounds of the propagation as one table each."""
    host_path = [r"regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', {}, 's')".format(i) for i in (1, 2)]
    cases = {"rule": "", "decided": ""}
    for verdict, rule in sorted(url_filters.RULES, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = f"(host = '{rule[:at]}' OR ends_with(host, '.{rule[:at]}')) AND starts_with(path, '{rule[at:]}')"
        cases["rule"] += f" WHEN {fits} THEN '{rule}'"
        cases["decided"] += f" WHEN {fits} THEN '{verdict}'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = r"<a\s[^>]*?href\s*=\s*[\"'']?\s*(?:https?:)?//([^/?#\"''\s>]+)"
    damping, rounds = url_filters.DAMPING, url_filters.rounds_for(url_filters.DAMPING, url_filters.TOLERANCE)
    steps = "".join(
        f""",
r{k} AS MATERIALIZED (SELECT host, kind, sum(score) AS score FROM (
  SELECT s.host, s.kind, seed * {1 - damping} + seed / whole * {damping} * coalesce(idle, 0) AS score FROM seeds s JOIN wholes USING (kind) LEFT JOIN (
    SELECT kind, sum(score) AS idle FROM r{k - 1} r WHERE NOT EXISTS (SELECT 1 FROM shares e WHERE e.src = r.host AND e.kind = r.kind) GROUP BY kind) USING (kind)
  UNION ALL SELECT e.dst, r.kind, r.score * e.share * {damping} FROM r{k - 1} r JOIN shares e ON e.src = r.host AND e.kind = r.kind) GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    )
    return f"""
WITH p AS (SELECT page_id, {low.format(host_path[0])} AS host, {host_path[1]} AS path, html FROM pages),
judged AS MATERIALIZED (SELECT page_id, host, path, CASE{cases["rule"]} END AS rule, CASE{cases["decided"]} END AS decided FROM p),
hosts AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (WHERE decided = 'allow') AS a, count(*) FILTER (WHERE decided = 'block') AS b FROM judged WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT host, 'trust' AS kind, a / CAST(n AS DOUBLE) AS seed FROM hosts WHERE a > 0 UNION ALL SELECT host, 'distrust', b / CAST(n AS DOUBLE) FROM hosts WHERE b * 2 > n),
found AS (SELECT host AS src, {low.format("dst")} AS dst FROM p, LATERAL unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'is')) AS t(dst) WHERE host <> ''),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND dst <> '' GROUP BY ALL),
shares AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS share FROM links
  UNION ALL SELECT 'distrust', dst, src, n / CAST(sum(n) OVER (PARTITION BY dst) AS DOUBLE) FROM links),
wholes AS MATERIALIZED (SELECT kind, sum(seed) AS whole FROM seeds GROUP BY kind),
r0 AS MATERIALIZED (SELECT host, kind, seed AS score FROM seeds){steps},
scores AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS t, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS d FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(decided, CASE WHEN coalesce(d, 0) > coalesce(t, 0) * {url_filters.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores USING (host)"""


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def _op13_sql() -> str:
    """The rounds as tables: assigned (a), then summed to new centroids (c)."""

    def assigned(k: int) -> str:
        return f""",
a{k} AS MATERIALIZED (SELECT row, vec_id, e, k, d FROM (
  SELECT p.*, row_number() OVER (PARTITION BY row ORDER BY d, k) AS r FROM (
    SELECT v.*, c.k, CAST(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.e, c.e)]) AS BIGINT) AS d FROM v, c{k} c) p) WHERE r = 1)"""

    def summed(k: int) -> str:
        return f""",
c{k} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{k - 1} c LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
    SELECT k, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{k - 1}, LATERAL unnest(range(1, {clustering.DIMS + 1})) AS r(i) GROUP BY k, i) GROUP BY k) m USING (k))"""

    rounds = "".join(assigned(k) + summed(k + 1) for k in range(clustering.ROUNDS)) + assigned(clustering.ROUNDS)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = {clustering.DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT k, e FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS k, e FROM v) WHERE k < {clustering.CLUSTERS}){rounds}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{clustering.ROUNDS} a JOIN c{clustering.ROUNDS} c USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": _op1_sql(),
        "op4_topk": OP4_SQL,
        "op7_decontamination": OP7_SQL,
        "op11_conversations": conversations.report_sql(),
        "op13_clustering": _op13_sql(),
    }
