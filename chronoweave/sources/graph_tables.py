"""Knowledge-graph tables derived from the warehouse tables, as Spark views and as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One text for both engines.
VIEWS = {
    "entities": """
SELECT concat('R', CAST(r_regionkey AS VARCHAR(20))) AS entity_id, r_name AS canonical_name, 'place' AS entity_type FROM region
UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR(20))), n_name, 'place' FROM nation
UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR(20))), c_name, 'person' FROM customer
UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR(20))), s_name, 'company' FROM supplier
UNION ALL SELECT concat('P', CAST(p_partkey AS VARCHAR(20))), p_name, 'project' FROM part""",
    "facts": """
SELECT concat('fl', CAST(c_custkey AS VARCHAR(20))) AS fact_id, concat('C', CAST(c_custkey AS VARCHAR(20))) AS subject_id, 'lives_in' AS predicate,
  concat('N', CAST(c_nationkey AS VARCHAR(20))) AS object_id, CAST(NULL AS VARCHAR(40)) AS object_value,
  CAST(NULL AS TIMESTAMP) AS valid_at, CAST(NULL AS TIMESTAMP) AS invalid_at,
  TIMESTAMP '1994-01-01 00:00:00' AS created_at, CAST(NULL AS TIMESTAMP) AS expired_at, CAST(1.0 AS DOUBLE) AS confidence FROM customer
UNION ALL SELECT concat('fs', CAST(s_suppkey AS VARCHAR(20))), concat('S', CAST(s_suppkey AS VARCHAR(20))), 'located_in',
  concat('N', CAST(s_nationkey AS VARCHAR(20))), NULL, NULL, NULL, TIMESTAMP '1994-01-01 00:00:00', NULL, CAST(1.0 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('fn', CAST(n_nationkey AS VARCHAR(20))), concat('N', CAST(n_nationkey AS VARCHAR(20))), 'part_of',
  concat('R', CAST(n_regionkey AS VARCHAR(20))), NULL, NULL, NULL, TIMESTAMP '1994-01-01 00:00:00', NULL, CAST(1.0 AS DOUBLE) FROM nation
UNION ALL SELECT concat('fo', CAST(o_orderkey AS VARCHAR(20))), concat('C', CAST(o_custkey AS VARCHAR(20))), 'has_status', NULL, o_orderstatus,
  o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL '90' DAY END, CAST(0.9 AS DOUBLE) FROM orders
UNION ALL SELECT concat('fp', CAST(l_suppkey AS VARCHAR(20)), '_', CAST(l_partkey AS VARCHAR(20))), concat('S', CAST(l_suppkey AS VARCHAR(20))), 'owns',
  concat('P', CAST(l_partkey AS VARCHAR(20))), NULL, min(l_shipdate), NULL, min(l_shipdate), NULL, CAST(1.0 AS DOUBLE) - min(l_discount)
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "causal_events": """
SELECT event_id, event_id AS fact_id, concat('U', CAST(user_id AS VARCHAR(20))) AS subject_id, event_type AS predicate,
  CASE WHEN event_type = 'error' THEN 'weakened' WHEN event_type = 'purchase' THEN 'strengthened' ELSE 'created' END AS transition_type,
  value AS delta_confidence, ts AS occurred_at FROM events""",
    "causal_edges": """
SELECT event_id AS edge_id, event_id AS cause_event_id, nxt AS effect_event_id, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + abs(value - nv)) AS strength,
  CASE WHEN event_id % 7 = 0 THEN nts END AS expired_at, 1 + (event_id % 3) AS corroboration_count, nts AS created_at
FROM (SELECT event_id, value, lead(event_id) OVER w AS nxt, lead(value) OVER w AS nv, lead(ts) OVER w AS nts
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE nxt IS NOT NULL""",
    "memory_entities": """
SELECT vec_id AS memory_id, concat('S', CAST(vec_id % (SELECT count(*) FROM supplier) AS VARCHAR(20))) AS entity_id FROM embeddings
UNION ALL SELECT vec_id, concat('N', CAST(vec_id % 25 AS VARCHAR(20))) FROM embeddings WHERE vec_id % 2 = 0""",
    "participants": """
SELECT DISTINCT conv_id AS stream_id, role AS speaker_key, concat('K', CAST(conv_id AS VARCHAR(20)), ':', role) AS entity_id
FROM conversations WHERE role IN ('user', 'assistant')""",
    "aliases": """
SELECT entity_id, canonical_name AS alias FROM entities
UNION SELECT entity_id, lower(replace(canonical_name, ' ', '_')) FROM entities
UNION SELECT entity_id, substr(canonical_name, 1, 4) FROM entities WHERE entity_type = 'place'""",
    "mentions": """
SELECT entity_id, vec_id AS memory_id, label, embedding FROM memory_entities JOIN embeddings ON vec_id = memory_id""",
    "entity_clusters": """
SELECT entity_id, label AS cluster, CAST(n AS DOUBLE) / total AS probability FROM (
  SELECT entity_id, label, n, sum(n) OVER (PARTITION BY entity_id) AS total, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, label) AS r
  FROM (SELECT entity_id, label, count(*) AS n FROM mentions GROUP BY entity_id, label) x) y WHERE r = 1""",
    "regions_of": """
SELECT concat('S', CAST(s_suppkey AS VARCHAR(20))) AS entity_id, n_regionkey AS component FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR(20))), n_regionkey FROM nation""",
    "contradictions": """
SELECT fact_id AS contradiction_id, fact_id AS fact_a, prior AS fact_b, CASE WHEN expired_at IS NULL THEN 'opposing' ELSE 'expired_cited' END AS kind,
  confidence, created_at AS detected_at, CASE WHEN ends IS NOT NULL AND ends < TIMESTAMP '1996-01-01 00:00:00' THEN ends END AS resolved_at, subject_id
FROM (SELECT *, lag(fact_id) OVER w AS prior, lag(object_value) OVER w AS was, invalid_at AS ends FROM facts WHERE predicate = 'has_status'
      WINDOW w AS (PARTITION BY subject_id ORDER BY valid_at, fact_id)) x WHERE was <> object_value""",
    "reports": """
SELECT event_id AS report_id, CAST(event_id % 1000 AS VARCHAR(20)) AS invocation_id, event_type AS mode, concat('U', CAST(user_id AS VARCHAR(20))) AS entity_id, ts AS created_at, value AS score FROM events""",
}


class Tables:
    """The tables of one folder: ``tables.orders`` reads a file, ``tables.facts`` is a view over files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = VIEWS[name]
        used = {t: getattr(self, t) for t in [*BASE, *VIEWS] if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
        return self.spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text), **used)


def with_views(sql: str) -> str:
    """``sql`` for the oracle with the views that it names as common table expressions before its own."""
    wanted, todo = set(), [sql]
    while todo:
        text = todo.pop()
        new = {v for v in VIEWS if v not in wanted and re.search(rf"\b{v}\b", text)}
        wanted |= new
        todo += [VIEWS[v] for v in new]
    named = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in VIEWS if v in wanted]
    if not named:
        return sql
    if m := re.match(r"\s*WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{', '.join(named)}, {sql[m.end():]}"
    return f"WITH {', '.join(named)} {sql}"
