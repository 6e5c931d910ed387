"""Causal traces, patterns, contradictions and blast radius."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import causal as C
from chronoweave.operators import temporal as BT
from chronoweave.operators.intervals import FAR, LOW, micros, overlapping
from chronoweave.plans.stash import stash
from chronoweave.registry import query


@query("""SELECT edge_id, CASE WHEN strength > 0.5 THEN 'strength' ELSE 'unknown_event' END AS reason FROM (SELECT edge_id, strength, effect_event_id FROM causal_edges) x WHERE strength > 0.5 OR effect_event_id % 50 = 0""")
def ca1_check_edges(t):
    edges = t.causal_edges.select("edge_id", "cause_event_id", "effect_event_id", F.when(F.col("strength") > 0.5, F.col("strength") + 1).otherwise(F.col("strength")).alias("strength"))
    lost = edges.withColumn("effect_event_id", F.when(F.col("effect_event_id") % 50 == 0, -1).otherwise(F.col("effect_event_id")))
    return C.check_edges(lost, t.causal_events)[1].select("edge_id", "reason")


_SEEN = """k AS MATERIALIZED (SELECT event_id, concat(subject_id, '|', predicate) AS k FROM causal_events), o AS MATERIALIZED (SELECT edge_id, cause_event_id AS c, effect_event_id AS f, strength AS s, concat(x.k, '>', y.k) AS m FROM causal_edges JOIN k x ON x.event_id = cause_event_id JOIN k y ON y.event_id = effect_event_id WHERE expired_at IS NULL),
w AS MATERIALIZED (SELECT event_id + 1000000 AS edge_id, event_id AS c, CASE WHEN event_id % 2 = 0 THEN n1 ELSE n2 END AS f FROM (SELECT event_id, lead(event_id) OVER z AS n1, lead(event_id, 2) OVER z AS n2 FROM events WINDOW z AS (PARTITION BY user_id ORDER BY ts, event_id)) q WHERE event_id % 3 = 0),
a AS MATERIALIZED (SELECT w.*, concat(x.k, '>', y.k) AS m FROM w JOIN k x ON x.event_id = c JOIN k y ON y.event_id = f), ex AS (SELECT c, f, min(edge_id) AS e FROM o GROUP BY 1, 2), al AS (SELECT m, edge_id AS e FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY s DESC, edge_id) AS r FROM o) q WHERE r = 1),
t AS MATERIALIZED (SELECT a.*, coalesce(ex.e, al.e) AS e FROM a LEFT JOIN ex ON ex.c = a.c AND ex.f = a.f LEFT JOIN al ON al.m = a.m)"""


def _seen(t):
    z = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = t.events.select("event_id", F.lead("event_id").over(z).alias("n1"), F.lead("event_id", 2).over(z).alias("n2")).filter("event_id % 3 = 0")
    to = F.when(F.col("event_id") % 2 == 0, F.col("n1")).otherwise(F.col("n2"))
    return n.select((F.col("event_id") + 1000000).alias("edge_id"), F.col("event_id").alias("cause_event_id"), to.alias("effect_event_id"), F.lit(0.3).alias("strength")).filter("effect_event_id is not null")


@query(f"WITH {_SEEN}, n AS (SELECT e, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY 1) SELECT edge_id, round(CASE WHEN n.n > 0 THEN least(1.0, strength + 0.05 * n.n) ELSE strength END, 9) AS strength, corroboration_count + coalesce(n.n, 0) AS n FROM causal_edges LEFT JOIN n ON n.e = edge_id UNION ALL SELECT min(edge_id), round(least(1.0, 0.3 + 0.05 * (count(*) - 1)), 9), count(*) FROM t WHERE e IS NULL GROUP BY m")
def ca2_corroborate(t):
    """Observations of the next event, an edge that is there, or of the one after it, which only an edge of one meaning can match."""
    held, fresh = C.corroborate_or_insert(t.causal_edges, _seen(t), t.causal_events)
    columns = ["edge_id", F.round("strength", 9).alias("strength"), F.col("corroboration_count").cast("long").alias("n")]
    return held.select(*columns).unionByName(fresh.select(*columns))


@query("SELECT edge_id, 'expired' AS event_type, strength AS previous, 'weak' AS reasoning FROM causal_edges WHERE expired_at IS NULL AND strength < 0.02 AND edge_id % 5 <> 0")
def ca3_expire_edges(t):
    weak = t.causal_edges.filter("strength < 0.02").select("edge_id", F.lit("2024-03-01").cast("timestamp").alias("at"), F.when(F.col("edge_id") % 5 == 0, " ").otherwise("weak").alias("reason"))
    return C.expire_edges(t.causal_edges, weak)[1]


@query("""SELECT edge_id, CASE WHEN corroboration_count > 1 THEN 'weakened' ELSE 'expired' END AS outcome, round(CASE WHEN corroboration_count > 1 THEN greatest(0.1, strength * pow(0.8, n)) END, 9) AS strength
FROM causal_edges JOIN (SELECT edge_id, count(*) AS n FROM (SELECT edge_id, cause_event_id AS f FROM causal_edges UNION SELECT edge_id, effect_event_id FROM causal_edges) r WHERE f % 5 = 0 GROUP BY 1) g USING (edge_id) WHERE expired_at IS NULL""")
def ca4_cascade(t):
    e = t.causal_edges
    refs = e.select("edge_id", F.col("cause_event_id").alias("fact_id")).union(e.select("edge_id", "effect_event_id"))
    out = C.cascade(e, refs, t.causal_events.filter("event_id % 5 = 0").select("fact_id"))
    return out.withColumn("strength", F.round("strength", 9))


@query("""SELECT edge_id, CASE WHEN strength * 0.95 < 0.1 THEN 'expired' ELSE 'decayed' END AS outcome, round(greatest(0.1, strength * 0.95), 9) AS strength FROM causal_edges WHERE expired_at IS NULL AND corroboration_count <= 1 AND created_at < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY AND cause_event_id % 4 <> 0""")
def ca5_decay(t):
    edges = t.causal_edges.withColumn("inferred_by", F.when(F.col("cause_event_id") % 4 == 0, "user").otherwise("llm"))
    return C.decay(edges, F.lit("2024-03-01").cast("timestamp"), source="llm").withColumn("strength", F.round("strength", 9))


_TRACE = """WITH RECURSIVE w AS (SELECT event_id AS seed, event_id, 0 AS depth, CAST(NULL AS DOUBLE) AS strength, [event_id] AS path FROM causal_events WHERE event_id % 40 = 0
UNION ALL SELECT w.seed, e.{to}, w.depth + 1, e.strength, list_append(w.path, e.{to}) FROM w JOIN causal_edges e ON e.{at} = w.event_id WHERE e.expired_at IS NULL AND e.strength >= 0.02 AND w.depth < 4 AND NOT list_contains(w.path, e.{to}))
SELECT seed, event_id, depth, round(strength, 9) AS strength FROM w WHERE depth > 0"""


@query(_TRACE.format(at="effect_event_id", to="cause_event_id"))
def ca6_trace_causes(t):
    found = C.trace(t.causal_edges, t.causal_events.filter("event_id % 40 = 0"), 4, 0.02, True)
    return found.withColumn("strength", F.round("strength", 9))


@query(_TRACE.format(at="cause_event_id", to="effect_event_id"))
def ca7_project_effects(t):
    found = C.trace(t.causal_edges, t.causal_events.filter("event_id % 40 = 0"), 4, 0.02, False)
    return found.withColumn("strength", F.round("strength", 9))


@query("SELECT subject_id, count(DISTINCT event_id) AS events, count(DISTINCT edge_id) AS edges FROM causal_events LEFT JOIN causal_edges ON event_id = cause_event_id OR event_id = effect_event_id GROUP BY 1")
def ca8_entity_history(t):
    e = t.causal_edges
    ends = e.select("edge_id", F.col("cause_event_id").alias("event_id")).union(e.select("edge_id", "effect_event_id"))
    return t.causal_events.join(ends, "event_id", "left").groupBy("subject_id").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("edge_id").alias("edges"))


@query("SELECT predicate, transition_type, count(*) AS n FROM causal_events WHERE occurred_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05' GROUP BY 1, 2")
def ca9_delta(t):
    return t.causal_events.filter("occurred_at between timestamp '2024-01-02' and timestamp '2024-01-05'").groupBy("predicate", "transition_type").agg(F.count("*").alias("n"))


@query("SELECT f AS fact_id, edge_id FROM (SELECT edge_id, cause_event_id AS f, expired_at FROM causal_edges UNION ALL SELECT edge_id, effect_event_id, expired_at FROM causal_edges) x WHERE expired_at IS NULL AND f % 9 = 0")
def ca10_im4_citing(t):
    e = t.causal_edges.filter("expired_at is null")
    refs = e.select(F.col("cause_event_id").alias("fact_id"), "edge_id").union(e.select("effect_event_id", "edge_id"))
    return refs.join(t.causal_events.filter("event_id % 9 = 0").select("fact_id"), "fact_id", "left_semi")


_CHAINS = """WITH RECURSIVE c AS (SELECT [edge_id] AS edges, [cause_event_id, effect_event_id] AS evs, effect_event_id AS fin FROM causal_edges WHERE expired_at IS NULL AND created_at >= TIMESTAMP '2024-01-01'
UNION ALL SELECT list_append(c.edges, e.edge_id), list_append(c.evs, e.effect_event_id), e.effect_event_id FROM c JOIN causal_edges e ON e.cause_event_id = c.fin WHERE e.expired_at IS NULL AND len(c.edges) < 6 AND NOT list_contains(c.edges, e.edge_id)),
k AS MATERIALIZED (SELECT * FROM c WHERE len(edges) >= 2), v AS MATERIALIZED (SELECT event_id, concat(CASE WHEN right(subject_id, 1) = '7' THEN 'company' ELSE 'person' END, ':', CASE WHEN predicate IN ('click', 'view') THEN 'browse' ELSE predicate END) AS node FROM causal_events),
n AS MATERIALIZED (SELECT edges, string_agg(node, '>' ORDER BY i) AS template FROM (SELECT edges, unnest(evs) AS event_id, unnest(range(len(evs))) AS i FROM k) x JOIN v USING (event_id) GROUP BY 1),
p AS MATERIALIZED (SELECT template, count(*) AS instances FROM n GROUP BY 1 HAVING count(*) >= 3),
st AS MATERIALIZED (SELECT edge_id, template, i AS position FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY template, i) AS r FROM (SELECT template, unnest(edges) AS edge_id, unnest(range(len(edges))) AS i FROM n WHERE template IN (SELECT template FROM p)) q) y WHERE r = 1)
"""
CATEGORIES = {"click": "browse", "view": "browse"}


def _nodes(t):
    kinds = t.causal_events.select("subject_id").distinct().withColumn("entity_type", F.when(F.right("subject_id", F.lit(1)) == "7", "company").otherwise("person"))
    return C.event_nodes(t.causal_events, kinds, CATEGORIES)


def _named(t):
    return stash(C.named_chains(t.causal_edges, _nodes(t), F.lit("2024-01-01").cast("timestamp")))


@query(_CHAINS + "SELECT len(edges) AS size, count(*) AS n, min(edges[1]) AS lo FROM k GROUP BY 1")
def pt1_chains(t):
    found = C.chains(t.causal_edges, F.lit("2024-01-01").cast("timestamp"))
    return found.groupBy(F.size("edges").alias("size")).agg(F.count("*").alias("n"), F.min(F.element_at("edges", 1)).alias("lo"))


@query(_CHAINS + "SELECT template, instances FROM p")
def pt2_pt3_patterns(t):
    return C.patterns(_named(t))


@query(_CHAINS + ", h AS (SELECT template, CASE WHEN instances >= 40 THEN 'canonical' ELSE 'candidate' END AS status FROM p WHERE instances >= 20), g AS (SELECT template, avg(strength) AS s FROM (SELECT template, unnest(edges) AS edge_id FROM n WHERE template IN (SELECT template FROM p)) q JOIN causal_edges USING (edge_id) GROUP BY 1) SELECT template, instances, round(s, 6) AS avg_strength, coalesce(status, 'staging') AS status FROM p JOIN g USING (template) LEFT JOIN h USING (template)")
def pt3_agg10_upsert(t):
    """Known patterns, here those of twenty chains or more, keep their status and get new counts and averages."""
    named = _named(t)
    held = C.patterns(named, 20).withColumn("status", F.when(F.col("instances") >= 40, "canonical").otherwise("candidate"))
    return C.upsert_patterns(held, named, t.causal_edges).withColumn("avg_strength", F.round("avg_strength", 6))


@query(_CHAINS + "SELECT edge_id, template, position FROM st")
def pt3_win7_stamps(t):
    named = _named(t)
    return C.stamp_edges(named, C.patterns(named))


@query("""SELECT user_id, status, CASE WHEN status = 'staging' AND idle >= 14 THEN 'rejected' WHEN status = 'canonical' AND idle >= 30 THEN 'provisional' WHEN status = 'provisional' AND idle >= 30 THEN 'candidate'
WHEN status = 'staging' AND n >= 5 THEN 'candidate' WHEN status = 'candidate' AND n >= 10 AND act >= 3 THEN 'provisional' WHEN status = 'provisional' AND act >= 5 THEN 'canonical' ELSE status END AS next
FROM (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'candidate' WHEN 2 THEN 'provisional' ELSE 'canonical' END AS status, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS act, user_id % 40 AS idle FROM events GROUP BY 1) x""")
def pt4_lifecycle(t):
    status = F.element_at(F.array(*map(F.lit, ("staging", "candidate", "provisional", "canonical"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("instances"), F.count(F.when(F.col("event_type") == "error", 1)).alias("activations"))
    rows = rows.select("*", status.alias("status"), (F.col("user_id") % 40).alias("idle_days"), F.lit(20).alias("age_days"), F.lit(20).alias("dwell_days"))
    return C.promote(rows).select("user_id", "status", "next")


@query(_CHAINS + """, ok AS (SELECT template FROM p WHERE instances >= 20), wi AS (SELECT pair, template, position FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY template, position) AS r FROM (SELECT template, i - 1 AS position, concat(ns[i], '>', ns[i + 1]) AS pair FROM (SELECT template, string_split(template, '>') AS ns FROM ok) q, LATERAL (SELECT unnest(range(1, len(ns))) AS i) u) x) y WHERE r = 1)
SELECT edge_id, template, position FROM causal_edges JOIN v a ON a.event_id = cause_event_id JOIN v b ON b.event_id = effect_event_id JOIN wi ON pair = concat(a.node, '>', b.node) WHERE expired_at IS NULL""")
def pt5_join11_match_edges(t):
    """Edges against neighbouring nodes of the patterns with twenty chains or more."""
    return C.match_edges(t.causal_edges, _nodes(t), C.patterns(_named(t), 20))


@query(_CHAINS + """, g AS (SELECT subject_id AS entity, template, len(string_split(template, '>')) - 1 AS n, list(DISTINCT position) AS ps, avg(strength) AS s FROM st JOIN causal_edges USING (edge_id) JOIN causal_events ON event_id = cause_event_id WHERE expired_at IS NULL GROUP BY 1, 2),
h AS (SELECT entity, template, list_filter(range(n), lambda x: NOT list_contains(ps, x))[1] AS missing, s * (n - 1) / n AS confidence FROM g WHERE n > 1 AND len(ps) = n - 1)
SELECT entity, template, missing, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(confidence, 9) DESC, template) AS r FROM h) x WHERE r <= 10""")
def pt6_ghost_links(t):
    named = _named(t)
    kept = C.patterns(named)
    found = C.ghost_links(C.stamp_edges(named, kept), t.causal_edges, t.causal_events, kept)
    return found.withColumn("confidence", F.round("confidence", 6))


_OPEN = "fo AS MATERIALIZED (SELECT fact_id, subject_id, predicate, object_value AS v, confidence FROM facts WHERE predicate = 'has_status' AND expired_at IS NULL AND (invalid_at IS NULL OR right(fact_id, 1) = '3'))"


def _open_facts(t):
    """Facts of one predicate, those of a last digit 3 with their end taken away: several may hold at once."""
    return t.facts.withColumn("invalid_at", F.when(F.right("fact_id", F.lit(1)) != "3", F.col("invalid_at")))


@query(f"WITH {_OPEN} SELECT a.fact_id AS a, b.fact_id AS b, CASE WHEN greatest(a.confidence, b.confidence) >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM fo a JOIN fo b ON a.subject_id = b.subject_id AND a.fact_id < b.fact_id AND a.v <> b.v")
def ct1_opposing_objects(t):
    """``owns`` and the places are predicates that may hold many objects or are kept exclusive on arrival."""
    registry = t.spark.createDataFrame([("lives_in",), ("located_in",), ("part_of",), ("owns",)], "predicate string")
    return C.opposing_objects(_open_facts(t), registry)


@query("""SELECT DISTINCT event_id, CASE WHEN strength > 0.5 THEN 'high' ELSE 'low' END AS severity FROM events JOIN causal_edges ON event_id = cause_event_id WHERE event_type = 'error' AND expired_at IS NULL""")
def ct2_expired_but_cited(t):
    gone = t.events.filter("event_type = 'error'").select("event_id")
    cited = t.causal_edges.filter("expired_at is null").select(F.col("cause_event_id").alias("event_id"), F.when(F.col("strength") > 0.5, "high").otherwise("low").alias("severity"))
    return gone.join(cited, "event_id").distinct()


@query("SELECT x.edge_id AS a, x.edge_id + 1000000 AS b FROM causal_edges x WHERE expired_at IS NULL AND edge_id % 5 = 0")
def ct3_two_cycles(t):
    e = t.causal_edges.select("edge_id", "cause_event_id", "effect_event_id", "expired_at")
    back = e.filter("edge_id % 5 = 0").select((F.col("edge_id") + 1000000).alias("edge_id"), F.col("effect_event_id").alias("cause_event_id"), F.col("cause_event_id").alias("effect_event_id"), "expired_at")
    return C.two_cycles(e.unionByName(back))


@query("SELECT edge_id, round(epoch(b.occurred_at) - epoch(a.occurred_at), 3) AS inversion_s FROM causal_edges e JOIN causal_events a ON a.event_id = cause_event_id JOIN causal_events b ON b.event_id = effect_event_id WHERE e.expired_at IS NULL AND b.occurred_at > a.occurred_at")
def ct4_impossible_order(t):
    turned = t.causal_edges.select("edge_id", F.col("effect_event_id").alias("cause_event_id"), F.col("cause_event_id").alias("effect_event_id"), "expired_at")
    return C.impossible_order(turned, t.causal_events)


@query(f"""WITH {_OPEN}, f AS (SELECT 'opposing' AS kind, a.fact_id AS a, b.fact_id AS b FROM fo a JOIN fo b ON a.subject_id = b.subject_id AND a.fact_id < b.fact_id AND a.v <> b.v
UNION SELECT 'expired_cited', CAST(event_id AS VARCHAR), severity FROM (SELECT DISTINCT event_id, CASE WHEN strength > 0.5 THEN 'high' ELSE 'low' END AS severity FROM events JOIN causal_edges ON event_id = cause_event_id WHERE event_type = 'error' AND expired_at IS NULL) x
UNION SELECT 'cyclic', CAST(edge_id AS VARCHAR), CAST(edge_id + 1000000 AS VARCHAR) FROM causal_edges WHERE expired_at IS NULL AND edge_id % 5 = 0
UNION SELECT 'impossible', CAST(edge_id AS VARCHAR), CAST(edge_id AS VARCHAR) FROM causal_edges e JOIN causal_events a ON a.event_id = cause_event_id JOIN causal_events b ON b.event_id = effect_event_id WHERE e.expired_at IS NULL AND b.occurred_at > a.occurred_at
UNION SELECT 'succession', x.fact_id, x.nxt FROM (SELECT fact_id, lead(fact_id) OVER w AS nxt, object_value AS v, lead(object_value) OVER w AS nv FROM facts WHERE predicate = 'has_status' WINDOW w AS (PARTITION BY subject_id ORDER BY valid_at, created_at, fact_id)) x WHERE x.nxt IS NOT NULL AND v <> nv)
SELECT kind, count(*) AS n FROM f WHERE NOT (kind = 'opposing' AND right(a, 1) = '1') GROUP BY 1""")
def ct5_all_rules(t):
    """All rules in one table, without the pairs that are open already."""
    chain = BT.validity_chain(t.facts.filter("predicate = 'has_status'")).select("subject_id", "fact_id", "object_value", "valid_at", "created_at")
    order = Window.partitionBy("subject_id").orderBy("valid_at", "created_at", "fact_id")
    moved = chain.select(F.col("fact_id").alias("a"), F.lead("fact_id").over(order).alias("b"), "object_value", F.lead("object_value").over(order).alias("nv")).filter("b is not null and object_value <> nv")
    rules = {
        "opposing": ct1_opposing_objects(t),
        "expired_cited": ct2_expired_but_cited(t).select(F.col("event_id").alias("a"), F.col("severity").alias("b")),
        "cyclic": ct3_two_cycles(t),
        "impossible": ct4_impossible_order(t).select(F.col("edge_id").alias("a"), F.col("edge_id").alias("b")),
        "succession": moved,
    }
    held = ct1_opposing_objects(t).filter(F.right("a", F.lit(1)) == "1").select(F.lit("opposing").alias("kind"), "a", "b")
    return C.all_findings(rules, held).groupBy("kind").agg(F.count("*").alias("n"))


_DECIDED = """d AS (SELECT contradiction_id, fact_a, fact_b, resolved_at, CASE CAST(substr(contradiction_id, 3) AS BIGINT) % 6 WHEN 0 THEN 'expire_a' WHEN 1 THEN 'invalidate_b' WHEN 2 THEN 'expire_both' WHEN 3 THEN 'dismissed' WHEN 4 THEN 'both_valid' ELSE 'no such' END AS resolution, CASE WHEN right(contradiction_id, 1) = '2' THEN 'short' ELSE 'two statuses at the same time' END AS reason, CASE WHEN right(contradiction_id, 1) = '9' THEN ' ' ELSE 'false-positive' END AS tag FROM contradictions),
o AS (SELECT *, CASE WHEN resolution = 'no such' THEN 'unknown_resolution' WHEN length(reason) < 20 THEN 'short_reason' WHEN resolution = 'dismissed' AND trim(tag) = '' THEN 'no_tag' WHEN resolved_at IS NOT NULL THEN 'already_resolved' ELSE 'resolved' END AS outcome FROM d)"""


def _decisions(t):
    n = F.substring("contradiction_id", 3, 20).cast("long") % 6
    kind = F.when(n == 0, "expire_a").when(n == 1, "invalidate_b").when(n == 2, "expire_both").when(n == 3, "dismissed").when(n == 4, "both_valid").otherwise("no such")
    last = F.right("contradiction_id", F.lit(1))
    return t.contradictions.select("contradiction_id", kind.alias("resolution"), F.when(last == "2", "short").otherwise("two statuses at the same time").alias("reason"), F.when(last == "9", " ").otherwise("false-positive").alias("tag"), F.lit("2024-01-01").cast("timestamp").alias("at"))


@query(f"WITH {_DECIDED} SELECT contradiction_id, resolution, outcome FROM o")
def ct6_resolve_outcomes(t):
    return C.resolve_contradictions(t.contradictions, _decisions(t))[0]


@query(f"WITH {_DECIDED} SELECT contradiction_id, CASE resolution WHEN 'invalidate_b' THEN fact_b ELSE fact_a END AS target, CASE resolution WHEN 'invalidate_b' THEN 'invalidate' ELSE 'expire' END AS change FROM o WHERE outcome = 'resolved' AND resolution IN ('expire_a', 'invalidate_b', 'expire_both') UNION ALL SELECT contradiction_id, fact_b, 'expire' FROM o WHERE outcome = 'resolved' AND resolution = 'expire_both'")
def ct6_resolve_requests(t):
    return C.resolve_contradictions(t.contradictions, _decisions(t))[1]


@query("""WITH f AS (SELECT concat('x', contradiction_id) AS found_id, kind, least(fact_a, fact_b) AS a, greatest(fact_a, fact_b) AS b FROM contradictions WHERE confidence > 0.5), h AS (SELECT kind, least(fact_a, fact_b) AS a, greatest(fact_a, fact_b) AS b, min(contradiction_id) AS o FROM contradictions WHERE resolved_at IS NULL AND right(contradiction_id, 1) <> '4' GROUP BY 1, 2, 3), m AS (SELECT kind, a, b, min(found_id) AS f FROM f GROUP BY 1, 2, 3)
SELECT found_id, coalesce(o, m.f) AS contradiction_id, o IS NULL AND found_id = m.f AS is_new FROM f JOIN m USING (kind, a, b) LEFT JOIN h USING (kind, a, b)""")
def ct7_record(t):
    """Findings from outside: the open row of the same pair, or a new one."""
    c = t.contradictions
    found = c.filter("confidence > 0.5").select(F.concat(F.lit("x"), "contradiction_id").alias("found_id"), "kind", F.col("fact_b").alias("a"), F.col("fact_a").alias("b"))
    held = c.filter(F.right("contradiction_id", F.lit(1)) != "4").select("contradiction_id", "kind", F.col("fact_a").alias("a"), F.col("fact_b").alias("b"), "resolved_at")
    return C.record_contradictions(held, found)


@query("""WITH s AS MATERIALIZED (SELECT fact_id, subject_id, valid_at AS f, coalesce(invalid_at + INTERVAL 60 DAY, TIMESTAMP '9999-12-31') AS t, object_value AS v, concat(CASE WHEN fact_id LIKE '%1' THEN 'Status is ' ELSE 'status: ' END, object_value) AS o FROM facts WHERE predicate = 'has_status')
SELECT a.fact_id AS a, b.fact_id AS b, CASE WHEN lower(a.o) = lower(b.o) THEN 'same' WHEN a.v <> b.v THEN 'contradiction' ELSE 'needs_review' END AS verdict FROM s a JOIN s b ON a.subject_id = b.subject_id AND a.fact_id < b.fact_id AND a.f < b.t AND a.t > b.f""")
def ct8_pair_rules(t):
    """All pairs of statuses, each held 60 days beyond its end, that overlap; half of them say the slot in other words."""
    words = F.concat(F.when(F.col("fact_id").endswith("1"), "Status is ").otherwise("status: "), "object_value")
    f = stash(t.facts.filter("predicate = 'has_status'").select("subject_id", F.col("fact_id").alias("id"), words.alias("o"), micros(F.col("valid_at"), LOW).alias("from"), micros(F.expr("invalid_at + interval 60 days"), FAR).alias("to")))
    pairs = overlapping(f, f, ["subject_id"]).toDF("a", "b").filter("a < b")
    pairs = pairs.join(f.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(f.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    pairs = pairs.withColumns({"pa": F.lit("has_status"), "pb": F.lit("has status"), "overlaps": F.lit(True)})
    return pairs.select("a", "b", C.classify_pair(["owns"], ["lives_in"]).alias("verdict"))


_REACH = """WITH RECURSIVE r AS (SELECT event_id AS root FROM causal_events WHERE event_id % 100 = 0), w AS (SELECT root, edge_id, cause_event_id AS c, effect_event_id AS f, 1 AS depth FROM causal_edges JOIN r ON cause_event_id = root OR effect_event_id = root WHERE expired_at IS NULL
UNION ALL SELECT w.root, e.edge_id, e.cause_event_id, e.effect_event_id, w.depth + 1 FROM w JOIN causal_edges e ON e.cause_event_id = w.f OR e.effect_event_id = w.c WHERE e.expired_at IS NULL AND w.depth < 3)
"""


def _roots(t):
    return t.causal_events.filter("event_id % 100 = 0").select(F.col("event_id").alias("root"), "event_id")


@query(_REACH + "SELECT root, edge_id, min(depth) AS depth FROM w GROUP BY 1, 2")
def im3_join8_transitive(t):
    return C.reach(t.causal_edges, _roots(t), 3)


@query("SELECT a.fact_id AS root, count(DISTINCT b.fact_id) AS dependents FROM facts a JOIN facts b ON a.fact_id <> b.fact_id AND (b.subject_id = a.subject_id OR b.object_id = a.subject_id) WHERE a.predicate = 'located_in' AND b.expired_at IS NULL GROUP BY 1")
def im1_im2_direct_dependents(t):
    roots = t.facts.filter("predicate = 'located_in'").select(F.col("fact_id").alias("root"), F.col("subject_id").alias("e"))
    f = BT.active(t.facts)
    ends = f.select(F.col("subject_id").alias("e"), "fact_id").union(f.filter("object_id is not null").select("object_id", "fact_id"))
    return roots.join(ends, "e").filter("root <> fact_id").groupBy("root").agg(F.count_distinct("fact_id").alias("dependents"))


@query(_CHAINS + """, ro AS (SELECT event_id AS root FROM causal_events WHERE event_id % 100 = 0), al AS (SELECT template, count(*) AS n FROM st GROUP BY 1), to_ AS (SELECT root, template, count(DISTINCT edge_id) AS touching FROM ro JOIN causal_edges ON cause_event_id = root OR effect_event_id = root JOIN st USING (edge_id) GROUP BY 1, 2)
SELECT root, template, touching, n - touching AS outside, len(string_split(template, '>')) - 1 AS need FROM to_ JOIN al USING (template)""")
def im5_pattern_impact(t):
    named = _named(t)
    kept = stash(C.patterns(named))
    return C.pattern_impact(C.stamp_edges(named, kept), t.causal_edges, _roots(t), kept)


@query(_REACH + """, d AS (SELECT root, edge_id, min(depth) AS depth FROM w GROUP BY 1, 2), oc AS (SELECT effect_event_id AS f, count(*) AS n FROM causal_edges WHERE expired_at IS NULL GROUP BY 1),
tr AS (SELECT root, CASE WHEN depth = 1 THEN CASE WHEN k = 0 THEN 'high' WHEN k <= 2 THEN 'medium' ELSE 'low' END WHEN depth = 2 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT d.root, d.depth, oc.n - (e.cause_event_id = d.root)::INT AS k FROM d JOIN causal_edges e USING (edge_id) JOIN oc ON oc.f = e.effect_event_id) x),
ci AS (SELECT root, CASE WHEN e.edge_id % 2 = 1 THEN CASE WHEN corroboration_count >= 3 THEN 'critical' ELSE 'high' END WHEN strength >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM r JOIN causal_edges e ON cause_event_id = root WHERE e.expired_at IS NULL),
al AS (SELECT * FROM tr UNION ALL SELECT * FROM ci)
SELECT root, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM al GROUP BY 1""")
def im6_im7_agg18_severity(t):
    """Transitive edges and citations of every root; an edge of an odd number cites its cause alone."""
    e, roots = t.causal_edges, _roots(t)
    causes = e.filter("expired_at is null").groupBy("effect_event_id").agg(F.count("*").alias("all_causes"))
    near = C.reach(e, roots, 3).join(e.select("edge_id", "cause_event_id", "effect_event_id"), "edge_id").join(causes, "effect_event_id")
    none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
    moved = near.select("root", F.lit("transitive").alias("relationship"), "depth", (F.col("all_causes") - (F.col("cause_event_id") == F.col("root")).cast("int")).alias("other_causes")).withColumns(none("double", "strength") | none("long", "corroboration_count", "other_sources"))
    cited = e.filter("expired_at is null").join(roots.select("root", F.col("event_id").alias("cause_event_id")), "cause_event_id")
    cited = cited.select("root", F.lit("citation").alias("relationship"), "strength", F.col("corroboration_count").cast("long").alias("corroboration_count"), F.when(F.col("edge_id") % 2 == 1, 0).otherwise(1).cast("long").alias("other_sources")).withColumns(none("int", "depth") | none("long", "other_causes"))
    nodes = moved.unionByName(cited).withColumns(none("long", "outside", "need") | {"node_type": F.lit("causal_edge")})
    return nodes.withColumn("severity", C.impact_severity()).groupBy("root").pivot("severity", ["critical", "high", "medium", "low"]).count().na.fill(0)


@query(_CHAINS + "SELECT template, edge_id, position, row_number() OVER (PARTITION BY template, position ORDER BY edge_id) AS nth FROM st")
def flt23_instances_in_order(t):
    """The edges of every pattern by their place in it."""
    named = _named(t)
    nth = F.row_number().over(Window.partitionBy("template", "position").orderBy("edge_id"))
    return C.stamp_edges(named, C.patterns(named)).withColumn("nth", nth)
