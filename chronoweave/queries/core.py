"""Scans, keyed reads, joins, aggregates, windows, pages, set operations, scalar functions and bi-temporal changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import tables as TB
from chronoweave.operators import temporal as BT
from chronoweave.operators.graph import entity_edges
from chronoweave.operators.blocks import bridges
from chronoweave.registry import query

T0 = "1998-01-01 00:00:00"


def _at(text=T0):
    return F.lit(text).cast("timestamp")


@query("""SELECT predicate, count(*) AS n, count(e.canonical_name) AS named, round(sum(confidence), 4) AS conf FROM facts LEFT JOIN entities e ON e.entity_id = subject_id
WHERE created_at <= TIMESTAMP '1998-01-01' AND (expired_at IS NULL OR expired_at > TIMESTAMP '1998-01-01')
AND (valid_at IS NULL OR valid_at <= TIMESTAMP '1998-01-01') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-01-01') GROUP BY predicate""")
def bt1_facts_at_time(t):
    found = BT.facts_at_time(t.facts, _at()).join(t.entities.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left")
    return found.groupBy("predicate").agg(F.count("*").alias("n"), F.count("canonical_name").alias("named"), F.round(F.sum("confidence"), 4).alias("conf"))


@query("""SELECT year(moment) AS yr, predicate, count(*) AS n FROM facts JOIN (SELECT unnest([TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01', TIMESTAMP '1997-01-01']) AS moment) a
ON created_at <= moment AND (expired_at IS NULL OR expired_at > moment) AND (valid_at IS NULL OR valid_at <= moment) AND (invalid_at IS NULL OR invalid_at > moment) GROUP BY ALL""")
def join14_facts_at_times(t):
    times = t.spark.createDataFrame([("1995-01-01",), ("1996-01-01",), ("1997-01-01",)], "at string").select(F.col("at").cast("timestamp").alias("at"))
    return BT.facts_at_times(t.facts, times).groupBy(F.year("at").cast("long").alias("yr"), "predicate").agg(F.count("*").alias("n"))


@query("SELECT fact_id, subject_id, object_id, confidence FROM facts WHERE expired_at IS NULL AND predicate = 'lives_in'")
def src1_active_scan(t):
    return BT.active(t.facts).filter("predicate = 'lives_in'").select("fact_id", "subject_id", "object_id", "confidence")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def src2_lookup(t):
    keys = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("vec_id"))
    return TB.lookup(t.embeddings.select("vec_id", "label"), keys, "vec_id")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) x WHERE r = 1")
def src3_upsert_latest(t):
    return TB.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT d.doc_id, d.lang, coalesce(CASE WHEN l.quality = 0 THEN 'low' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def src4_patch(t):
    changes = t.labels.select("doc_id", F.when(F.col("quality") == 0, "low").alias("source"))
    return TB.patch(t.documents.select("doc_id", "lang", "source"), changes, "doc_id")


@query("SELECT o_custkey AS k, 'order' AS origin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey % 2 = 0")
def src5_insert_absent(t):
    held = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return TB.insert_absent(held, t.orders.select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin")), ["k"])


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS m FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT k, coalesce(n, 0) + coalesce(m, 0) AS n, CASE WHEN n IS NULL THEN 'inserted' WHEN m IS NULL THEN 'kept' ELSE 'refreshed' END AS outcome FROM a FULL JOIN b USING (k)""")
def src6_src7_upsert_counts(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("k"), "l_shipdate", F.lit(1).cast("long").alias("n"))
    old = rows.filter("l_shipdate < '1996-01-01'").groupBy("k").agg(F.sum("n").alias("n"))
    return TB.upsert_counts(old, rows.filter("l_shipdate >= '1998-06-01'"), "k", "n")


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN expired_at IS NULL THEN 'created' ELSE 'expired' END AS event_type, CASE WHEN confidence > 0.95 THEN predicate ELSE ' ' END AS reasoning FROM facts) x WHERE length(trim(reasoning)) > 0 GROUP BY 1")
def src8_checked_history(t):
    history = t.facts.select(F.when(F.col("expired_at").isNull(), "created").otherwise("expired").alias("event_type"), F.when(F.col("confidence") > 0.95, F.col("predicate")).otherwise(" ").alias("reasoning"))
    return TB.checked_history(history).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT fact_id, 'created' AS event_type FROM facts WHERE expired_at IS NOT NULL")
def src9_history_gaps(t):
    history = t.facts.select("fact_id", F.when(F.col("expired_at").isNull(), "created").otherwise("expired").alias("event_type"))
    return TB.history_gaps(t.facts, history, "fact_id")


@query("""SELECT edge_id, 'fact' AS ref_type, CAST(cause_event_id AS VARCHAR) AS ref_id FROM causal_edges UNION ALL SELECT edge_id, 'memory', CAST(effect_event_id AS VARCHAR) FROM causal_edges WHERE edge_id % 2 = 0""")
def src10_explode_refs(t):
    ref = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("id"))
    refs = F.to_json(F.when(F.col("edge_id") % 2 == 0, F.array(ref("fact", "cause_event_id"), ref("memory", "effect_event_id"), ref("note", "edge_id"))).otherwise(F.array(ref("fact", "cause_event_id"), ref("fact", "cause_event_id"))))
    return TB.explode_refs(t.causal_edges.select("edge_id", refs.alias("refs")), "edge_id", "refs", ["fact", "memory"])


@query("SELECT DISTINCT memory_id, entity_id, memory_id % 2 = 0 AS held FROM memory_entities")
def src11_provenance_backfill(t):
    """Links that the one-to-many table lacks are added from the single ones; those there stay as they are."""
    single = t.embeddings.select(F.col("vec_id").alias("memory_id")).join(t.memory_entities, "memory_id").withColumn("held", F.lit(False))
    there = t.memory_entities.filter("memory_id % 2 = 0").distinct().withColumn("held", F.lit(True))
    return TB.insert_absent(there, single.select("memory_id", "entity_id", "held"), ["memory_id", "entity_id"])


@query("""WITH n AS (SELECT 'entity' AS kind, entity_id AS id FROM entities UNION SELECT 'memory', concat('m', vec_id) FROM embeddings UNION SELECT 'event', concat('e', event_id) FROM causal_events UNION SELECT 'user', subject_id FROM causal_events),
x AS (SELECT 'fact' AS kind, subject_id AS s, object_id AS d FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL UNION ALL SELECT 'mention', concat('m', memory_id), entity_id FROM memory_entities UNION ALL SELECT 'causes', concat('e', cause_event_id), concat('e', effect_event_id) FROM causal_edges WHERE expired_at IS NULL UNION ALL SELECT 'of_event', concat('e', event_id), subject_id FROM causal_events
UNION ALL SELECT 'speaks', entity_id, concat('m', stream_id) FROM participants UNION ALL SELECT 'alias', entity_id, entity_id FROM aliases)
SELECT kind, count(*) AS n FROM x WHERE s IN (SELECT id FROM n) AND d IN (SELECT id FROM n) GROUP BY 1 UNION ALL SELECT concat('node ', kind), count(*) FROM n GROUP BY 1""")
def src14_unified_export(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.causal_events
    nodes = {"entity": t.entities.select(F.col("entity_id").alias("id")), "memory": t.embeddings.select(name("m", "vec_id").alias("id")), "event": e.select(name("e", "event_id").alias("id")), "user": e.select(F.col("subject_id").alias("id"))}
    edges = {
        "fact": BT.active(t.facts).filter("object_id is not null").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")),
        "mention": t.memory_entities.select(name("m", "memory_id").alias("src"), F.col("entity_id").alias("dst")),
        "causes": t.causal_edges.filter("expired_at is null").select(name("e", "cause_event_id").alias("src"), name("e", "effect_event_id").alias("dst")),
        "of_event": e.select(name("e", "event_id").alias("src"), F.col("subject_id").alias("dst")),
        "speaks": t.participants.select(F.col("entity_id").alias("src"), name("m", "stream_id").alias("dst")),
        "alias": t.aliases.select(F.col("entity_id").alias("src"), F.col("entity_id").alias("dst")),
    }
    all_nodes, all_edges = TB.unified_export(nodes, edges)
    count = lambda f, k: f.groupBy(k.alias("kind")).agg(F.count("*").alias("n"))
    return count(all_edges, F.col("kind")).unionByName(count(all_nodes, F.concat(F.lit("node "), "kind")))


@query("SELECT subject_id, fact_id, valid_at FROM facts WHERE expired_at IS NULL AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-01-01') AND predicate = 'has_status'")
def flt2_current_facts(t):
    return BT.current_facts(t.facts, _at()).filter("predicate = 'has_status'").select("subject_id", "fact_id", "valid_at")


@query("SELECT DISTINCT e.entity_id, fact_id FROM entities e JOIN facts f ON e.entity_id = f.subject_id OR e.entity_id = f.object_id WHERE e.entity_type = 'company'")
def flt3_facts_touching(t):
    f = t.facts.select("fact_id", "subject_id", "object_id")
    ends = f.select(F.col("subject_id").alias("entity_id"), "fact_id").union(f.filter("object_id is not null").select("object_id", "fact_id"))
    return ends.join(t.entities.filter("entity_type = 'company'").select("entity_id"), "entity_id", "left_semi").distinct()


@query("""SELECT fact_id, s.canonical_name AS subject_name, o.canonical_name AS object_name FROM facts LEFT JOIN entities s ON s.entity_id = subject_id LEFT JOIN entities o ON o.entity_id = object_id WHERE predicate IN ('lives_in', 'part_of')""")
def flt4_fact_names(t):
    e = t.entities
    f = t.facts.filter("predicate in ('lives_in', 'part_of')")
    s = e.select(F.col("entity_id").alias("subject_id"), F.col("canonical_name").alias("subject_name"))
    o = e.select(F.col("entity_id").alias("object_id"), F.col("canonical_name").alias("object_name"))
    return f.join(s, "subject_id", "left").join(o, "object_id", "left").select("fact_id", "subject_name", "object_name")


@query("SELECT subject_id, fact_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, fact_id) r FROM facts WHERE predicate = 'owns') x WHERE r <= 3")
def flt5_flt19_newest_per_key(t):
    r = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("created_at"), "fact_id"))
    return t.facts.filter("predicate = 'owns'").withColumn("rank", r).filter("rank <= 3").select("subject_id", "fact_id", "rank")


@query("SELECT memory_id, string_agg(entity_id, ',' ORDER BY entity_id) AS entities FROM memory_entities GROUP BY 1")
def flt6_memory_entities(t):
    return t.memory_entities.groupBy("memory_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("entity_id"))).alias("entities"))


@query("SELECT entity_id, memory_id FROM (SELECT entity_id, memory_id, row_number() OVER (PARTITION BY entity_id ORDER BY memory_id DESC) r FROM (SELECT DISTINCT entity_id, memory_id FROM memory_entities) y) x WHERE r <= 5")
def flt7_latest_memories(t):
    r = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("memory_id")))
    return t.memory_entities.distinct().withColumn("r", r).filter("r <= 5").select("entity_id", "memory_id")


@query("SELECT entity_id, doc_id, substr(text, 1, 300) AS preview FROM (SELECT m.entity_id, d.doc_id, d.text, row_number() OVER (PARTITION BY m.entity_id ORDER BY d.doc_id) r FROM memory_entities m JOIN documents d ON d.doc_id = m.memory_id) x WHERE r <= 10")
def flt8_flt9_previews(t):
    r = F.row_number().over(Window.partitionBy("entity_id").orderBy("doc_id"))
    met = t.memory_entities.join(t.documents.withColumnRenamed("doc_id", "memory_id"), "memory_id").withColumnRenamed("memory_id", "doc_id")
    return met.withColumn("r", r).filter("r <= 10").select("entity_id", "doc_id", F.substring("text", 1, 300).alias("preview"))


CATEGORIES = {"lives_in": "Location", "located_in": "Location", "part_of": "Structure", "owns": "Relations"}


@query("SELECT CASE predicate WHEN 'lives_in' THEN 'Location' WHEN 'located_in' THEN 'Location' WHEN 'part_of' THEN 'Structure' WHEN 'owns' THEN 'Relations' ELSE 'Other' END AS category, count(*) AS n FROM facts GROUP BY 1")
def flt11_categories(t):
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return t.facts.groupBy(F.coalesce(F.element_at(table, F.col("predicate")), F.lit("Other")).alias("category")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT entity_id, count(DISTINCT memory_id) AS memories FROM memory_entities GROUP BY 1), s AS (SELECT subject_id AS entity_id, count(*) AS as_subject FROM facts WHERE expired_at IS NULL GROUP BY 1), o AS (SELECT object_id AS entity_id, count(*) AS as_object FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL GROUP BY 1)
SELECT e.entity_id, e.entity_type, coalesce(as_subject, 0) AS as_subject, coalesce(as_object, 0) AS as_object, coalesce(memories, 0) AS memories FROM entities e LEFT JOIN m USING (entity_id) LEFT JOIN s USING (entity_id) LEFT JOIN o USING (entity_id)""")
def flt10_flt13_profiles(t):
    a = BT.active(t.facts)
    s = a.groupBy(F.col("subject_id").alias("entity_id")).agg(F.count("*").alias("as_subject"))
    o = a.filter("object_id is not null").groupBy(F.col("object_id").alias("entity_id")).agg(F.count("*").alias("as_object"))
    m = t.memory_entities.groupBy("entity_id").agg(F.count_distinct("memory_id").alias("memories"))
    met = t.entities.join(m, "entity_id", "left").join(s, "entity_id", "left").join(o, "entity_id", "left")
    return met.select("entity_id", "entity_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("as_subject", "as_object", "memories")])


@query("SELECT e.entity_id FROM entities e WHERE e.entity_id NOT IN (SELECT subject_id FROM facts) AND e.entity_id NOT IN (SELECT object_id FROM facts WHERE object_id IS NOT NULL) AND e.entity_id NOT IN (SELECT entity_id FROM memory_entities)")
def join3_flt14_orphans(t):
    ends = t.facts.select(F.col("subject_id").alias("entity_id")).union(t.facts.filter("object_id is not null").select("object_id")).union(t.memory_entities.select("entity_id"))
    return t.entities.select("entity_id").join(ends, "entity_id", "left_anti")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 2, 3, 4, 5, 6, 7) ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 5")
def flt15_top3_page(t):
    return TB.page(t.supplier.filter(F.col("s_nationkey").isin(1, 2, 3, 4, 5, 6, 7)).select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.col("s_suppkey")], 10, 5)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90")
def fn18_flt20_json(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k")).filter("k > 90")


@query("SELECT entity_id, canonical_name FROM entities WHERE entity_type IN ('place', 'company') AND canonical_name ILIKE '%an%'")
def fn2_flt25_types_like(t):
    return t.entities.filter(F.col("entity_type").isin("place", "company") & F.col("canonical_name").ilike("%an%")).select("entity_id", "canonical_name")


@query("""SELECT a.fact_id AS a, b.fact_id AS b FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.fact_id < b.fact_id AND a.object_value <> b.object_value WHERE a.predicate = 'has_status' AND a.expired_at IS NULL AND b.expired_at IS NULL AND a.invalid_at IS NULL AND b.invalid_at IS NOT NULL""")
def join5_theta_self_join(t):
    f = BT.active(t.facts).filter("predicate = 'has_status'")
    a = f.filter("invalid_at is null").select("subject_id", F.col("fact_id").alias("a"), F.col("object_value").alias("va"))
    b = f.filter("invalid_at is not null").select("subject_id", F.col("fact_id").alias("b"), F.col("object_value").alias("vb"))
    return a.join(b, "subject_id").filter("a < b and va <> vb").select("a", "b")


@query("""WITH o AS MATERIALIZED (SELECT fact_id, subject_id, coalesce(valid_at, TIMESTAMP '0001-01-01') AS f, coalesce(invalid_at, TIMESTAMP '9999-12-31') AS t FROM facts WHERE predicate = 'has_status' AND expired_at IS NULL), n AS MATERIALIZED (SELECT fact_id AS new_id, subject_id, valid_at AS nf FROM facts WHERE predicate = 'has_status' AND CAST(substr(fact_id, 3) AS INTEGER) % 10 = 0)
SELECT new_id, fact_id FROM o JOIN n USING (subject_id) WHERE fact_id <> new_id AND t > nf""")
def bt2_join6_superseding(t):
    f = t.facts.filter("predicate = 'has_status'")
    new = f.filter("cast(substring(fact_id, 3) as int) % 10 = 0").withColumn("invalid_at", F.lit(None).cast("timestamp"))  # open-ended
    return BT.superseded_by(f, new)


@query("SELECT fact_id, lead(valid_at) OVER (PARTITION BY subject_id, predicate ORDER BY valid_at, created_at, fact_id) AS next_valid_at FROM facts WHERE predicate = 'has_status'")
def win4_validity_chain(t):
    return BT.validity_chain(t.facts.filter("predicate = 'has_status'")).select("fact_id", "next_valid_at")


_ASKED = """fx AS MATERIALIZED (SELECT * FROM facts WHERE predicate IN ('has_status', 'owns')), ex AS MATERIALIZED (SELECT * FROM fx WHERE NOT (predicate = 'has_status' AND right(fact_id, 1) IN ('1', '4', '7'))),
rq AS MATERIALIZED (SELECT * FROM fx WHERE predicate = 'has_status' AND right(fact_id, 1) IN ('1', '4', '7') UNION ALL SELECT concat(fact_id, 'r'), subject_id, predicate, object_id, object_value, valid_at, invalid_at, created_at, NULL, least(1.0, confidence + 0.02) FROM fx WHERE predicate = 'owns' AND right(fact_id, 1) = '1'),
ak AS MATERIALIZED (SELECT subject_id, predicate, object_id, object_value, arg_min(fact_id, (created_at, fact_id)) AS fact_id, arg_min(created_at, (created_at, fact_id)) AS created_at, arg_min(valid_at, (created_at, fact_id)) AS valid_at, arg_min(invalid_at, (created_at, fact_id)) AS invalid_at, arg_min(expired_at, (created_at, fact_id)) AS expired_at, max(confidence) AS most FROM rq GROUP BY 1, 2, 3, 4),
ac AS (SELECT * FROM ex WHERE expired_at IS NULL), he AS MATERIALIZED (SELECT ac.fact_id, ac.confidence AS was, max(ak.most) AS most FROM ac JOIN ak ON ak.subject_id = ac.subject_id AND ak.predicate = ac.predicate AND ak.object_id IS NOT DISTINCT FROM ac.object_id AND ak.object_value IS NOT DISTINCT FROM ac.object_value GROUP BY 1, 2),
ne AS MATERIALIZED (SELECT * FROM ak WHERE NOT EXISTS (SELECT 1 FROM ac WHERE ak.subject_id = ac.subject_id AND ak.predicate = ac.predicate AND ak.object_id IS NOT DISTINCT FROM ac.object_id AND ak.object_value IS NOT DISTINCT FROM ac.object_value)),
sn AS (SELECT fact_id, subject_id, predicate, object_value, valid_at, invalid_at, created_at FROM ac UNION ALL SELECT fact_id, subject_id, predicate, object_value, valid_at, invalid_at, created_at FROM ne WHERE expired_at IS NULL),
go AS (SELECT DISTINCT s.fact_id FROM sn s JOIN rq q ON q.subject_id = s.subject_id AND q.predicate = s.predicate WHERE s.predicate = 'has_status' AND q.object_value <> s.object_value AND (q.created_at, q.fact_id) > (s.created_at, s.fact_id) AND s.valid_at < coalesce(q.invalid_at, TIMESTAMP '9999-12-31') AND coalesce(s.invalid_at, TIMESTAMP '9999-12-31') > q.valid_at),
hi AS (SELECT fact_id, CASE WHEN most > was THEN 'confidence_raised' ELSE 'revised' END AS event_type FROM he UNION ALL SELECT fact_id, 'created' FROM ne UNION ALL SELECT fact_id, 'superseded' FROM go)"""


def _asked(t):
    f = t.facts.filter("predicate in ('has_status', 'owns')")
    last = F.right("fact_id", F.lit(1))
    late = (F.col("predicate") == "has_status") & last.isin("1", "4", "7")
    again = f.filter((F.col("predicate") == "owns") & (last == "1")).withColumns({"fact_id": F.concat("fact_id", F.lit("r")), "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.02)})
    registry = t.spark.createDataFrame([("has_status", True), ("owns", False)], "predicate string, is_exclusive boolean")
    return f.filter(~late), f.filter(late).unionByName(again), registry


@query(f"WITH {_ASKED} SELECT fact_id, event_type FROM hi")
def bt3_create_facts(t):
    """Statuses that arrive late, and repeated ownerships, against the facts that are there."""
    return BT.create_facts(*_asked(t))[1]


@query(f"WITH {_ASKED} SELECT event_type, count(*) AS n FROM hi GROUP BY 1")
def bt4_corroboration_event(t):
    return BT.create_facts(*_asked(t))[1].groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT concat('fp', l_suppkey, '_', l_partkey) AS fact_id, l_orderkey AS source_id, l_shipdate AS at_ FROM lineitem), a AS (SELECT fact_id, source_id, count(*) AS n, min(at_) AS lo, max(at_) AS hi FROM o WHERE at_ < TIMESTAMP '1996-01-01' GROUP BY 1, 2), b AS (SELECT fact_id, source_id, count(*) AS n, min(at_) AS lo, max(at_) AS hi FROM o WHERE at_ >= TIMESTAMP '1995-06-01' GROUP BY 1, 2)
SELECT fact_id, source_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS observed, coalesce(a.lo, b.lo) AS first_at, greatest(a.hi, b.hi) AS last_at FROM a FULL JOIN b USING (fact_id, source_id)""")
def bt5_source_observations(t):
    seen = t.lineitem.select(F.concat(F.lit("fp"), F.col("l_suppkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("fact_id"), F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("observed_at"))
    held = seen.filter("observed_at < '1996-01-01'").groupBy("fact_id", "source_id").agg(F.count("*").alias("observed"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    return BT.source_observations(held, seen.filter("observed_at >= '1995-06-01'"))


@query("SELECT fact_id, predicate IN ('lives_in', 'located_in', 'part_of') AS is_bridge FROM facts WHERE expired_at IS NULL AND right(fact_id, 1) = '1'")
def bt10_bridge_warnings(t):
    """Facts about to expire against the bridges of the places, where every edge is one."""
    places = entity_edges(t.facts.filter("predicate in ('lives_in', 'located_in', 'part_of')"))
    return BT.bridge_warnings(BT.active(t.facts).filter(F.right("fact_id", F.lit(1)) == "1"), bridges(places))


def _requests(t):
    return t.orders.filter("o_orderkey % 4 = 0").select(F.concat(F.lit("fo"), F.col("o_orderkey").cast("string")).alias("fact_id"), _at("1999-01-01").alias("at"), F.lit("cleanup").alias("reason"))


@query("SELECT concat('fo', CAST(o_orderkey AS VARCHAR)) AS fact_id, 'expired' AS event_type, 'cleanup' AS reasoning, TIMESTAMP '1999-01-01' AS occurred_at FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 10 <> 0")
def bt6_expire(t):
    return BT.expire(t.facts, _requests(t))[1]


@query("SELECT predicate, count(*) AS n, count(invalid_at) AS ended FROM (SELECT predicate, CASE WHEN predicate = 'has_status' AND CAST(substr(fact_id, 3) AS INTEGER) % 4 = 0 THEN coalesce(invalid_at, TIMESTAMP '1999-01-01') ELSE invalid_at END AS invalid_at FROM (SELECT * FROM facts WHERE predicate = 'has_status') y) x GROUP BY 1")
def bt7_invalidate(t):
    state, _ = BT.invalidate(t.facts.filter("predicate = 'has_status'"), _requests(t))
    return state.groupBy("predicate").agg(F.count("*").alias("n"), F.count("invalid_at").alias("ended"))


@query("SELECT fact_id, CASE WHEN 0.95 > confidence THEN 'confidence_raised' ELSE 'confidence_lowered' END AS event_type, confidence AS previous, CAST(0.95 AS DOUBLE) AS new FROM facts WHERE predicate IN ('has_status', 'owns') AND confidence <> 0.95")
def bt8_change_confidence(t):
    f = t.facts.filter("predicate in ('has_status', 'owns')")
    return BT.change_confidence(f, f.select("fact_id", F.lit(0.95).alias("confidence")))[1]


@query("SELECT count(*) AS n, count(expired_at) AS expired, count(invalid_at) AS ended FROM (SELECT CASE WHEN predicate = 'has_status' THEN NULL ELSE expired_at END AS expired_at, CASE WHEN predicate = 'has_status' THEN NULL ELSE invalid_at END AS invalid_at FROM facts) x")
def bt9_restore(t):
    state, _ = BT.restore(t.facts, t.facts.filter("predicate = 'has_status'"))
    return state.agg(F.count("*").alias("n"), F.count("expired_at").alias("expired"), F.count("invalid_at").alias("ended"))


@query("""SELECT fact_id, CASE WHEN predicate = 'owns' THEN CASE WHEN 0.95 > confidence THEN 'strengthened' ELSE 'weakened' END ELSE 'expired' END AS transition_type, round(CASE WHEN predicate = 'owns' THEN 0.95 - confidence ELSE -confidence END, 9) AS delta_confidence FROM facts
WHERE (predicate = 'owns' AND confidence <> 0.95) OR (predicate = 'has_status' AND expired_at IS NULL AND CAST(substr(fact_id, 3) AS BIGINT) % 4 = 0)""")
def bt11_transition_log(t):
    f = t.facts.filter("predicate in ('has_status', 'owns')")
    after = BT.change_confidence(f, f.filter("predicate = 'owns'").select("fact_id", F.lit(0.95).alias("confidence")))[0]
    log = BT.transition_log(f, BT.expire(after, _requests(t))[0])
    return log.withColumn("delta_confidence", F.round("delta_confidence", 9))


@query("""SELECT request_id, key, CASE WHEN length(text) > 20 THEN 'too_long' WHEN e <> c_mktsegment THEN 'stale_write' WHEN row_number() OVER (PARTITION BY key, length(text) > 20 OR e <> c_mktsegment ORDER BY moment, request_id) = 1 THEN 'accepted' ELSE 'superseded' END AS outcome
FROM (SELECT o_orderkey AS request_id, o_custkey AS key, CASE WHEN o_orderstatus = 'P' THEN repeat('x', 30) ELSE 'ok' END AS text, CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE c_mktsegment END AS e, o_orderdate AS moment, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey) q""")
def bt12_optimistic_write(t):
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("updated_at"))
    o = t.orders.join(rows.withColumnRenamed("key", "o_custkey"), "o_custkey")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "x" * 30).otherwise("ok").alias("text"), F.when(F.col("o_orderstatus") == "O", "none").otherwise(F.col("updated_at")).alias("expected"), F.col("o_orderdate").alias("at"))
    return BT.optimistic_write(rows, asked, 20)


@query("SELECT entity_id, max(created_at) AS last_reasoned_at FROM (SELECT *, row_number() OVER (PARTITION BY invocation_id ORDER BY created_at, report_id) AS r FROM reports) x WHERE r = 1 GROUP BY 1")
def bt13_report_save(t):
    """The first report of an invocation is kept, and its entity counts as reasoned about."""
    saved = TB.latest(t.reports, ["invocation_id"], F.col("created_at"), F.col("report_id"))
    return saved.groupBy("entity_id").agg(F.max("created_at").alias("last_reasoned_at"))


@query("SELECT CASE WHEN expired_at IS NULL AND predicate = 'owns' THEN 'possesses' ELSE predicate END AS predicate, count(*) AS n FROM facts GROUP BY 1")
def bt14_canonicalise(t):
    alias = t.spark.createDataFrame([("owns", "possesses")], "predicate string, canonical string")
    met = t.facts.join(F.broadcast(alias), "predicate", "left")
    name = F.when(F.col("expired_at").isNull(), F.coalesce("canonical", "predicate")).otherwise(F.col("predicate"))
    return met.groupBy(name.alias("predicate")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, o_orderstatus AS status, 'F' AS \"to\" FROM orders WHERE o_orderstatus = 'F'")
def bt15_state_machine(t):
    rows = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    allowed = t.spark.createDataFrame([("O", "F"), ("P", "F")], "status string, to string")
    return BT.transition(rows, rows.select("key", F.lit("F").alias("to")), allowed)[1]


@query("SELECT count(*) AS facts, count(DISTINCT subject_id) AS subjects, count(DISTINCT predicate) AS predicates, count(DISTINCT object_id) AS objects FROM facts WHERE expired_at IS NULL")
def agg1_agg6_counts(t):
    return BT.active(t.facts).agg(F.count("*").alias("facts"), *[F.count_distinct(c).alias(n) for c, n in (("subject_id", "subjects"), ("predicate", "predicates"), ("object_id", "objects"))])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def agg2_percentiles(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), *[F.round(F.percentile("value", p), 6).alias(n) for p, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))])


@query("""WITH a AS MATERIALIZED (SELECT * FROM facts WHERE expired_at IS NULL), d AS MATERIALIZED (SELECT e.entity_id, count(x.v) AS n FROM entities e LEFT JOIN (SELECT subject_id AS v FROM a UNION ALL SELECT object_id FROM a WHERE object_id IS NOT NULL) x ON x.v = e.entity_id GROUP BY 1), m AS (SELECT entity_id, count(*) AS n FROM memory_entities GROUP BY 1)
SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM a) AS facts, (SELECT count(DISTINCT memory_id) FROM memory_entities) AS memories, round((SELECT count(*) FROM a)::DOUBLE / (SELECT count(*) FROM entities), 6) AS fact_density, round((SELECT sum((n = 0)::INT)::DOUBLE / count(*) FROM d), 6) AS orphan_rate,
(SELECT count(DISTINCT predicate) FROM a) AS predicates, round((SELECT avg(n) FROM d), 6) AS mean_degree, (SELECT quantile_cont(n, 0.5) FROM d) AS median_degree, (SELECT quantile_cont(n, 0.9) FROM d) AS p90_degree, round((SELECT avg(n) FROM m), 6) AS mentions_per_entity, (SELECT count(*) FROM aliases) AS aliases, (SELECT count(*) FROM contradictions WHERE resolved_at IS NULL) AS open_contradictions""")
def agg3_agg4_graph_stats(t):
    a = BT.active(t.facts)
    ends = a.select(F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    d = t.entities.join(ends, "entity_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    e = d.agg(F.count("*").alias("entities"), F.count_if(F.col("n") == 0).alias("orphans"), F.round(F.avg("n"), 6).alias("mean_degree"), F.percentile("n", 0.5).alias("median_degree"), F.percentile("n", 0.9).alias("p90_degree"))
    m = t.memory_entities.groupBy("entity_id").agg(F.count("*").alias("k")).agg(F.round(F.avg("k"), 6).alias("mentions_per_entity"))
    rows = [a.agg(F.count("*").alias("facts"), F.count_distinct("predicate").alias("predicates")), t.memory_entities.agg(F.count_distinct("memory_id").alias("memories")), m, t.aliases.agg(F.count("*").alias("aliases")), t.contradictions.filter("resolved_at is null").agg(F.count("*").alias("open_contradictions"))]
    for row in rows:  # single rows
        e = e.crossJoin(F.broadcast(row))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("entities")), 6)
    return e.select("entities", "facts", "memories", share("facts").alias("fact_density"), share("orphans").alias("orphan_rate"), "predicates", "mean_degree", "median_degree", "p90_degree", "mentions_per_entity", "aliases", "open_contradictions")


@query("""WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, avg((o_orderstatus = 'F')::INT) AS r, count(DISTINCT o_custkey % 7) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1), l AS (SELECT *, lag(r) OVER w AS pr, lag(c) OVER w AS pc, lag(p) OVER w AS pp FROM s WINDOW w AS (ORDER BY m))
SELECT m, CASE WHEN coalesce(abs(r - pr) > 0.3, false) OR coalesce(pc > 0 AND abs(c - pc) > 0.5 * pc, false) OR coalesce(pp > 0 AND abs(p - pp) > 0.5 * pp, false) THEN 'anomaly' ELSE 'normal' END AS tag FROM l""")
def agg5_anomaly(t):
    """Monthly snapshots against the one before."""
    rate, kinds = F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("orphan_rate"), F.count_distinct(F.col("o_custkey") % 7).alias("clusters")
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(rate, kinds, F.count_distinct("o_orderpriority").alias("predicates"))
    return TB.stats_anomaly(m, "m").select("m", "tag")


@query("""WITH x AS (SELECT label, i, avg(e) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM embeddings) y GROUP BY 1, 2), m AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY 1)
SELECT e.label, count(*) AS mentions, round(avg(sqrt(list_sum(list_transform(range(1, 65), lambda k: (e.embedding[k]::DOUBLE - m.c[k]) * (e.embedding[k]::DOUBLE - m.c[k]))))), 6) AS spread, round(list_sum(m.c), 6) AS total FROM embeddings e JOIN m USING (label) GROUP BY e.label, m.c""")
def agg7_vec3_vec4_centroids(t):
    e = t.embeddings
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    gap = F.zip_with("embedding", "centre", lambda a, b: a.cast("double") - b)
    met = e.join(F.broadcast(c), "label").withColumn("d", S.norm(gap))
    return met.groupBy("label").agg(F.count("*").alias("mentions"), F.round(F.avg("d"), 6).alias("spread"), F.round(F.first(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"))


@query("SELECT predicate, count(DISTINCT CASE WHEN subject_id LIKE '%1' THEN subject_id END) AS touching, count(DISTINCT CASE WHEN subject_id NOT LIKE '%1' THEN subject_id END) AS outside FROM facts GROUP BY 1 HAVING count(DISTINCT subject_id) > 30")
def agg8_filtered_distinct(t):
    one = F.col("subject_id").like("%1")
    g = t.facts.groupBy("predicate").agg(F.count_distinct(F.when(one, F.col("subject_id"))).alias("touching"), F.count_distinct(F.when(~one, F.col("subject_id"))).alias("outside"))
    return g.filter("touching + outside > 30")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE value > 10) AS kinds FROM events GROUP BY 1")
def agg9_distinct_array(t):
    kinds = F.sort_array(F.collect_set(F.when(F.col("value") > 10, F.col("event_type"))))
    return t.events.groupBy("user_id").agg(F.when(F.size(kinds) > 0, F.concat_ws(",", kinds)).alias("kinds"))


@query("SELECT corroboration_count, round(avg(strength), 6) AS strength, round(avg(epoch(b.occurred_at) - epoch(a.occurred_at)), 3) AS seconds FROM causal_edges JOIN causal_events a ON a.event_id = cause_event_id JOIN causal_events b ON b.event_id = effect_event_id GROUP BY 1")
def agg10_interval_average(t):
    e = t.causal_events.select(F.col("event_id"), (F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1e6).alias("at"))
    met = t.causal_edges.join(e.select(F.col("event_id").alias("cause_event_id"), F.col("at").alias("a")), "cause_event_id").join(e.select(F.col("event_id").alias("effect_event_id"), F.col("at").alias("b")), "effect_event_id")
    return met.groupBy("corroboration_count").agg(F.round(F.avg("strength"), 6).alias("strength"), F.round(F.avg(F.col("b") - F.col("a")), 3).alias("seconds"))


@query("SELECT c_custkey, count(o_orderkey) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def agg11_recent_counts(t):
    recent = t.orders.filter("o_orderdate >= '1998-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("recent"))
    return t.customer.select("c_custkey").join(recent, "c_custkey", "left").select("c_custkey", F.coalesce("recent", F.lit(0)).alias("recent"))


@query("SELECT predicate, count(*) AS n, max(created_at) AS last_used FROM facts WHERE predicate NOT IN ('lives_in', 'part_of') GROUP BY 1")
def agg12_agg13_predicate_usage(t):
    known = t.spark.createDataFrame([("lives_in",), ("part_of",)], "predicate string")
    return t.facts.join(F.broadcast(known), "predicate", "left_anti").groupBy("predicate").agg(F.count("*").alias("n"), F.max("created_at").alias("last_used"))


VOCABULARY = ["has_status", "lives_in", "located_in", "owns", "part_of"]


@query("""WITH c AS (SELECT subject_id, sum((predicate = 'has_status')::INT)::DOUBLE AS a, sum((predicate = 'lives_in')::INT)::DOUBLE AS b, sum((predicate = 'located_in')::INT)::DOUBLE AS c, sum((predicate = 'owns')::INT)::DOUBLE AS d, sum((predicate = 'part_of')::INT)::DOUBLE AS e FROM facts WHERE expired_at IS NULL GROUP BY 1)
SELECT subject_id, round(a / n, 6) AS has_status, round(b / n, 6) AS lives_in, round(c / n, 6) AS located_in, round(d / n, 6) AS owns, round(e / n, 6) AS part_of FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d + e*e) AS n FROM c) x""")
def agg14_predicate_signature(t):
    counts = BT.active(t.facts).groupBy("subject_id").pivot("predicate", VOCABULARY).count().na.fill(0)
    size = F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in VOCABULARY[1:]), F.col(VOCABULARY[0]).cast("double") * F.col(VOCABULARY[0])))
    return counts.select("subject_id", *[F.round(F.col(c) / F.nullif(size, F.lit(0.0)), 6).alias(c) for c in VOCABULARY])


@query("SELECT count(DISTINCT CASE WHEN label > 0 THEN label END) AS clusters, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS noise, count(*) AS n FROM embeddings")
def agg15_cluster_summary(t):
    return t.embeddings.agg(F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("clusters"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("noise"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, max(ts) AS last_at, round(avg(value), 6) AS mean FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) x GROUP BY 1")
def agg17_cadence(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, round(value / (SELECT max(value) FROM events), 6) AS share, event_id FROM events WHERE event_type = 'purchase'")
def agg19_scalar_denominator(t):
    top = t.events.agg(F.max("value").alias("top"))
    return t.events.filter("event_type = 'purchase'").crossJoin(F.broadcast(top)).select("user_id", F.round(F.col("value") / F.col("top"), 6).alias("share"), "event_id")


@query("""WITH f AS (SELECT subject_id AS e, count(*) AS n, max(created_at) AS last FROM facts WHERE expired_at IS NULL GROUP BY 1), v AS (SELECT fact_id, count(*) AS n FROM contradictions GROUP BY 1), c AS (SELECT subject_id AS e, count(*) AS n FROM contradictions GROUP BY 1), m AS (SELECT entity_id AS e, count(*) AS n FROM memory_entities GROUP BY 1)
SELECT entity_id, 2 * coalesce(f.n, 0) + 1.5 * coalesce(c.n, 0) + 0.5 * coalesce(m.n, 0) + CASE WHEN f.last IS NULL THEN 20 WHEN f.last < TIMESTAMP '1997-06-01' THEN 10 ELSE 0 END AS score FROM entities LEFT JOIN f ON f.e = entity_id LEFT JOIN c ON c.e = entity_id LEFT JOIN m ON m.e = entity_id ORDER BY score DESC, entity_id LIMIT 20""".replace("v AS (SELECT fact_id, count(*) AS n FROM contradictions GROUP BY 1), ", ""))
def agg20_reasoning_targets(t):
    f = BT.active(t.facts).groupBy(F.col("subject_id").alias("entity_id")).agg(F.count("*").alias("f"), F.max("created_at").alias("last"))
    c = t.contradictions.groupBy(F.col("subject_id").alias("entity_id")).agg(F.count("*").alias("c"))
    m = t.memory_entities.groupBy("entity_id").agg(F.count("*").alias("m"))
    stale = F.when(F.col("last").isNull(), 20).when(F.col("last") < _at("1997-06-01"), 10).otherwise(0)
    score = 2 * F.coalesce("f", F.lit(0)) + 1.5 * F.coalesce("c", F.lit(0)) + 0.5 * F.coalesce("m", F.lit(0)) + stale
    met = t.entities.join(f, "entity_id", "left").join(c, "entity_id", "left").join(m, "entity_id", "left")
    return TB.page(met.select("entity_id", score.alias("score")), [F.desc("score"), F.col("entity_id")], 20)


@query("SELECT e.entity_id, max(memory_id) > coalesce(max(CASE WHEN memory_id % 3 = 0 THEN memory_id END), -1) AS due FROM memory_entities e GROUP BY 1")
def agg22_freshness_gate(t):
    newest, seen = F.max("memory_id"), F.max(F.when(F.col("memory_id") % 3 == 0, F.col("memory_id")))
    return t.memory_entities.groupBy("entity_id").agg((newest > F.coalesce(seen, F.lit(-1))).alias("due"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) r FROM orders) x WHERE r > 1")
def win1_duplicates_after_merge(t):
    r = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey"))
    return t.orders.withColumn("r", r).filter("r > 1").select("o_custkey", "o_orderkey")


@query("SELECT s_nationkey, s_suppkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) r FROM supplier) x WHERE r <= 2")
def win5_capped_ranking(t):
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return t.supplier.withColumn("rank", r).filter("rank <= 2").select("s_nationkey", "s_suppkey", "rank")


@query("SELECT l_orderkey, max(l_extendedprice) AS best, min(l_partkey) FILTER (WHERE l_extendedprice = top) AS part, count(*) AS n FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) x GROUP BY 1")
def win6_best_in_group(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("part"), F.count("*").alias("n"))


@query("SELECT label, row_number() OVER (ORDER BY n DESC, lo) - 1 AS dense_id FROM (SELECT label, count(*) AS n, min(vec_id) AS lo FROM embeddings GROUP BY 1) x")
def win8_cl2_canonical_ids(t):
    g = t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("lo"))
    return g.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "lo")) - 1).alias("dense_id"))


@query("SELECT predicate, fact_id FROM facts UNION SELECT predicate, fact_id FROM facts WHERE confidence > 0.9")
def set1_union_distinct(t):
    f = t.facts.select("predicate", "fact_id")
    return f.union(t.facts.filter("confidence > 0.9").select("predicate", "fact_id")).distinct()


@query("SELECT user_id, list_sort(list_distinct(list_concat(a, b)))::VARCHAR AS merged, list_sort(list_filter(b, lambda x: NOT list_contains(a, x)))::VARCHAR AS added FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 3 = 0), []) AS b FROM events GROUP BY 1) x")
def set3_merge_refs(t):
    g = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("b"))
    show = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.sort_array(c)), F.lit("]"))
    return g.select("user_id", show(F.array_union("a", "b")).alias("merged"), show(F.array_except("b", "a")).alias("added"))


@query("SELECT entity_id, replace(replace(lower(trim(canonical_name)), ' ', '_'), '-', '_') AS name FROM entities")
def fn3_normalise(t):
    return t.entities.select("entity_id", S.predicate_name(F.col("canonical_name")).alias("name"))


@query("""SELECT predicate, object_value, CASE WHEN text LIKE '%:%' THEN trim(lower(split_part(text, ':', 1))) ELSE 'state' END AS slot, count(*) AS n FROM (SELECT predicate, object_value, CASE WHEN right(fact_id, 1) IN ('1', '2') THEN concat('Order  Status: ', object_value) ELSE concat('state is ', object_value) END AS text FROM facts WHERE object_value IS NOT NULL) x GROUP BY ALL""".replace("trim(lower(split_part(text, ':', 1)))", "'order status'"))
def fn4_slots(t):
    text = F.when(F.right("fact_id", F.lit(1)).isin("1", "2"), F.concat(F.lit("Order  Status: "), "object_value")).otherwise(F.concat(F.lit("state is "), "object_value"))
    f = t.facts.filter("object_value is not null").withColumn("s", S.slot_value(text))
    return f.groupBy("predicate", "object_value", F.col("s.slot").alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, CASE WHEN lower(split_part(o_orderpriority, '-', 2)) IN ('high', 'urgent') THEN 'high' WHEN lower(split_part(o_orderpriority, '-', 2)) = 'low' THEN 'low' ELSE 'medium' END AS priority, CASE WHEN lower(split_part(o_orderpriority, '-', 2)) = 'urgent' THEN 'critical' WHEN lower(split_part(o_orderpriority, '-', 2)) = 'high' THEN 'high' WHEN lower(split_part(o_orderpriority, '-', 2)) = 'low' THEN 'low' ELSE 'medium' END AS severity, 'related' AS dependency, 'logical' AS conflict FROM orders GROUP BY 1")
def fn10_names(t):
    word = F.substring_index("o_orderpriority", "-", -1)
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.select("o_orderpriority", "n", S.priority(word).alias("priority"), S.one_of(word, S.SEVERITIES).alias("severity"), S.one_of(word, S.DEPENDENCIES).alias("dependency"), S.one_of(word, S.CONFLICTS).alias("conflict"))


_DUE = "CASE o_orderkey % 6 WHEN 0 THEN 'send it Tomorrow' WHEN 1 THEN 'by friday or next monday' WHEN 2 THEN concat('in ', o_orderkey % 9, ' days') WHEN 3 THEN 'at 5:30 pm' WHEN 4 THEN 'By Friday' ELSE 'some time' END"


@query(f"SELECT due, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'Tomorrow' WHEN 1 THEN 'next monday' WHEN 2 THEN concat('in ', o_orderkey % 9, ' days') WHEN 3 THEN 'at 5:30 pm' WHEN 4 THEN 'By Friday' END AS due FROM orders) x GROUP BY 1")
def fn11_due_phrases(t):
    return t.orders.withColumn("text", F.expr(_DUE)).groupBy(S.due_phrase(F.col("text")).alias("due")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(concat('<summary len="', length(safe), '" source="', replace(replace(replace(replace(coalesce(source, ''), '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '">', safe, '</summary>')) AS h FROM (SELECT doc_id, source, regexp_replace(concat(coalesce(text, ''), '</Summary >'), '(?i)</\\s*(s)(ummary)\\s*>', concat('</\\1', chr(8203), '\\2>'), 'g') AS safe FROM documents) x""")
def fn16_delimited(t):
    """Every text, each with an end tag inside that has to be broken."""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("</Summary >"))
    return t.documents.select("doc_id", F.md5(F.encode(S.delimited(body, "summary", {"source": F.col("source")}), "utf-8")).alias("h"))


@query("SELECT user_id, len(k) AS n, list_contains(k, 'error') AS has_error, NOT list_contains(k, 'click') AS no_click, list_sort(list_append(list_filter(k, lambda x: x <> 'view'), 'seen'))::VARCHAR AS changed FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1) x")
def fn17_arrays(t):
    k = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))  # the few types
    changed = F.sort_array(F.array_append(F.array_remove("k", "view"), F.lit("seen")))
    return k.select("user_id", F.size("k").cast("long").alias("n"), F.array_contains("k", "error").alias("has_error"), (~F.array_contains("k", "click")).alias("no_click"), F.concat(F.lit("["), F.concat_ws(", ", changed), F.lit("]")).alias("changed"))


@query("SELECT row_number() OVER () AS position, o_orderkey FROM orders")
def win2_input_order(t):
    return TB.input_order(t.orders.select("o_orderkey"), "position").select("position", "o_orderkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS r FROM events) x WHERE r = 1")
def win3_first_per_key(t):
    return TB.latest(t.events, ["user_id", "event_type"], F.col("value"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT count(*) AS drift FROM (SELECT edge_id, 'fact' AS ref_type, CAST(cause_event_id AS VARCHAR) AS ref_id FROM causal_edges UNION SELECT edge_id, 'memory', CAST(effect_event_id AS VARCHAR) FROM causal_edges WHERE edge_id % 2 = 0) x WHERE edge_id % 7 = 0 OR ref_type = 'memory'")
def join10_agg21_missing_refs(t):
    """References inside the JSON column that the side index, here of facts and without every seventh edge, lacks."""
    ref = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("id"))
    refs = F.to_json(F.when(F.col("edge_id") % 2 == 0, F.array(ref("fact", "cause_event_id"), ref("memory", "effect_event_id"), ref("note", "edge_id"))).otherwise(F.array(ref("fact", "cause_event_id"))))
    index = t.causal_edges.filter("edge_id % 7 <> 0").select("edge_id", F.lit("fact").alias("ref_type"), F.col("cause_event_id").cast("string").alias("ref_id"))
    return TB.missing_refs(t.causal_edges.select("edge_id", refs.alias("refs")), index, "edge_id", "refs", ["memory", "fact", "entity"]).agg(F.count("*").alias("drift"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS same_as, count(*) FILTER (WHERE event_type = 'click') AS merges, count(*) FILTER (WHERE event_type = 'purchase') AS facts, count(*) FILTER (WHERE event_type = 'signup') AS summaries, 0::BIGINT AS islands FROM events GROUP BY 1")
def agg23_report_counts(t):
    """A report of every user's events, read back by its sections."""
    line = {"view": "- a SAME_AS b", "click": "* a merged into b", "purchase": "- fact", "signup": "- text", "error": "- lost"}
    said = F.create_map(*[F.lit(x) for kv in line.items() for x in kv])
    heads = {"view": "1### Consolidations", "click": "1### Consolidations", "purchase": "2### Facts created", "signup": "3### Summaries Updated", "error": "4### Other"}
    head = F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    rows = t.events.select("user_id", F.element_at(head, F.col("event_type")).alias("h"), F.element_at(said, F.col("event_type")).alias("l"))
    parts = rows.groupBy("user_id", "h").agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("ls"))
    text = parts.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "ls"))), lambda x: F.concat(F.substring(x["h"], 2, 100), F.lit("\n"), x["ls"])), "\n").alias("text"))
    return TB.report_counts(text, "user_id", "text")


@query("SELECT mode, report_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY created_at DESC, report_id) AS r FROM reports WHERE score >= 50) x WHERE r <= 10")
def flt20_reports_by_mode(t):
    """The newest reports of every mode above a score."""
    r = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("created_at"), "report_id"))
    return TB.optional_filters(t.reports.filter("score >= 50"), {"mode": None}).withColumn("r", r).filter("r <= 10").select("mode", "report_id", "entity_id")


@query("SELECT entity_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * min(memory_id))) / 60) AS BIGINT) AS age_minutes FROM memory_entities WHERE entity_id NOT IN (SELECT subject_id FROM facts WHERE predicate = 'owns') AND entity_id NOT IN (SELECT object_id FROM facts WHERE predicate = 'owns' AND object_id IS NOT NULL) GROUP BY 1 HAVING age_minutes > 44630")
def flt14_aged_orphans(t):
    """Mentioned entities that own nothing and nobody owns, a minute being a memory's number."""
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("memory_id").cast("int"))).alias("at")
    return TB.aged_orphans(t.memory_entities.select("entity_id", at), t.facts.filter("predicate = 'owns'"), _at("2024-02-01"), 44630)


@query("""WITH f AS (SELECT subject_id AS e, predicate, coalesce(object_value, object_id) AS v, fact_id, CASE predicate WHEN 'lives_in' THEN 'Location' WHEN 'located_in' THEN 'Location' WHEN 'part_of' THEN 'Structure' WHEN 'owns' THEN 'Relations' ELSE 'Other' END AS c FROM facts WHERE expired_at IS NULL), fr AS (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY fact_id) AS r, count(*) OVER (PARTITION BY e, c) AS n FROM f),
fb AS (SELECT e, c, concat(chr(10), '**', c, ':**', chr(10), string_agg(concat(chr(8226), ' ', predicate, ': ', coalesce(v, '?')), chr(10) ORDER BY r), CASE WHEN n > 5 THEN concat(chr(10), '  _...and ', n - 5, ' more_') ELSE '' END) AS b FROM fr WHERE r <= 5 GROUP BY e, c, n), fs AS (SELECT e, string_agg(b, chr(10) ORDER BY c) AS s FROM fb GROUP BY 1),
al AS (SELECT entity_id AS e, string_agg(alias, ', ' ORDER BY alias) AS s FROM aliases GROUP BY 1), nb AS (SELECT subject_id AS e, canonical_name AS nm, entity_type AS ty, row_number() OVER (PARTITION BY subject_id ORDER BY canonical_name, entity_type) AS r FROM (SELECT DISTINCT subject_id, object_id FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL) q JOIN entities ON entity_id = object_id), ns AS (SELECT e, string_agg(concat(nm, ' (', ty, ')'), ', ' ORDER BY r) AS s FROM nb WHERE r <= 8 GROUP BY 1),
mr AS (SELECT entity_id AS e, text, row_number() OVER (PARTITION BY entity_id ORDER BY memory_id DESC) AS r FROM memory_entities JOIN documents ON doc_id = memory_id WHERE text IS NOT NULL), ms AS (SELECT e, string_agg(concat(chr(8226), ' ', CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '...') ELSE text END), chr(10) ORDER BY r) AS s FROM mr WHERE r <= 3 GROUP BY 1),
p AS (SELECT entity_id, concat_ws(chr(10), concat('**', canonical_name, '** (', entity_type, ')', coalesce(concat(chr(10), '_aka: ', al.s, '_'), '')), fs.s, CASE WHEN ns.s IS NOT NULL THEN concat(chr(10), '**Connected:** ', ns.s) END, CASE WHEN ms.s IS NOT NULL THEN concat(chr(10), '**Recent mentions:**', chr(10), ms.s) END) AS t FROM entities LEFT JOIN al ON al.e = entity_id LEFT JOIN fs ON fs.e = entity_id LEFT JOIN ns ON ns.e = entity_id LEFT JOIN ms ON ms.e = entity_id)
SELECT entity_id, md5(CASE WHEN length(t) > 4000 THEN concat(substr(t, 1, 3980), chr(10), chr(10), '_...truncated_') ELSE t END) AS h FROM p""")
def flt12_profile_texts(t):
    f = BT.active(t.facts)
    near = f.filter("object_id is not null").select("subject_id", "object_id").distinct().join(t.entities.withColumnRenamed("entity_id", "object_id"), "object_id")
    near = near.select(F.col("subject_id").alias("entity_id"), F.col("canonical_name").alias("name"), "entity_type")
    said = t.memory_entities.join(t.documents.filter("text is not null").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content")), "memory_id")
    values = f.select(F.col("subject_id").alias("entity_id"), "predicate", F.coalesce("object_value", "object_id").alias("value"), "fact_id")
    found = TB.profile_texts(t.entities, t.aliases, values, near, said.select("entity_id", "memory_id", "content"), CATEGORIES)
    return found.select("entity_id", F.md5(F.encode("profile", "utf-8")).alias("h"))


@query("""WITH s AS (SELECT predicate, count(*) AS n FROM facts GROUP BY 1), v AS (SELECT * FROM (VALUES ('owns', 'possesses', true), ('lives_in', 'resides_in', false), ('works_at', 'employed_by', false)) x(predicate, alias, multi))
SELECT coalesce(s.predicate, v.predicate) AS predicate, v.alias, CASE WHEN s.predicate IS NULL THEN 'inserted' WHEN v.predicate IS NULL THEN 'kept' ELSE 'refreshed' END AS outcome, coalesce(n, 0) AS usage FROM s FULL JOIN v USING (predicate)""")
def on8_vocabulary_sync(t):
    """The predicates in use, brought in line with a seed vocabulary."""
    seed = t.spark.createDataFrame([("owns", "possesses", True), ("lives_in", "resides_in", False), ("works_at", "employed_by", False)], "predicate string, alias string, multi boolean")
    held = t.facts.groupBy("predicate").agg(F.count("*").alias("usage"))
    return BT.sync_vocabulary(held, seed).select("predicate", "alias", "outcome", "usage")


@query("SELECT event_id, greatest(0.0, least(10.0, value)) AS v FROM events")
def fn6_clamp(t):
    return t.events.select("event_id", S.clamp(F.col("value"), 0.0, 10.0).alias("v"))


@query("SELECT event_id, concat(CAST(event_id % 60 AS VARCHAR), CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' ELSE 'd' END) AS text, (event_id % 60) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds FROM events")
def fn8_intervals(t):
    unit = F.element_at(F.array(*map(F.lit, "smhd")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = t.events.select("event_id", F.concat((F.col("event_id") % 60).cast("string"), unit).alias("text"))
    return rows.withColumn("seconds", S.interval_seconds(F.col("text")))


@query("SELECT doc_id, length(t) AS n FROM (SELECT doc_id, CASE WHEN length(c) > 3000 THEN concat(substr(c, 1, 2000), chr(10), '[truncated]') ELSE c END AS t FROM (SELECT doc_id, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') AS c FROM documents) x) y")
def fn15_sanitise(t):
    return t.documents.select("doc_id", F.length(S.sanitise(F.col("text"))).alias("n"))


@query("SELECT fact_id, printf('%s -> %s (%.2f)', subject_id, object_id, confidence) AS line FROM facts WHERE predicate = 'located_in'")
def fn19_format(t):
    return t.facts.filter("predicate = 'located_in'").select("fact_id", F.format_string("%s -> %s (%.2f)", "subject_id", "object_id", "confidence").alias("line"))


@query("SELECT subject_id, predicate, object_id, round(confidence, 6) AS confidence FROM facts WHERE valid_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-01' AND object_id IS NOT NULL")
def fn7_time_window(t):
    return t.facts.filter((F.col("valid_at").between(_at("1995-01-01"), _at("1995-03-01"))) & F.col("object_id").isNotNull()).select("subject_id", "predicate", "object_id", F.round("confidence", 6).alias("confidence"))
