"""Entity resolution and the predicate vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import bridges as B
from chronoweave.operators import graph as G
from chronoweave.operators import resolution as R
from chronoweave.operators import tables as TB
from chronoweave.operators import temporal as BT
from chronoweave.operators import text as X
from chronoweave.operators import vectors as V
from chronoweave.operators.clustering import density_clusters
from chronoweave.operators.components import connected_components
from chronoweave.plans.stash import stash
from chronoweave.registry import query


@query("SELECT lower(canonical_name) AS name, entity_type, min(entity_id) AS entity_id, count(*) AS n FROM entities GROUP BY 1, 2")
def er1_exact_dedup(t):
    return t.entities.groupBy(F.lower("canonical_name").alias("name"), "entity_type").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))


@query("""WITH n AS MATERIALIZED (SELECT lower(canonical_name) AS name, min(entity_id) AS id FROM entities GROUP BY 1), w AS (SELECT id, unnest(string_split(regexp_replace(name, '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM n), g AS MATERIALIZED (SELECT DISTINCT id, substr('  ' || w || ' ', i, 3) AS t FROM w, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i) u WHERE w <> ''), c AS (SELECT id, count(*) AS n FROM g GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(count(*)::DOUBLE / (ca.n + cb.n - count(*)), 6) AS similarity FROM g a JOIN g b ON a.t = b.t JOIN c ca ON ca.id = a.id JOIN c cb ON cb.id = b.id GROUP BY a.id, b.id, ca.n, cb.n HAVING count(*)::DOUBLE / (ca.n + cb.n - count(*)) >= 0.8""")
def er2_fn1_similar_names(t):
    """All entities; numbered names are alike when they differ in their last digits."""
    n = t.entities.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"))
    return R.similar_names(n, n, 0.8).withColumn("similarity", F.round("similarity", 6))


_CENTRES = "ce AS MATERIALIZED (SELECT entity_id, list(m ORDER BY i) AS v FROM (SELECT entity_id, i, avg(e) AS m FROM (SELECT entity_id, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM mentions) y GROUP BY 1, 2) x GROUP BY 1), me AS (SELECT entity_id, count(*) AS n FROM memory_entities GROUP BY 1)"
_CANDIDATES = f"{_CENTRES}, ca AS MATERIALIZED (SELECT a.entity_id AS a, b.entity_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM ce a JOIN ce b ON a.entity_id < b.entity_id JOIN me x ON x.entity_id = a.entity_id AND x.n >= 2 JOIN me y ON y.entity_id = b.entity_id AND y.n >= 2 WHERE list_cosine_similarity(a.v, b.v) >= 0.4 AND right(a.entity_id, 1) <> right(b.entity_id, 1))"


def _centres(t):
    return V.centroids(t.mentions, "entity_id", "embedding")


def _candidates(t):
    """Similar entities with two mentions or more; pairs of one last digit are resolved already."""
    often = t.memory_entities.groupBy("entity_id").agg(F.count("*").alias("n"))
    last = t.entities.select("entity_id", F.right("entity_id", F.lit(1)).alias("d"))
    centres = _centres(t)
    met = R.merge_candidates(centres, often, t.spark.createDataFrame([], "a string, b string"))
    ends = met.join(last.toDF("a", "da"), "a").join(last.toDF("b", "db"), "b")
    return met.join(ends.filter("da = db").select("a", "b"), ["a", "b"], "left_anti")


@query("""WITH q AS (SELECT vec_id AS mention, embedding AS m FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT mention, vec_id AS entity, list_cosine_similarity(m::DOUBLE[], embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY mention ORDER BY round(list_cosine_similarity(m::DOUBLE[], embedding::DOUBLE[]), 12) DESC, vec_id) AS r FROM q, embeddings WHERE vec_id % 20 <> 0)
SELECT mention, CASE WHEN s > 0.75 THEN entity END AS entity, CASE WHEN s > 0.92 THEN 'merged' WHEN s > 0.75 THEN 'verify' ELSE 'created' END AS outcome FROM s WHERE r = 1""")
def er3_er4_resolve_mentions(t):
    """The stated queries, ids divisible by 20, as mentions and all other vectors as entities."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = V.knn(v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), v.filter("id % 20 <> 0"), 1)
    return R.resolve_mentions(best.select(F.col("query_id").alias("mention"), F.col("id").alias("entity"), "similarity"))


@query("SELECT memory_id, entity_id FROM memory_entities GROUP BY 1, 2")
def er5_link_mentions(t):
    held = t.memory_entities.filter("memory_id % 2 = 0").distinct()
    return TB.insert_absent(held, t.memory_entities, ["memory_id", "entity_id"])


@query("SELECT entity_id, alias, canonical_name AS owner FROM aliases JOIN entities USING (entity_id) WHERE alias ILIKE '%rica%' OR alias ILIKE 'nation_1%'")
def er6_alias_search(t):
    met = t.aliases.filter(F.col("alias").ilike("%rica%") | F.col("alias").ilike("nation_1%"))
    return met.join(t.entities.select("entity_id", F.col("canonical_name").alias("owner")), "entity_id")


@query("SELECT stream_id, speaker_key, entity_id, CASE speaker_key WHEN 'assistant' THEN 'assistant' ELSE 'person' END AS entity_type FROM participants")
def er7_st7_speakers(t):
    c = t.conversations.filter(F.col("role").isin("user", "assistant")).select(F.col("conv_id").alias("stream_id"), F.col("role").alias("speaker_key")).distinct()
    kind = F.when(F.col("speaker_key") == "assistant", "assistant").otherwise("person")
    return c.select("stream_id", "speaker_key", F.concat(F.lit("K"), F.col("stream_id").cast("string"), F.lit(":"), F.col("speaker_key")).alias("entity_id"), kind.alias("entity_type"))


@query(f"WITH {_CANDIDATES} SELECT a, b, CASE WHEN s >= 0.7 THEN 'candidate' ELSE 'staging' END AS status FROM ca")
def er8_merge_candidates(t):
    return _candidates(t).select("a", "b", "status")


_TYPED = "te AS MATERIALIZED (SELECT subject_id AS src, object_id AS dst FROM facts WHERE expired_at IS NULL AND predicate IN ('lives_in', 'located_in', 'part_of')), tb AS MATERIALIZED (SELECT src, dst FROM te UNION ALL SELECT dst, src FROM te), td AS MATERIALIZED (SELECT src AS v, count(*) AS d FROM tb GROUP BY 1), tn AS (SELECT count(*)::DOUBLE AS n FROM td), t0 AS (SELECT v, 1 / (SELECT n FROM tn) AS r FROM td), " + ", ".join(
    f"t{i} AS MATERIALIZED (SELECT tb.dst AS v, 0.15 / (SELECT n FROM tn) + 0.85 * sum(r / td.d) AS r FROM t{i - 1} JOIN td USING (v) JOIN tb ON tb.src = v GROUP BY 1)" for i in range(1, 9)
)
_SIGNALS = f"""{_CANDIDATES}, {_TYPED},
mm AS MATERIALIZED (SELECT DISTINCT entity_id, memory_id FROM memory_entities), mn AS (SELECT entity_id, count(*) AS n FROM mm GROUP BY 1), mk AS (SELECT a, b, count(*) AS k FROM ca JOIN mm x ON x.entity_id = a JOIN mm y ON y.entity_id = b AND y.memory_id = x.memory_id GROUP BY 1, 2),
ff AS MATERIALIZED (SELECT DISTINCT subject_id AS e, concat(predicate, '|', coalesce(object_id, '')) AS m FROM facts WHERE expired_at IS NULL AND subject_id IN (SELECT a FROM ca UNION SELECT b FROM ca)), fn AS (SELECT e, count(*) AS n FROM ff GROUP BY 1), fk AS (SELECT a, b, count(*) AS k FROM ca JOIN ff x ON x.e = a JOIN ff y ON y.e = b AND y.m = x.m GROUP BY 1, 2),
sg AS (SELECT subject_id AS e, [sum((predicate = 'owns')::INT)::DOUBLE, sum((predicate = 'located_in')::INT)::DOUBLE, sum((predicate = 'part_of')::INT)::DOUBLE] AS v FROM facts WHERE expired_at IS NULL AND predicate IN ('owns', 'located_in', 'part_of') GROUP BY 1),
dr AS (SELECT DISTINCT entity_id FROM mentions JOIN ce USING (entity_id) WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], v) > 0.95),
cu AS (SELECT DISTINCT tb.src AS entity_id FROM tb JOIN td ON td.v = tb.dst WHERE td.d = 1),
si AS (SELECT ca.a, ca.b, ca.s AS centroid, coalesce(mk.k, 0)::DOUBLE / (ma.n + mb.n - coalesce(mk.k, 0)) AS memories, coalesce(fk.k, 0)::DOUBLE / nullif(coalesce(fa.n, 0) + coalesce(fb.n, 0) - coalesce(fk.k, 0), 0) AS facts,
  CASE WHEN xa.cluster = xb.cluster THEN least(xa.probability, xb.probability) END AS cluster, list_cosine_similarity(ga.v, gb.v) AS signature, CASE WHEN a IN (SELECT entity_id FROM dr) OR b IN (SELECT entity_id FROM dr) THEN 1.0 END AS drift,
  least(ra.r, rb.r) / (SELECT max(r) FROM t8) AS centrality, CASE WHEN a IN (SELECT entity_id FROM cu) OR b IN (SELECT entity_id FROM cu) THEN 0.5 ELSE 0.0 END AS articulation, CASE WHEN pa.component = pb.component THEN 1.0 ELSE 0.0 END AS component
  FROM ca LEFT JOIN mk USING (a, b) LEFT JOIN fk USING (a, b) JOIN mn ma ON ma.entity_id = a JOIN mn mb ON mb.entity_id = b LEFT JOIN fn fa ON fa.e = a LEFT JOIN fn fb ON fb.e = b LEFT JOIN entity_clusters xa ON xa.entity_id = a LEFT JOIN entity_clusters xb ON xb.entity_id = b
  LEFT JOIN sg ga ON ga.e = a LEFT JOIN sg gb ON gb.e = b LEFT JOIN t8 ra ON ra.v = a LEFT JOIN t8 rb ON rb.v = b LEFT JOIN regions_of pa ON pa.entity_id = a LEFT JOIN regions_of pb ON pb.entity_id = b)"""


def _weighed(weights):
    top = " + ".join(f"{w!r} * coalesce({s}, 0)" for s, w in weights.items())
    return f"({top}) / ({' + '.join(f'CASE WHEN {s} IS NULL THEN 0 ELSE {w!r} END' for s, w in weights.items())})"


def _signals(t, pairs):
    pairs = stash(pairs)
    places = G.entity_edges(t.facts.filter("predicate in ('lives_in', 'located_in', 'part_of')"))
    degree = G.both_ways(places).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    ranks = G.pagerank(places, degree.select("v"), rounds=8).toDF("entity_id", "pagerank")
    # a vertex with a neighbour that has no other edge is a cut vertex
    hung = G.both_ways(places).join(degree.filter("d = 1").select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("entity_id"), F.lit(True).alias("c")).distinct()
    cuts = degree.select(F.col("v").alias("entity_id")).join(hung, "entity_id", "left").select("entity_id", F.coalesce("c", F.lit(False)).alias("is_cut"))
    facts = R.facts_of(t.facts, pairs)
    kinds = facts.filter("expired_at is null and predicate in ('owns', 'located_in', 'part_of')").groupBy(F.col("subject_id").alias("entity_id")).pivot("predicate", ["owns", "located_in", "part_of"]).count().na.fill(0)
    signature = kinds.select("entity_id", F.array(*[F.col(c).cast("double") for c in ("owns", "located_in", "part_of")]).alias("signature"))
    centres = _centres(t)
    away = t.mentions.join(centres, "entity_id").filter(1 - S.cosine(F.col("embedding"), F.col("centre")) > 0.95).select("entity_id").distinct()
    return R.pair_signals(pairs, centres, t.memory_entities, facts, t.entity_clusters, signature, away, ranks, cuts, t.regions_of)


@query(f"WITH {_SIGNALS} SELECT a, b, " + ", ".join(f"round({s}, 6) AS {s}" for s in R.WEIGHTS) + f", round({_weighed(R.WEIGHTS)}, 6) AS score FROM si")
def er9_er10_join13_pair_scores(t):
    """All nine signals of the merge candidates and their mean by weight."""
    found = _signals(t, _candidates(t).select("a", "b"))
    return found.select("a", "b", *[F.round(s, 6).alias(s) for s in R.WEIGHTS], F.round(R.combined_score(), 6).alias("score"))


_CROSS = R.cross_weights({"role": 0.4})


@query(f"WITH {_SIGNALS} SELECT a, b, round({_weighed(_CROSS)}, 6) AS score FROM si WHERE component = 0")
def er17_cross_weights(t):
    """Pairs across components under the weights of such pairs, one of them overridden and all scaled."""
    found = _signals(t, _candidates(t).select("a", "b")).filter("component = 0")
    return found.select("a", "b", F.round(R.combined_score(_CROSS), 6).alias("score"))


@query("SELECT label, CASE WHEN n < 50 THEN 0.075 ELSE 0.15 END AS centroid, CASE WHEN label <= 1 THEN 0.0 ELSE 0.15 END AS cluster, round(0.05 + (0.15 - CASE WHEN n < 50 THEN 0.075 ELSE 0.15 END + 0.15 - CASE WHEN label <= 1 THEN 0.0 ELSE 0.15 END) * 0.05 / 0.7, 9) AS component FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) x")
def er11_adapt_weights(t):
    g = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    w = R.adapt_weights(R.WEIGHTS, F.when(F.col("n") < 50, 0.05).otherwise(0.5), F.col("label"))
    return g.select("label", w["centroid"].alias("centroid"), w["cluster"].alias("cluster"), F.round(w["component"], 9).alias("component"))


@query(f"WITH {_CANDIDATES}, x AS (SELECT entity_id AS a, memory_id FROM memory_entities WHERE memory_id % 60 = 0) SELECT a, b FROM ca WHERE a NOT IN (SELECT a FROM x) AND b NOT IN (SELECT a FROM x)")
def er12_join4_resolved_filter(t):
    """Candidates neither side of which was resolved, by the memories that say so."""
    done = t.memory_entities.filter("memory_id % 60 = 0").select("entity_id").distinct()
    met = _candidates(t).select("a", "b")
    return met.join(done.toDF("a"), "a", "left_anti").join(done.toDF("b"), "b", "left_anti").select("a", "b")


@query(f"""WITH {_CANDIDATES}, h AS (SELECT a, b, s / 2 AS score, CASE WHEN right(a, 1) = '1' THEN 'resolved' ELSE 'staging' END AS status, CASE WHEN right(b, 1) = '2' THEN 'cross_cluster' ELSE 'sweep' END AS source FROM ca WHERE right(a, 1) IN ('1', '2', '3')), n AS (SELECT a, b, s, 'drift' AS source FROM ca WHERE right(b, 1) NOT IN ('4', '5'))
SELECT coalesce(h.a, n.a) AS a, coalesce(h.b, n.b) AS b, round(CASE WHEN n.a IS NULL OR status = 'resolved' THEN h.score ELSE n.s END, 6) AS score, CASE WHEN n.a IS NULL OR status = 'resolved' THEN status WHEN n.s >= 0.7 THEN 'candidate' ELSE 'staging' END AS status,
CASE WHEN n.a IS NULL OR status = 'resolved' OR h.source = 'cross_cluster' THEN h.source ELSE n.source END AS source, (h.a IS NOT NULL)::BIGINT + (n.a IS NOT NULL)::BIGINT AS detections FROM h FULL JOIN n ON n.a = h.a AND n.b = h.b""")
def er13_candidate_upsert(t):
    c = stash(_candidates(t))
    end = lambda x: F.right(x, F.lit(1))
    held = c.filter(end("a").isin("1", "2", "3")).select("a", "b", (F.col("similarity") / 2).alias("score"), F.when(end("a") == "1", "resolved").otherwise("staging").alias("status"), F.when(end("b") == "2", "cross_cluster").otherwise("sweep").alias("source"), F.lit(1).cast("long").alias("detections"))
    new = c.filter(~end("b").isin("4", "5")).select("a", "b", F.col("similarity").alias("score"), F.lit("drift").alias("source"))
    return R.upsert_candidates(held, new).withColumn("score", F.round("score", 6))


_ACROSS = f"""{_CENTRES}, en AS (SELECT entity_id, component, cluster FROM regions_of JOIN entity_clusters USING (entity_id)), zz AS (SELECT component FROM regions_of GROUP BY 1 HAVING count(*) >= 2),
sw AS (SELECT a.entity_id AS a, b.entity_id AS b, a.component AS ca, b.component AS cb, round(list_cosine_similarity(x.v, y.v), 9) AS s FROM en a JOIN en b ON a.cluster = b.cluster AND a.component < b.component JOIN ce x ON x.entity_id = a.entity_id JOIN ce y ON y.entity_id = b.entity_id WHERE a.component IN (SELECT component FROM zz) AND b.component IN (SELECT component FROM zz)),
sp AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY ca, cb ORDER BY s DESC, a, b) AS r FROM sw WHERE s >= 0.3) x WHERE r <= 5)"""


def _bridging(t):
    """Entities of regions with their clusters; one has a core number of 1 or more exactly if it has an arc."""
    arcs = t.facts.filter("expired_at is null and object_id is not null and subject_id <> object_id")
    ends = arcs.select(F.col("subject_id").alias("entity_id")).union(arcs.select("object_id")).groupBy("entity_id").agg(F.lit(1).alias("k_core"))
    sizes = t.regions_of.groupBy("component").agg(F.count("*").alias("component_size"))
    topology = t.regions_of.join(sizes, "component").join(ends, "entity_id", "left")
    return B.bridge_entities(topology, t.entity_clusters, t.participants).filter("cluster is not null")


def _held(t):
    """Entities that may bridge components, and their centres, each worked out once."""
    return stash(_bridging(t)), stash(_centres(t))


def _sweep(held):
    return B.cross_component_best(*held)


@query(f"WITH {_ACROSS} SELECT a, b FROM sp")
def er14_er16_cross_component(t):
    """The best five pairs of every two components, of one cluster and similar enough."""
    return _sweep(_held(t)).select("a", "b")


_DRIFT = f"""{_ACROSS}, tg AS (SELECT entity_id, label AS target FROM (SELECT entity_id, label, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, label) AS r FROM (SELECT m.entity_id, m.label, count(*) AS n FROM mentions m JOIN entity_clusters k ON k.entity_id = m.entity_id AND k.cluster <> m.label GROUP BY 1, 2) x) y WHERE r = 1),
dp AS (SELECT a, b FROM (SELECT g.entity_id AS a, e.entity_id AS b, row_number() OVER (PARTITION BY g.entity_id ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, e.entity_id) AS r FROM tg g JOIN en o ON o.entity_id = g.entity_id JOIN en e ON e.cluster = g.target AND e.component <> o.component JOIN ce x ON x.entity_id = g.entity_id JOIN ce y ON y.entity_id = e.entity_id) z WHERE r <= 10)"""


def _drift_pairs(t, held):
    """An entity whose mentions drift to another cluster, with the ten nearest members of it in other components."""
    n = t.mentions.join(t.entity_clusters.select("entity_id", "cluster"), "entity_id").filter("cluster <> label").groupBy("entity_id", "label").agg(F.count("*").alias("n"))
    target = n.groupBy("entity_id").agg(F.min(F.struct(-F.col("n"), F.col("label"))).alias("m")).select("entity_id", F.col("m.label").alias("cluster"))
    return B.drift_best(target.withColumnRenamed("cluster", "target"), *held)


@query(f"WITH {_DRIFT} SELECT a, b FROM dp")
def er15_drift_pairs(t):
    return _drift_pairs(t, _held(t)).select("a", "b")


@query(f"WITH {_DRIFT} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM sp UNION ALL SELECT a, b FROM dp) x")
def er16_policy_union(t):
    """Both policies, every pair once."""
    held = _held(t)
    return B.bridge_pairs(_sweep(held), _drift_pairs(t, held)).select("a", "b")


@query(f"WITH {_DRIFT}, al AS (SELECT a, b, s, false AS d FROM sw JOIN sp USING (a, b) UNION ALL SELECT least(a, b), greatest(a, b), round(list_cosine_similarity(x.v, y.v), 9), true FROM dp JOIN ce x ON x.entity_id = a JOIN ce y ON y.entity_id = b) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 6) AS score, bool_or(d) AS drift_driven FROM al GROUP BY 1, 2")
def er14_er15_bridge_pairs(t):
    """The pairs of both policies with their scores; what a drift drives stays marked though the sweep has it too."""
    held = _held(t)
    return B.bridge_pairs(_sweep(held), _drift_pairs(t, held)).withColumn("score", F.round("score", 6))


@query("SELECT max(o_orderdate) >= (SELECT max(l_shipdate) FROM lineitem) AS fresh FROM orders")
def er18_freshness(t):
    return t.orders.agg(F.max("o_orderdate").alias("a")).crossJoin(t.lineitem.agg(F.max("l_shipdate").alias("b"))).select((F.col("a") >= F.col("b")).alias("fresh"))


@query("""WITH m AS (SELECT concat('S', s_suppkey::VARCHAR) AS source, concat('S', lo::VARCHAR) AS survivor FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS lo FROM supplier) x WHERE s_suppkey <> lo),
f AS (SELECT coalesce(survivor, subject_id) AS s, predicate, object_id, confidence, created_at, fact_id FROM facts LEFT JOIN m ON source = subject_id WHERE predicate = 'owns')
SELECT s AS subject_id, object_id, fact_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY s, predicate, object_id ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS r FROM f) x WHERE r = 1""")
def er19_merge_entities(t):
    s = t.supplier.select("s_nationkey", "s_suppkey").withColumn("lo", F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))).filter("s_suppkey <> lo")
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    facts, _ = R.merge_entities(t.facts.filter("predicate = 'owns'"), s.select(name("s_suppkey").alias("source"), name("lo").alias("survivor")))
    return facts.select("subject_id", "object_id", "fact_id", "confidence")


_CASCADE = """c AS MATERIALIZED (SELECT s_suppkey AS k, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt, last_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM supplier),
m AS MATERIALIZED (SELECT concat('S', k) AS source, concat('S', z) AS survivor FROM c WHERE nxt IS NOT NULL),
fa AS (SELECT *, row_number() OVER (PARTITION BY s, predicate, o ORDER BY confidence DESC NULLS LAST, created_at DESC, fact_id) AS r FROM (SELECT fact_id, coalesce(x.survivor, subject_id) AS s, predicate, coalesce(y.survivor, object_id, object_value) AS o, confidence, created_at FROM facts LEFT JOIN m x ON x.source = subject_id LEFT JOIN m y ON y.source = object_id WHERE expired_at IS NULL AND predicate IN ('owns', 'located_in')) z WHERE s <> o)"""


@query(f"""WITH {_CASCADE} SELECT 'fact' AS kind, s AS entity, fact_id AS item FROM fa WHERE r = 1
UNION ALL SELECT DISTINCT 'alias', coalesce(survivor, entity_id), alias FROM aliases LEFT JOIN m ON source = entity_id WHERE entity_id LIKE 'S%'
UNION ALL SELECT DISTINCT 'memory', coalesce(survivor, entity_id), memory_id::VARCHAR FROM memory_entities LEFT JOIN m ON source = entity_id
UNION ALL SELECT 'event', coalesce(survivor, concat('S', user_id)), event_id::VARCHAR FROM events LEFT JOIN m ON source = concat('S', user_id)
UNION ALL SELECT DISTINCT 'same_as', least(coalesce(x.survivor, a), coalesce(y.survivor, b)), greatest(coalesce(x.survivor, a), coalesce(y.survivor, b)) FROM (SELECT DISTINCT concat('S', l_suppkey) AS a, concat('S', l_partkey) AS b FROM lineitem) l LEFT JOIN m x ON x.source = a LEFT JOIN m y ON y.source = b WHERE coalesce(x.survivor, a) <> coalesce(y.survivor, b)
UNION ALL SELECT 'history', survivor, source FROM m""")
def er19_cascade(t):
    """Each supplier merged into the next one of its nation: chains whose last one keeps everything of the others."""
    s = t.supplier.select("s_suppkey", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("next")).filter("next is not null")
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    events = t.events.select("event_id", name("user_id").alias("entity_id"))
    links = t.lineitem.select(name("l_suppkey").alias("a"), name("l_partkey").alias("b"))
    out = R.merge_cascade(s.select(name("s_suppkey").alias("source"), name("next").alias("survivor")), t.facts.filter("expired_at is null and predicate in ('owns', 'located_in')"), t.aliases.filter("entity_id like 'S%'"), t.memory_entities, events, links)
    rows = [("fact", "facts", "subject_id", "fact_id"), ("alias", "aliases", "entity_id", "alias"), ("memory", "memories", "entity_id", "memory_id"), ("event", "events", "entity_id", "event_id"), ("same_as", "same_as", "a", "b"), ("history", "history", "survivor", "source")]
    return reduce(DataFrame.unionAll, [out[frame].select(F.lit(kind).alias("kind"), F.col(entity).alias("entity"), F.col(item).cast("string").alias("item")) for kind, frame, entity, item in rows])


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def er20_same_as_links(t):
    return t.lineitem.filter("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query(f"WITH {_CANDIDATES}, d AS (SELECT a, b FROM ca WHERE s >= 0.6 AND right(a, 1) <> '7'), c AS (SELECT DISTINCT subject_id AS e FROM facts WHERE predicate = 'part_of') SELECT a, b, CASE WHEN d.a IS NOT NULL THEN 'resolved' WHEN s >= 0.7 THEN 'candidate' ELSE 'staging' END AS status, CASE WHEN d.a IS NOT NULL THEN CASE WHEN s >= 0.8 THEN 'merged' ELSE 'distinct' END END AS resolution, a IN (SELECT e FROM c) OR b IN (SELECT e FROM c) AS hazard FROM ca LEFT JOIN d USING (a, b)")
def er21_er22_resolve_candidates(t):
    """Decisions with a reason close candidates; nations, which part_of joins to regions, are hazards."""
    c = stash(_candidates(t))
    reason = F.when(F.right("a", F.lit(1)) == "7", " ").otherwise("same mentions")
    asked = c.filter("similarity >= 0.6").select("a", "b", F.when(F.col("similarity") >= 0.8, "merged").otherwise("distinct").alias("resolution"), reason.alias("reason"))
    cuts = t.facts.filter("predicate = 'part_of'").select(F.col("subject_id").alias("entity_id"))
    return R.resolve_candidates(c, asked, cuts)


@query("SELECT predicate, CASE predicate WHEN 'owns' THEN 'possesses' WHEN 'lives_in' THEN 'resides_in' ELSE predicate END AS canonical, count(*) AS n FROM facts GROUP BY 1, 2")
def on1_canonical_predicates(t):
    alias = t.spark.createDataFrame([("owns", "possesses"), ("lives_in", "resides_in")], "predicate string, c string")
    return t.facts.join(F.broadcast(alias), "predicate", "left").groupBy("predicate", F.coalesce("c", "predicate").alias("canonical")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'press' ELSE event_type END AS base, CASE event_type WHEN 'purchase' THEN 'past' ELSE 'current' END AS hint, count(*) AS n FROM events GROUP BY ALL")
def on2_tense_split(t):
    variants = t.spark.createDataFrame([("purchase", "buy", "past"), ("click", "press", "current")], "event_type string, b string, h string")
    met = t.events.join(F.broadcast(variants), "event_type", "left")
    return met.groupBy("event_type", F.coalesce("b", "event_type").alias("base"), F.coalesce("h", F.lit("current")).alias("hint")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS predicate, count(*) AS usage, count(DISTINCT p_brand) AS memories, CASE WHEN count(*) >= 3 THEN 'candidate' ELSE 'staging' END AS status FROM part GROUP BY 1")
def on3_stage_counters(t):
    g = t.part.groupBy(F.col("p_type").alias("predicate")).agg(F.count("*").alias("usage"), F.count_distinct("p_brand").alias("memories"))
    return g.withColumn("status", F.when(F.col("usage") >= 3, "candidate").otherwise("staging"))


@query("""WITH r AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < 20), s AS (SELECT vec_id, c, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, r WHERE vec_id >= 20), m AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c DESC) AS k FROM s)
SELECT vec_id, c AS nearest, s < 0.5 AS novel FROM m WHERE k = 1""")
def on4_nearest_canonical(t):
    e = t.embeddings
    registry = e.filter("vec_id < 20").select(F.col("vec_id").alias("c"), F.col("embedding").alias("e"))  # a registry of twenty
    s = e.filter("vec_id >= 20").join(F.broadcast(registry)).select("vec_id", F.struct(S.cosine(F.col("embedding"), F.col("e")).alias("s"), "c").alias("m"))
    return s.groupBy("vec_id").agg(F.max("m").alias("m")).select("vec_id", F.col("m.c").alias("nearest"), (F.col("m.s") < 0.5).alias("novel"))


_PAIRS = "p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS truth FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)"


def _pairs(t):
    """All pairs of vectors with a cosine of 0.3 or more."""
    return V.similar_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.3).select("a", "b")


@query(f"WITH {_PAIRS} SELECT a, b FROM p WHERE (a + b) % 5 <> 0")
def on5_synonym_pairs(t):
    p = _pairs(t)
    inverse = t.embeddings.select(F.col("vec_id").alias("a")).join(p, "a").filter("(a + b) % 5 = 0").select("a", "b")
    return p.join(inverse, ["a", "b"], "left_anti")


@query(f"WITH RECURSIVE {_PAIRS}, l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS root, a AS node FROM l UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def on6_threshold_groups(t):
    return connected_components(_pairs(t), "a", "b")


@query(f"""WITH RECURSIVE {_PAIRS}, l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS root, a AS node FROM l UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node), g AS (SELECT node, min(root) AS c FROM r GROUP BY 1), x AS (SELECT vec_id, label, coalesce(c, vec_id) AS c FROM embeddings LEFT JOIN g ON node = vec_id),
n AS (SELECT (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x GROUP BY c) q) AS guess, (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x GROUP BY label) q) AS truth, (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM x GROUP BY c, label) q) AS hits)
SELECT round(hits / guess, 6) AS precision, round(hits / truth, 6) AS recall, round(2 * hits / (guess + truth), 6) AS f1 FROM n""")
def on6_group_quality(t):
    """Pairwise precision, recall and F1 of the groups against labels, from the sizes of groups alone."""
    g = connected_components(_pairs(t), "a", "b").withColumnRenamed("node", "vec_id")
    x = t.embeddings.select("vec_id", "label").join(g, "vec_id", "left").select("label", F.coalesce("component", "vec_id").alias("c"))

    def pairs(*keys):
        k = F.col("k") * (F.col("k") - 1) / 2
        return x.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.sum(k).alias("n"))

    row = pairs("c").withColumnRenamed("n", "guess").crossJoin(pairs("label").withColumnRenamed("n", "truth")).crossJoin(pairs("c", "label").withColumnRenamed("n", "hits"))  # single rows
    return row.select(F.round(F.try_divide("hits", "guess"), 6).alias("precision"), F.round(F.try_divide("hits", "truth"), 6).alias("recall"), F.round(2 * F.col("hits") / (F.col("guess") + F.col("truth")), 6).alias("f1"))


@query("SELECT object_id AS subject_id, 'owned_by' AS predicate, subject_id AS object_id FROM facts WHERE predicate = 'owns' AND expired_at IS NULL")
def on7_inverse_view(t):
    inverse = t.spark.createDataFrame([("owns", "owned_by")], "predicate string, inv string")
    return BT.active(t.facts).join(F.broadcast(inverse), "predicate").select(F.col("object_id").alias("subject_id"), F.col("inv").alias("predicate"), F.col("subject_id").alias("object_id"))


@query("""WITH x AS (SELECT label, i, avg(e) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM embeddings) y GROUP BY 1, 2), m AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY 1)
SELECT (SELECT round(avg(1 - list_cosine_similarity(embedding::DOUBLE[], c)), 6) FROM embeddings JOIN m USING (label)) AS intra, (SELECT round(avg(1 - list_cosine_similarity(a.c, b.c)), 6) FROM m a JOIN m b ON a.label < b.label) AS inter""")
def agg16_cl3_cluster_distances(t):
    e = t.embeddings
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    intra = e.join(F.broadcast(c), "label").agg(F.round(F.avg(1 - S.cosine(F.col("embedding"), F.col("c"))), 6).alias("intra"))
    pairs = c.toDF("a", "ca").join(c.toDF("b", "cb"), F.col("a") < F.col("b"))  # one row a cluster on each side
    return intra.crossJoin(pairs.agg(F.round(F.avg(1 - S.cosine(F.col("ca"), F.col("cb"))), 6).alias("inter")))


@query(f"WITH {_CANDIDATES} SELECT a, b, round(s, 6) AS score FROM ca JOIN regions_of x ON x.entity_id = a JOIN regions_of y ON y.entity_id = b WHERE x.component <> y.component ORDER BY round(s, 9) DESC, a, b LIMIT 50")
def flt16_cross_component_page(t):
    c = _candidates(t).join(t.regions_of.toDF("a", "ca"), "a").join(t.regions_of.toDF("b", "cb"), "b").filter("ca <> cb")
    return TB.page(c, [F.round("similarity", 9).desc(), F.col("a"), F.col("b")], 50).select("a", "b", F.round("similarity", 6).alias("score"))


@query(f"WITH {_CANDIDATES}, x AS (SELECT a, b FROM ca WHERE s < 0.7) SELECT x.a, x.b, (SELECT string_agg(alias, ';' ORDER BY alias) FROM aliases WHERE entity_id = x.a) AS aliases_a, (SELECT string_agg(alias, ';' ORDER BY alias) FROM aliases WHERE entity_id = x.b) AS aliases_b FROM x")
def flt17_reconciliation_context(t):
    """Open candidates with all aliases of both sides."""
    names = t.aliases.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("alias")), ";").alias("n"))  # a few a name
    c = _candidates(t).filter("status = 'staging'").select("a", "b")
    return c.join(names.toDF("a", "aliases_a"), "a", "left").join(names.toDF("b", "aliases_b"), "b", "left")


@query("SELECT contradiction_id, kind, fact_a, fact_b FROM contradictions WHERE resolved_at IS NULL AND kind = 'opposing' AND detected_at >= TIMESTAMP '1997-01-01'")
def flt18_open_contradictions(t):
    """Contradictions by state, kind and date, each filter optional."""
    return TB.optional_filters(t.contradictions.filter("resolved_at is null"), {"kind": "opposing", "subject_id": None}, "detected_at", "1997-01-01").select("contradiction_id", "kind", "fact_a", "fact_b")


@query("SELECT DISTINCT p_brand AS pattern, l_suppkey AS entity FROM lineitem JOIN part ON p_partkey = l_partkey")
def flt24_patterns_of_entities(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pattern"))
    return t.lineitem.join(p, "l_partkey").select("pattern", F.col("l_suppkey").alias("entity")).distinct()


@query("""WITH c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id < b.doc_id), g AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id)
SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM g) AS truth, (SELECT count(*) FROM c JOIN g USING (a, b)) AS hits""")
def ev7_candidate_quality(t):
    """Pairs of one source and length against pairs of one text, counted from group sizes: no pair is made."""
    d = t.documents.select("source", "n_chars", F.xxhash64("text").alias("h"), F.md5(F.encode("text", "utf-8")).alias("m"))

    def pairs(name, *keys):
        known = d.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("k"))
        return known.agg(F.coalesce(F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long")), F.lit(0)).alias(name))

    return pairs("candidates", "source", "n_chars").crossJoin(pairs("truth", "h", "m")).crossJoin(pairs("hits", "source", "n_chars", "h", "m"))  # single rows


@query("""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text)) WHERE length(benchmark.text) > 0""")
def ev5_ev6_citation_hits(t):
    """Documents that hold a whole benchmark item."""
    return X.citations(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("""WITH t AS (SELECT entity_id, entity_type, lower(canonical_name) AS name FROM entities), x AS (SELECT concat(o.entity_id, 'x') AS guess, substr(lower(canonical_name), 1, 5) AS name, CASE entity_type WHEN 'place' THEN 'Country' WHEN 'company' THEN 'organization' WHEN 'person' THEN 'individual' ELSE 'tool' END AS kind FROM entities o WHERE entity_type = 'place')
SELECT guess, entity_id, CASE kind WHEN 'Country' THEN 'place' ELSE 'other' END = entity_type AS type_agrees FROM x JOIN t ON contains(t.name, x.name)""")
def ev6_entity_matches(t):
    """Guessed names found inside known ones, and whether the types agree under their common names."""
    guess = t.entities.filter("entity_type = 'place'").select(F.concat("entity_id", F.lit("x")).alias("guess"), F.substring(F.lower("canonical_name"), 1, 5).alias("name"), F.lit("Country").alias("kind"))
    known = t.entities.select("entity_id", "entity_type", F.lower("canonical_name").alias("full"))
    met = known.join(F.broadcast(guess), F.contains("full", F.col("name")))  # places are the nations and regions
    return met.select("guess", "entity_id", (R.entity_type(F.col("kind")) == R.entity_type(F.col("entity_type"))).alias("type_agrees"))


@query("SELECT entity_type, count(*) AS n, CASE entity_type WHEN 'company' THEN 'company' ELSE entity_type END AS common FROM (SELECT CASE entity_type WHEN 'company' THEN 'Organisation' WHEN 'person' THEN 'PEOPLE' WHEN 'project' THEN 'initiative' ELSE 'City' END AS given, entity_type FROM entities) x GROUP BY 1")
def fn22_entity_types(t):
    given = F.when(F.col("entity_type") == "company", "Organisation").when(F.col("entity_type") == "person", "PEOPLE").when(F.col("entity_type") == "project", "initiative").otherwise("City")
    return t.entities.withColumn("common", R.entity_type(given)).groupBy("entity_type", "common").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT p_type AS pa, p_brand AS m FROM part), x AS (SELECT a.pa, b.pa AS pb, count(*) AS k FROM p a JOIN p b ON a.m = b.m AND a.pa < b.pa GROUP BY 1, 2)
SELECT pa, pb, round(0.5 * k / 25 + 0.3 * CASE WHEN left(pa, 1) = left(pb, 1) THEN 1.0 ELSE 0.5 END + 0.1 * jaro_winkler_similarity(pa, pb) + 0.1 * CASE WHEN pa = 'LARGE' AND pb = 'PROMO' THEN 1 ELSE 0 END, 6) AS score FROM x""")
def fn21_predicate_likeness(t):
    """Part types as predicates; the share of brands that two have in common stands as their cosine."""
    p = t.part.select(F.col("p_type").alias("p"), F.col("p_brand").alias("m")).distinct()
    met = p.toDF("pa", "m").join(p.toDF("pb", "m"), "m").filter("pa < pb").groupBy("pa", "pb").agg((F.count("*") / 25).alias("cosine"))
    kind = lambda c: F.struct(F.substring(c, 1, 1).alias("s"), F.lit("thing").alias("o"))
    return R.predicate_likeness(met.withColumns({"type_a": kind("pa"), "type_b": kind("pb")}), {"PROMO": "LARGE"}).select("pa", "pb", F.round("score", 6).alias("score"))


_TWICE = "substr(verb, length(verb) - {0}, 1) = substr(verb, length(verb) - {0} - 1, 1) AND substr(verb, length(verb) - {0}, 1) NOT IN ('a', 'e', 'i', 'o', 'u')"
_E_ENDS = "ate ize ise ase ose use ive ave ove ure ire ore are age uge ige ude ide ade ete ite ute ine ace ice ple ble tle rce nce lve rse nse".split()


@query(f"""WITH i(verb, base) AS (VALUES {', '.join(f"('{f}', '{v}')" for f, v in S.IRREGULAR.items())}),
v AS (SELECT verb, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS verb FROM documents UNION ALL SELECT event_type FROM events UNION ALL SELECT unnest(string_split(predicate, '_')) FROM facts) x GROUP BY 1)
SELECT verb, coalesce(i.base, CASE WHEN verb LIKE '%ing' AND length(verb) > 4 THEN
  CASE WHEN length(verb) = 5 AND verb LIKE '%ying' THEN concat(left(verb, 1), 'ie') WHEN verb LIKE '%ying' THEN left(verb, -3) WHEN {_TWICE.format(3)} THEN left(verb, -4)
  WHEN length(verb) >= 6 AND contains('vtczgs', left(right(verb, 4), 1)) AND contains('aeiou', left(right(verb, 5), 1)) THEN concat(left(verb, -3), 'e') ELSE left(verb, -3) END
WHEN verb LIKE '%ed' AND length(verb) > 3 THEN CASE WHEN verb LIKE '%ied' AND length(verb) > 4 THEN concat(left(verb, -3), 'y') WHEN {_TWICE.format(2)} THEN left(verb, -3)
  WHEN left(right(verb, 4), 3) IN ({", ".join(f"'{e}'" for e in _E_ENDS)}) THEN left(verb, -1) ELSE left(verb, -2) END
WHEN verb LIKE '%s' AND length(verb) > 2 AND verb NOT LIKE '%ss' THEN CASE WHEN verb LIKE '%ies' AND length(verb) > 4 THEN concat(left(verb, -3), 'y')
  WHEN length(verb) > 3 AND (verb LIKE '%ches' OR verb LIKE '%shes' OR verb LIKE '%sses' OR verb LIKE '%xes' OR verb LIKE '%zes') THEN left(verb, -2) ELSE left(verb, -1) END
ELSE verb END) AS base, n FROM v LEFT JOIN i USING (verb)""")
def fn20_lemma(t):
    """Base forms of all lower-case words of the documents, of event types and of the words of predicates."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("verb"))
    words = words.union(t.events.select("event_type")).union(t.facts.select(F.explode(F.split("predicate", "_"))))
    return words.groupBy("verb").agg(F.count("*").alias("n")).select("verb", S.lemma(F.col("verb")).alias("base"), "n")


@query("SELECT user_id, CASE WHEN last < TIMESTAMP '2024-01-08' THEN 'due' ELSE 'fresh' END AS state FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) x")
def st8_patrol(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", F.when(F.col("last") < F.lit("2024-01-08").cast("timestamp"), "due").otherwise("fresh").alias("state"))


@query()
def cl1_cl4_density_clusters(t):
    """All vectors by density; their labels are not used."""
    return density_clusters(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
