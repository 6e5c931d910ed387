"""Topology, vectors, drift and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import graph as G
from chronoweave.operators import vectors as V
from chronoweave.operators.components import connected_components
from chronoweave.operators.blocks import bridges, cut_vertices
from chronoweave.operators.intervals import numbered
from chronoweave.operators.graph_cuts import betweenness, sampled_sources
from chronoweave.plans.stash import shared_dir, stash
from chronoweave.registry import query
from chronoweave.streaming import jobs


def _edges(t):
    return G.entity_edges(t.facts)


def _vertices(t):
    return t.entities.select(F.col("entity_id").alias("v"))


def _places(t):
    """The edges of three kinds: what a caller who names edge types asks for."""
    return G.entity_edges(t.facts.filter("predicate in ('lives_in', 'located_in', 'part_of')"))


_E = "e AS MATERIALIZED (SELECT subject_id AS src, object_id AS dst, fact_id AS edge_id FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL AND object_id <> subject_id), b AS MATERIALIZED (SELECT src, dst, edge_id FROM e UNION ALL SELECT dst, src, edge_id FROM e)"
_PLACES = _E.replace("object_id <> subject_id)", "object_id <> subject_id AND predicate IN ('lives_in', 'located_in', 'part_of'))")
#: Rounds of spreading the smallest label, more than the longest shortest path in the test tables.
_LABELS = "l0 AS (SELECT DISTINCT src AS v, src AS c FROM b), " + ", ".join(f"l{i} AS MATERIALIZED (SELECT v, min(c) AS c FROM (SELECT v, c FROM l{i - 1} UNION ALL SELECT b.dst, c FROM l{i - 1} JOIN b ON b.src = v) x GROUP BY v)" for i in range(1, 13))


@query(f"WITH {_E}, {_LABELS} SELECT v AS node, c AS component FROM l12")
def gr1_components(t):
    return connected_components(_edges(t))


@query()
def gr2_core_numbers(t):
    return G.core_numbers(_edges(t))


@query(f"WITH {_E}, k AS (SELECT src AS v, substr(dst, 1, 2) AS g, count(*) AS k FROM b GROUP BY 1, 2) SELECT v, round(1 - sum(k * k)::DOUBLE / (sum(k) * sum(k)), 9) AS p FROM k GROUP BY 1 UNION ALL SELECT entity_id, NULL FROM entities WHERE entity_id NOT IN (SELECT src FROM b)")
def gr6_participation(t):
    groups = _vertices(t).withColumn("g", F.substring("v", 1, 2))
    return G.participation(_edges(t), groups).withColumn("p", F.round("p", 9))


_RANKS = f"{_E}, d AS MATERIALIZED (SELECT entity_id AS v, count(b.src) AS d FROM entities LEFT JOIN b ON b.src = entity_id GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM d), r0 AS (SELECT v, 1 / (SELECT n FROM n) AS r FROM d), " + ", ".join(
    f"r{i} AS MATERIALIZED (SELECT d.v, 0.15 / (SELECT n FROM n) + 0.85 * (coalesce(f.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} JOIN d USING (v) WHERE d.d = 0) / (SELECT n FROM n)) AS r FROM d LEFT JOIN (SELECT b.dst AS v, sum(r / d.d) AS s FROM r{i - 1} JOIN d USING (v) JOIN b ON b.src = v GROUP BY 1) f ON f.v = d.v)"
    for i in range(1, 13)
)


@query(f"WITH {_RANKS} SELECT v, round(r, 9) AS rank FROM r12")
def gr7_pagerank(t):
    """Twelve rounds; without a number they go on until ranks settle."""
    return G.pagerank(_edges(t), _vertices(t), rounds=12).select("v", F.round("rank", 9).alias("rank"))


@query()
def gr5_communities(t):
    return G.communities(_edges(t))


@query(f"""WITH {_E}, a AS MATERIALIZED (SELECT DISTINCT src, dst FROM b), h1 AS (SELECT entity_id AS seed, dst AS v FROM entities JOIN a ON src = entity_id WHERE entity_type = 'company'), h2 AS (SELECT DISTINCT seed, dst AS v FROM h1 JOIN a ON src = v), u AS (SELECT seed, v, 1 AS h FROM h1 UNION ALL SELECT seed, v, 2 FROM h2)
SELECT seed, v, min(h) AS hop FROM u WHERE seed <> v GROUP BY 1, 2""")
def gr10_hops(t):
    return G.hops(_edges(t), t.entities.filter("entity_type = 'company'").select(F.col("entity_id").alias("seed")), 2)


@query(f"""WITH {_PLACES}, p AS (SELECT x.src AS a, z.dst AS b, concat(x.edge_id, ',', y.edge_id, ',', z.edge_id) AS path FROM b x JOIN b y ON y.src = x.dst AND y.edge_id <> x.edge_id JOIN b z ON z.src = y.dst AND z.edge_id NOT IN (x.edge_id, y.edge_id)
WHERE x.src = 'S1' AND z.dst IN ('R0', 'R1', 'R2') UNION ALL SELECT x.src, y.dst, concat(x.edge_id, ',', y.edge_id) FROM b x JOIN b y ON y.src = x.dst AND y.edge_id <> x.edge_id WHERE x.src = 'S1' AND y.dst IN ('R0', 'R1', 'R2'))
SELECT a, b, path FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(string_split(path, ',')), path) AS r FROM p) x WHERE r <= 10""")
def gr11_join9_paths(t):
    pairs = t.spark.createDataFrame([("S1", "R0"), ("S1", "R1"), ("S1", "R2")], "a string, b string")
    return G.paths(_places(t), pairs, 3, 10)


@query(f"WITH {_E}, n AS MATERIALIZED (SELECT 'N3' AS v UNION SELECT dst FROM b WHERE src = 'N3') SELECT src, dst, edge_id FROM e JOIN n x ON x.v = e.src JOIN n y ON y.v = e.dst")
def gr12_subgraph(t):
    seeds = t.spark.createDataFrame([("N3",)], "seed string")
    return G.subgraph(_edges(t), seeds, 1).select("src", "dst", "edge_id")


@query(f"WITH {_E} SELECT entity_id AS v, count(b.src) AS degree FROM entities LEFT JOIN b ON b.src = entity_id GROUP BY 1")
def gr13_degrees(t):
    return G.degrees(_edges(t), _vertices(t))


@query(f"""WITH {_E}, {_LABELS}, d AS (SELECT entity_id AS v, count(b.src) AS degree FROM entities LEFT JOIN b ON b.src = entity_id GROUP BY 1), h AS (SELECT v, row_number() OVER (ORDER BY degree DESC, v) AS r FROM d), m AS (SELECT c FROM l12 GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
SELECT d.v, degree, CASE WHEN degree = 0 THEN 'isolate' WHEN l12.c <> (SELECT c FROM m) THEN 'island' WHEN r <= 10 THEN 'hub' WHEN degree <= 2 THEN 'leaf' ELSE 'inner' END AS kind FROM d JOIN h USING (v) LEFT JOIN l12 ON l12.v = d.v""")
def gr14_topology_findings(t):
    return G.topology_findings(_edges(t), _vertices(t))


@query(f"""WITH {_RANKS}, {_LABELS}, z AS (SELECT c, count(*) AS size FROM l12 GROUP BY 1)
SELECT d.v, l12.c AS component, coalesce(z.size, 1) AS component_size, d.d AS degree, round(r, 9) AS pagerank FROM d JOIN r12 USING (v) LEFT JOIN l12 USING (v) LEFT JOIN z ON z.c = l12.c""")
def gr9_snapshot(t):
    """A row an entity of the measures that SQL can follow; ``gr9_full_snapshot`` has the others."""
    found = G.topology_snapshot(_edges(t), _vertices(t), rounds=12, core=False)
    return found.select("v", "component", "component_size", "degree", F.round("pagerank", 9).alias("pagerank"))


@query()
def gr9_full_snapshot(t):
    return G.full_snapshot(_edges(t), _vertices(t), rounds=12)


@query(f"WITH {_E}, {_LABELS}, z AS (SELECT c, count(*) AS size FROM l12 GROUP BY 1) SELECT c AS component, size, v FROM l12 JOIN z USING (c) WHERE size <= 500 OR substr(v, 1, 1) = 'R'")
def flt21_component_members(t):
    found = connected_components(_edges(t)).toDF("v", "component")
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(size, "component").filter("size <= 500 or v like 'R%'").select("component", "size", "v")


@query(f"SELECT kind, id, src, dst FROM (SELECT 'fact' AS kind, fact_id AS id, subject_id AS src, object_id AS dst FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL AND object_id <> subject_id UNION ALL SELECT 'same_as', concat('sa', a.c_custkey), concat('C', a.c_custkey), concat('S', b.s_suppkey) FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND a.c_custkey = b.s_suppkey) x")
def set2_all_edges(t):
    """Facts and same-as links as one edge list."""
    links = t.customer.join(t.supplier, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") == F.col("s_suppkey")))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = links.select(F.lit("same_as").alias("kind"), name("sa", "c_custkey").alias("id"), name("C", "c_custkey").alias("src"), name("S", "s_suppkey").alias("dst"))
    return G.all_edges(_edges(t).select(F.col("edge_id").alias("id"), "src", "dst"), links.select("id", "src", "dst"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec1_fn5_cosine(t):
    e = t.embeddings
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, "a").select("a", "b", F.round(S.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


_KNN = "k AS MATERIALIZED (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings v)"


def _hits(t, k=10):
    """The stated queries, ids divisible by 20, against all vectors."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.knn(v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), v, k)


@query(f"WITH {_KNN} SELECT query_id, id, rank, round(s, 6) AS similarity FROM k WHERE rank <= 10")
def vec2_top1_knn(t):
    return _hits(t).withColumn("similarity", F.round("similarity", 6))


@query("""WITH x AS (SELECT label, i, avg(e) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM embeddings) y GROUP BY 1, 2), m AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY 1),
s AS (SELECT vec_id, m.label AS nearest, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], m.c), 12) DESC, m.label) AS r FROM embeddings JOIN m ON m.label <> embeddings.label) SELECT vec_id, nearest FROM s WHERE r = 1""")
def vec5_dr3_nearest_other_cluster(t):
    e = t.embeddings
    own = e.select(F.col("vec_id").alias("query_id"), "label")
    met = V.knn(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), V.centroids(e, "label", "embedding").toDF("id", "vector"), 2)
    other = met.join(own, "query_id").filter("id <> label")
    return other.groupBy(F.col("query_id").alias("vec_id")).agg(F.min_by("id", "rank").alias("nearest"))


@query("SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings")
def vec7_dimension_check(t):
    return t.embeddings.select("vec_id", (F.size("embedding") == 64).alias("fits"))


@query("SELECT a.vec_id AS entity, round(greatest(0.0, least(1.0, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS drift, CASE WHEN 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3 THEN 'reconcile' ELSE 'none' END AS action FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dr1_drift_magnitude(t):
    kept = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("kept"))
    d = V.drift_magnitude(F.col("embedding"), F.col("kept"))
    met = t.embeddings.join(kept, "vec_id").withColumn("d", d)
    return met.select(F.col("vec_id").alias("entity"), F.round("d", 6).alias("drift"), F.when(F.col("d") >= 0.3, "reconcile").otherwise("none").alias("action"))


def hourly_sweeps(t):
    """(entity, cluster, at, value): hourly means of each event type, raised by 0.3 from the middle of the time on."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = t.events.groupBy(F.col("event_type").alias("entity"), hour.alias("at")).agg(F.least(F.lit(0.7), F.avg("value") / 200).alias("value"))
    span = rows.agg(((F.min("at") + F.max("at")) / 2).alias("middle"))  # one row
    return rows.crossJoin(F.broadcast(span)).select("entity", F.lit("a").alias("cluster"), "at", (F.col("value") + F.when(F.col("at") >= F.col("middle"), 0.3).otherwise(0.0)).alias("value"), (F.col("at") >= F.col("middle")).alias("late"))


@query()
def dr2_drift_changes(t):
    """The mean of every event type shifts once; a row for each sweep that finds it."""
    return V.drift_changes(hourly_sweeps(t))


@query()
def st4_drift_stream(t):
    """The same sweeps as a stream that is stopped in the middle: windows go on from their state."""
    rows, base = hourly_sweeps(t).drop("late"), f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    halves = stash(hourly_sweeps(t))
    for late in (False, True):
        halves.filter(F.col("late") == late).drop("late").write.mode("append").parquet(f"{base}/in")
        found = jobs.drift_stream(jobs.read_folder(t.spark, f"{base}/in", rows.schema, 1000))
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{base}/out")


@query(f"WITH {_KNN} SELECT query_id, id // 5 AS parent, round(max(s), 6) AS score, count(*) AS units FROM k WHERE rank <= 25 GROUP BY 1, 2")
def rt1_unit_search(t):
    units = t.embeddings.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("parent"))
    return V.unit_hits(_hits(t, 25), units).withColumn("score", F.round("score", 6))


@query(f"WITH {_KNN} SELECT query_id, max(s) < 0.5 AS failed FROM k WHERE rank <= 10 AND query_id <> id GROUP BY 1")
def rt2_retrieval_failed(t):
    return _hits(t).filter("query_id <> id").groupBy("query_id").agg((F.max("similarity") < 0.5).alias("failed"))


@query(f"WITH {_KNN} SELECT query_id, entity_id FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), entity_id) AS r FROM k JOIN memory_entities ON memory_id = id WHERE rank <= 10 GROUP BY 1, 2) x WHERE r <= 5")
def rt3_rt7_anchors(t):
    met = _hits(t).join(t.memory_entities.withColumnRenamed("memory_id", "id"), "id").groupBy("query_id", "entity_id").agg(F.min("rank").alias("best"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "entity_id"))
    return met.withColumn("r", r).filter("r <= 5").select("query_id", "entity_id")


_ANCHORS = "n AS (SELECT query_id, entity_id FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), entity_id) AS r FROM k JOIN memory_entities ON memory_id = id WHERE rank <= 10 GROUP BY 1, 2) x WHERE r <= 5)"
_WEIGHT = "CASE predicate WHEN 'located_in' THEN 1.0 WHEN 'part_of' THEN 0.8 WHEN 'lives_in' THEN 0.6 ELSE 0.4 END"
_EXPAND = f"""{_ANCHORS}, p AS MATERIALIZED (SELECT fact_id, predicate, subject_id AS s, object_id AS o FROM facts WHERE expired_at IS NULL AND predicate IN ('located_in', 'part_of', 'lives_in')), w AS (SELECT fact_id, predicate, s AS v, o AS u FROM p UNION ALL SELECT fact_id, predicate, o, s FROM p),
h AS (SELECT query_id, w.fact_id, w.predicate, w.u, 1 AS hop FROM n JOIN w ON w.v = entity_id), g AS (SELECT query_id, fact_id, predicate, hop FROM h UNION ALL SELECT h.query_id, w.fact_id, w.predicate, 2 FROM h JOIN w ON w.v = h.u),
x AS (SELECT query_id, fact_id, predicate, min(hop) AS hop FROM g GROUP BY 1, 2, 3), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_WEIGHT} DESC, hop, fact_id) AS r FROM x), c AS (SELECT query_id, max(s) AS s FROM k WHERE rank <= 10 AND query_id <> id GROUP BY 1)"""
WEIGHTS = {"located_in": 1.0, "part_of": 0.8, "lives_in": 0.6}


def _anchors(hits, t):
    met = hits.join(t.memory_entities.withColumnRenamed("memory_id", "id"), "id").groupBy("query_id", "entity_id").agg(F.min("rank").alias("best"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "entity_id"))
    return met.withColumn("r", r).filter("r <= 5").select("query_id", "entity_id")


def _evidence(hits, t):
    """Facts within two steps of the anchors of each query, re-ranked with the similarity of its best other memory."""
    facts = t.facts.filter("expired_at is null").filter(F.col("predicate").isin(list(WEIGHTS)))
    found = V.expand_anchors(_anchors(hits, t), facts, WEIGHTS, 2, 20)
    best = hits.filter("query_id <> id").groupBy("query_id").agg(F.max("similarity").alias("similarity"))
    return V.rerank(found.join(best, "query_id", "left"))


@query(f"WITH {_KNN}, {_EXPAND} SELECT query_id, fact_id, hop, round(0.7 * coalesce(c.s, 0) + 0.2 * {_WEIGHT} + 0.1 / hop, 6) AS score FROM y LEFT JOIN c USING (query_id) WHERE r <= 20")
def rt4_rt5_rerank(t):
    return _evidence(_hits(t), t).select("query_id", "fact_id", "hop", F.round("score", 6).alias("score"))


@query(f"WITH {_KNN}, {_EXPAND}, f AS (SELECT query_id FROM c WHERE s < 0.6) SELECT query_id, count(*) AS facts, max(round(0.7 * coalesce(c.s, 0) + 0.2 * {_WEIGHT} + 0.1 / hop, 6)) AS best FROM y JOIN f USING (query_id) LEFT JOIN c USING (query_id) WHERE r <= 20 GROUP BY 1")
def rt8_fallback_evidence(t):
    """Queries whose flat retrieval fails go on to the graph; the others give nothing."""
    hits = _hits(t)
    failed = V.retrieval_failed(hits.filter("query_id <> id"), 0.6).filter("failed").select("query_id")
    found = _evidence(hits.join(failed, "query_id", "left_semi"), t)
    return found.groupBy("query_id").agg(F.count("*").alias("facts"), F.max(F.round("score", 6)).alias("best"))


@query(f"""WITH {_KNN}, a AS (SELECT query_id, entity_id FROM k JOIN memory_entities ON memory_id = id WHERE rank <= 3 GROUP BY 1, 2), p AS MATERIALIZED (SELECT subject_id AS s, object_id AS o FROM facts WHERE expired_at IS NULL AND predicate IN ('located_in', 'part_of')), w AS (SELECT s AS v, o AS u FROM p UNION ALL SELECT o, s FROM p)
SELECT query_id, count(DISTINCT memory_id) AS memories FROM a JOIN w ON w.v = a.entity_id JOIN memory_entities m ON m.entity_id = w.u GROUP BY 1""")
def rt7_neighbour_memories(t):
    """Memories of the graph neighbours of each query's entities."""
    a = _hits(t, 3).join(t.memory_entities.withColumnRenamed("memory_id", "id"), "id").select("query_id", F.col("entity_id").alias("src")).distinct()
    arcs = G.both_ways(G.entity_edges(t.facts.filter("predicate in ('located_in', 'part_of')")))
    near = a.join(arcs, "src").select("query_id", F.col("dst").alias("entity_id")).distinct()
    return near.join(t.memory_entities, "entity_id").groupBy("query_id").agg(F.count_distinct("memory_id").alias("memories"))


@query(f"""WITH {_KNN}, z AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(v.vec_id - q.vec_id), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0),
l AS (SELECT query_id, id, rank, 1.0 AS w FROM k WHERE rank <= 10 UNION ALL SELECT query_id, id, rank, 0.5 FROM z WHERE rank <= 10) SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2""")
def rt6_fusion(t):
    """The vector list and a keyword list: of the same label, the nearest by date of entry."""
    e = t.embeddings.select("vec_id", "label")
    placed = stash(numbered(e, ["label", "vec_id"], {"n": F.lit(1)}))  # the 10 nearest of a label are within 10 places
    q = placed.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.explode(F.sequence(F.col("n") - 10, F.col("n") + 10)).alias("n"))
    near = q.join(placed, ["label", "n"]).withColumn("gap", F.abs(F.col("vec_id") - F.col("query_id")))
    words = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "vec_id"))).filter("rank <= 10").select("query_id", F.col("vec_id").alias("id"), "rank")
    both = _hits(t).select("query_id", "id", "rank").withColumn("weight", F.lit(1.0)).unionByName(words.withColumn("weight", F.lit(0.5)))
    return V.fuse(both).withColumn("score", F.round("score", 9))


@query()
def gr4_bridges(t):
    return bridges(_edges(t))


@query()
def gr3_cut_vertices(t):
    return cut_vertices(_edges(t))


@query()
def gr8_betweenness(t):
    """From 500 sources by a hash, or from all of up to 200 vertices."""
    return betweenness(_edges(t), sampled_sources(_vertices(t)), normalised=True)


@query("""WITH x AS (SELECT label, i, avg(e) AS c FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM embeddings) y GROUP BY 1, 2), m AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY 1), s AS (SELECT embeddings.vec_id, embeddings.label, m.label AS target, 1 - list_cosine_similarity(embedding::DOUBLE[], m.c) AS away, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], m.c), 12) DESC, m.label) AS r FROM embeddings JOIN m ON m.label <> embeddings.label), o AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], m.c) AS own FROM embeddings JOIN m USING (label))
SELECT vec_id AS entity, target, round(greatest(0.0, least(1.0, own)), 6) AS magnitude, CASE WHEN own >= 0.3 THEN 'reconcile' ELSE 'none' END AS action FROM s JOIN o USING (vec_id) WHERE r = 1 AND own > 0.2""")
def dr3_drift_events(t):
    """An event for every vector that lies far from its cluster's mean, with the nearest other cluster as target."""
    e = t.embeddings
    means = V.centroids(e, "label", "embedding")
    met = V.knn(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), means.toDF("id", "vector"), 2)
    target = met.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").filter("id <> label").groupBy(F.col("query_id").alias("vec_id")).agg(F.min_by("id", "rank").alias("target"))
    own = e.join(means, "label").withColumn("magnitude", V.drift_magnitude(F.col("embedding"), F.col("centre")))
    return V.drift_events(own.filter("magnitude > 0.2").select(F.col("vec_id").alias("entity"), F.round("magnitude", 6).alias("magnitude"), "vec_id").join(target, "vec_id").drop("vec_id"))


@query("""WITH r AS (SELECT user_id AS entity, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' WHEN attempt >= 3 THEN 'exhausted' ELSE 'retry' END AS state FROM r WHERE attempt <= 3""")
def dr4_pending_outcomes(t):
    """Drift events still to be worked on, and what an attempt's outcome makes of them."""
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = t.events.withColumn("attempts", attempt - 1)
    code = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "purchase", 200).otherwise(503)
    asked = V.pending_drift(rows.withColumn("run_id", F.lit(None).cast("string"))).withColumn("code", code)
    return V.drift_outcomes(asked).select("event_id", "state")


@query("SELECT user_id AS entity, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'error') x WHERE r <= 5")
def flt22_drift_events_of(t):
    """The newest drift events of every entity."""
    return V.newest(t.events.filter("event_type = 'error'").select(F.col("user_id").alias("entity"), "event_id", F.col("ts").alias("at")), 5).select("entity", "event_id")


@query("""WITH s AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5(concat(vec_id, '-7')), vec_id) AS r FROM embeddings), z AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5(concat(vec_id, '-8')), vec_id) AS r FROM embeddings)
SELECT count(*) AS pairs, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean, round(quantile_cont(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.1), 6) AS p10, round(quantile_cont(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.9), 6) AS p90 FROM s a JOIN z b ON a.vec_id <> b.vec_id WHERE a.r <= 100 AND b.r <= 100""")
def join7_top4_similarity_sample(t):
    """The spread of similarity between two seeded samples of a hundred vectors."""
    v = t.embeddings.select("vec_id", "embedding")
    return V.similarity_spread(V.seeded_sample(v, "vec_id", 100, 7), V.seeded_sample(v, "vec_id", 100, 8), "vec_id", "embedding")


@query("SELECT src, dst, edge_id FROM (SELECT subject_id AS src, object_id AS dst, fact_id AS edge_id, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, fact_id) AS r FROM facts WHERE expired_at IS NULL AND object_id IS NOT NULL AND object_id <> subject_id) x WHERE r <= 50")
def top5_capped_walk(t):
    """At most fifty steps out of a vertex, the strongest first."""
    f = t.facts.filter("expired_at is null and object_id is not null and object_id <> subject_id")
    return G.capped(f.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("fact_id").alias("edge_id"), "confidence"), "src", [F.desc("confidence"), F.col("edge_id")], 50).select("src", "dst", "edge_id")
