"""Graphs, drift, embedding and streams with known answers."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import causal, graph, resolution, tables, temporal, vectors
from chronoweave.operators.clustering import cluster_stats, density_clusters
from chronoweave.operators.components import connected_components
from chronoweave.operators.text import paragraphs, sections, transcript_segments, units
from chronoweave.streaming import jobs


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(28)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(edges_of(spark, pairs)).collect()}
    assert found == {v: root(v) for v in parent}


def test_components_of_a_long_chain(spark):
    found = connected_components(edges_of(spark, [(i, i + 1) for i in range(100)])).collect()
    assert {r.component for r in found} == {0} and len(found) == 101


def test_core_numbers_of_a_clique_with_a_tail(spark):
    pairs = [*itertools.combinations(range(4), 2), (3, 4), (4, 5)]
    found = {r.v: r.core for r in graph.core_numbers(edges_of(spark, pairs)).collect()}
    assert found == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}


def test_core_numbers_of_a_long_path(spark):
    rows = [(str(i), str(i + 1), str(i), "k") for i in range(1000)]
    df = spark.createDataFrame(rows, "src string, dst string, edge_id string, kind string")
    found = graph.core_numbers(df)
    assert (found.count(), found.filter("core = 1").count()) == (1001, 1001)


def test_core_numbers_against_peeling(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    want, k, left = {}, 0, {v: list(n) for v, n in near.items()}
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        want[v] = k
        for u in left.pop(v):
            if u in left:
                left[u].remove(v)
    found = graph.core_numbers(spark.createDataFrame([(a, b, i, "k") for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_id long, kind string"))
    assert {r.v: r.core for r in found.collect()} == want


def test_communities_raise_modularity(spark):
    rng = random.Random(1)
    pairs = [(g * 8 + rng.randrange(8), g * 8 + rng.randrange(8)) for g in range(4) for _ in range(40)] + [(0, 8), (9, 16), (17, 24), (25, 1)]
    df = spark.createDataFrame([(a, b, i, "k") for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_id long, kind string")
    found = graph.communities(df)
    assert graph.modularity(df, found) > 0.6
    assert {r.v: r.community for r in found.collect()} == {v: v // 8 * 8 for v in {x for a, b in pairs if a != b for x in (a, b)}}


def test_pagerank_sums_to_one_and_favours_the_hub(spark):
    pairs = [(0, i) for i in range(1, 6)]
    vertices = spark.createDataFrame([(i,) for i in range(8)], "v long")
    found = {r.v: r.rank for r in graph.pagerank(edges_of(spark, pairs), vertices, rounds=30).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and max(found, key=found.get) == 0


def test_communities_split_two_triangles(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    found = {r.v: r.community for r in graph.communities(edges_of(spark, pairs)).collect()}
    assert len({found[v] for v in (0, 1, 2)}) == 1 and len({found[v] for v in (3, 4, 5)}) == 1 and found[0] != found[3]


def test_adwin_finds_a_step_and_is_silent_on_a_constant():
    step, flat = vectors.Adwin(), vectors.Adwin()
    assert any(step.add(0.1 if i < 100 else 0.9) for i in range(200))
    assert not any(flat.add(0.5) for _ in range(300))


def test_drift_changes_by_entity(spark):
    rows = [("a", i, 0.1 if i < 100 else 0.9) for i in range(200)] + [("b", i, 0.4) for i in range(200)]
    found = vectors.drift_changes(spark.createDataFrame(rows, "entity string, at long, value double")).collect()
    assert {r.entity for r in found} == {"a"}


def test_embed_column(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    found = vectors.embed_column(docs, lambda ts: np.array([[len(t)] * 4 for t in ts], np.float32), "text", "v", prefix="p: ", size=4).orderBy("id").collect()
    assert [r.v for r in found] == [[6.0] * 4, [3.0] * 4]


def test_trace_stops_in_a_cycle(spark):
    e = spark.createDataFrame([(1, 1, 2, 0.5, None), (2, 2, 3, 0.5, None), (3, 3, 1, 0.5, None)], "edge_id long, cause_event_id long, effect_event_id long, strength double, expired_at timestamp")
    found = causal.trace(e, spark.createDataFrame([(1,)], "event_id long"), 10, 0.0, False).collect()
    assert sorted((r.event_id, r.depth) for r in found) == [(2, 1), (3, 2)]


def test_reach_in_a_diamond(spark):
    e = spark.createDataFrame([(1, 1, 2, None), (2, 1, 3, None), (3, 2, 4, None), (4, 3, 4, None), (5, 4, 5, None)], "edge_id long, cause_event_id long, effect_event_id long, expired_at timestamp")
    found = causal.reach(e, spark.createDataFrame([(1, 1)], "root long, event_id long"), 3).collect()
    assert sorted((r.edge_id, r.depth) for r in found) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


def test_expire_keeps_what_is_expired(spark):
    f = spark.createDataFrame([("a", None), ("b", "2020-01-01 00:00:00")], "fact_id string, e string").select("fact_id", F.col("e").cast("timestamp").alias("expired_at"))
    q = spark.createDataFrame([("a", "2021-01-01", "x"), ("b", "2021-01-01", "x")], "fact_id string, at string, reason string").withColumn("at", F.col("at").cast("timestamp"))
    state, history = temporal.expire(f, q)
    assert {r.fact_id: r.expired_at.year for r in state.collect()} == {"a": 2021, "b": 2020}
    assert [r.fact_id for r in history.collect()] == ["a"]


def test_combined_score_is_null_aware(spark):
    row = spark.range(1).select(*[F.lit(1.0 if s == "facts" else None).cast("double").alias(s) for s in resolution.WEIGHTS])
    assert row.select(resolution.combined_score().alias("s")).first().s == pytest.approx(1.0)
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(s) for s in resolution.WEIGHTS])
    assert none.select(resolution.combined_score().alias("s")).first().s == 0


def test_units_reach_the_end(spark):
    docs = spark.createDataFrame([(1, "x" * 300), (2, "short"), (3, "")], "k long, t string")
    found = units(docs, "k", "t").orderBy("k", "unit").collect()
    assert [(r.k, r.start, r.end) for r in found] == [(1, 0, 128), (1, 64, 192), (1, 128, 256), (1, 192, 300), (2, 0, 5)]


def test_text_structure(spark):
    docs = spark.createDataFrame([(1, "# A\none\n## B\ntwo\nthree")], "k long, t string")
    assert [(r.heading, r.content) for r in sections(docs, "k", "t").orderBy("line").collect()] == [("A", "one"), ("B", "two"), ("B", "three")]
    said = spark.createDataFrame([(1, "Ann: hello\nno label\nBob: bye")], "k long, t string")
    assert [r.speaker for r in transcript_segments(said, "k", "t").orderBy("segment").collect()] == ["Ann", "Bob"]
    long = spark.createDataFrame([(1, "aaaa\nbbbb\ncccccccccccc\ndd")], "k long, t string")
    assert [r.content for r in paragraphs(long, "k", "t", 10, "\n", "\n").orderBy("piece").collect()] == ["aaaa\nbbbb", "bbbb\ncccccccccccc", "cccccccccccc\ndd"]


def test_json_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question_id": "q1", "question_type": "t", "question": "?", "answer": "!", "haystack_session_ids": ["s1"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": true}, {"role": "assistant", "content": "yo"}]]}]')
    assert [(r.session, r.turn, r.has_answer) for r in tables.read_question_sets(spark, str(tmp_path / "q.json")).orderBy("turn").collect()] == [("s1", 0, True), ("s1", 1, False)]
    lines = ['{"type": "user", "sessionId": "s", "timestamp": "1", "message": {"role": "user", "content": "old"}}', "broken", '{"type": "user", "sessionId": "s", "timestamp": "2", "message": {"role": "user", "content": "new"}}', '{"type": "assistant", "sessionId": "s", "timestamp": "3", "message": {"role": "assistant", "content": "answer"}}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert [tuple(r) for r in tables.read_transcripts(spark, str(tmp_path / "t.jsonl")).collect()] == [("s", "new", "answer")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(120)], "id long")
    rows.repartition(3).write.parquet(str(tmp_path / "facts"))
    called = []
    stream = jobs.read_folder(spark, str(tmp_path / "facts"), rows.schema, 1)
    ledger = str(tmp_path / "ledger")
    jobs.due_recomputes(stream, {"topology": 100, "stats": 20}, lambda kind, n: called.append(kind), ledger, str(tmp_path / "c")).awaitTermination()
    assert "stats" in called and "topology" in called
    turns = spark.createDataFrame([(1, "user"), (1, "user"), (1, "assistant"), (2, "system")], "conv_id long, role string")
    turns.write.parquet(str(tmp_path / "turns"))
    found = jobs.new_speakers(jobs.read_folder(spark, str(tmp_path / "turns"), turns.schema))
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_counts_outlive_a_restart(spark, tmp_path):
    """40 facts before a restart and 70 after it reach a threshold of 100 that neither run reaches alone."""
    called, folder = [], str(tmp_path / "facts")
    for n in (40, 70):
        spark.range(n).repartition(1).write.mode("append").parquet(folder)
        stream = jobs.read_folder(spark, folder, spark.range(1).schema)
        jobs.due_recomputes(stream, {"topology": 100}, lambda kind, n: called.append((kind, n)), str(tmp_path / "ledger"), str(tmp_path / "c")).awaitTermination()
    assert called == [("topology", 110)]


def test_every_n_runs_outlive_a_restart(spark, tmp_path):
    called, folder = [], str(tmp_path / "facts")
    for at in range(6):
        spark.range(3).repartition(1).write.mode("append").parquet(folder)
        stream = jobs.read_folder(spark, folder, spark.range(1).schema)
        jobs.every_n_runs(stream, {"gardener": 2, "decay": 3}, lambda kind, run: called.append((kind, run)), str(tmp_path / "ledger"), str(tmp_path / "c"), cooldown=0).awaitTermination()
    assert called == [("gardener", 2), ("decay", 3), ("gardener", 4), ("gardener", 6), ("decay", 6)]


def test_drift_stream_keeps_state_and_resets(spark, tmp_path):
    schema, folder = "entity string, cluster string, at long, value double", str(tmp_path / "seen")
    found = []
    for first, value in ((0, 0.1), (60, 0.9)):
        rows = [(e, "c1" if e == "a" or first == 0 else "c2", i, value) for e in ("a", "b") for i in range(first, first + 60)]
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(folder)
        stream = jobs.read_folder(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.drift_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        found.append({(r.entity, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert found == [set(), {("a", "change"), ("b", "reset")}]


def test_supersession_on_arrival(spark, tmp_path):
    """A back-dated fact that overlaps nothing supersedes nothing; one that overlaps expires what is there."""
    schema = "fact_id string, subject_id string, predicate string, object_id string, object_value string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp, confidence double"
    row = lambda i, o, start, end, made: f"('{i}', 's', 'lives_in', '{o}', null, timestamp '{start}', {end and f"timestamp '{end}'" or 'null'}, timestamp '{made}', null, 0.5D)"
    folder, store = str(tmp_path / "facts"), str(tmp_path / "store")
    registry = spark.createDataFrame([("lives_in", True)], "predicate string, is_exclusive boolean")
    for values in (row("f1", "paris", "2020-01-01", None, "2024-01-01"), row("f2", "rome", "2010-01-01", "2015-01-01", "2024-01-02"), row("f3", "oslo", "2021-01-01", None, "2024-01-03") + ", " + row("f4", "oslo", "2021-01-01", None, "2024-01-04")):
        names = [c.split()[0] for c in schema.split(", ")]
        spark.sql(f"select * from values {values} as t({', '.join(names)})").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).repartition(1).write.mode("append").parquet(folder)
        stream = jobs.read_folder(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.supersede(stream, registry, store, str(tmp_path / "c")).awaitTermination()
    state = {r.fact_id: r.expired_at is None for r in jobs.latest_version(spark, store).collect()}
    assert state == {"f1": False, "f2": True, "f3": True}


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    middles = np.eye(8)[:3]
    rows = [(g * 100 + i, [float(x) for x in middles[g] + rng.normal(0, 0.05, 8)]) for g, n in enumerate((30, 20, 12)) for i in range(n)]
    rows += [(900 + i, [float(x) for x in v]) for i, v in enumerate(np.eye(8)[5:] - 0.3)] + [(990, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = {r.id: r for r in density_clusters(df).collect()}
    assert len(found) == len(rows) and found[990].cluster == -1
    for g, n in enumerate((30, 20, 12)):
        mine = [found[g * 100 + i].cluster for i in range(n)]
        assert max(mine.count(c) for c in set(mine) - {-1}) >= 0.9 * n
    heads = [max(set(m), key=m.count) for m in ([found[g * 100 + i].cluster for i in range(n)] for g, n in enumerate((30, 20, 12)))]
    assert sorted(heads) == [0, 1, 2] and all(0 <= r.probability <= 1 for r in found.values())
    few = density_clusters(df.limit(3))
    assert [r.cluster for r in few.collect()] == [-1] * 3 and density_clusters(df.limit(0)).count() == 0
    stats = cluster_stats(spark.createDataFrame([(7,)], "entities long"), spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "id long, cluster int")).first()
    assert (stats.entities, stats.clusters, stats.noise) == (7, 1, 1)


def test_names_and_weights(spark):
    assert resolution.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert resolution.jaro_winkler("", "x") == 0 and resolution.jaro_winkler("a", "a") == 1
    w = resolution.cross_weights({"role": 0.6})
    assert w["signature"] == pytest.approx(0.6 / 1.4) and w["centroid"] == resolution.WEIGHTS["centroid"]
    near_zero = {k: 0.0 for k in resolution.CROSS_WEIGHTS}
    assert resolution.cross_weights(near_zero)["cluster"] == 0
    text = spark.createDataFrame([("a </Summary> b", 'x "y" <z>')], "t string, a string")
    from chronoweave.functions import scalar

    assert text.select(scalar.delimited(F.col("t"), "summary", {"src": F.col("a")}).alias("d")).first().d == '<summary len="15" src="x &quot;y&quot; &lt;z&gt;">a </S​ummary> b</summary>'
    assert [r.d for r in spark.createDataFrame([("Budget is 5k",), ("nothing",)], "t string").select(scalar.slot_value(F.col("t")).alias("d")).collect()] == [("budget", "5k"), None]


def test_full_snapshot_of_two_triangles(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_id long")
    got = {r.v: r for r in graph.full_snapshot(df, spark.createDataFrame([(i,) for i in range(7)], "v long")).collect()}
    assert [got[v].community for v in range(7)] == [0, 0, 0, 3, 3, 3, 6]
    assert [got[v].is_cut for v in range(7)] == [False, False, True, True, False, False, False]
    assert got[2].participation == pytest.approx(1 - (4 + 1) / 9) and got[0].participation == 0 and got[6].participation is None
    # 2 lies between {0, 1} and {3, 4, 5}: 6 of the 15 pairs of the six other vertices' ordered halves
    assert got[2].betweenness == pytest.approx(got[3].betweenness) and got[2].betweenness > 0 and got[0].betweenness == got[6].betweenness == 0


def test_a_community_in_two_parts_is_parted(spark):
    groups = spark.createDataFrame([(v, 9 if v != 2 else 2) for v in range(5)], "v long, community long")
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {r.v: r.community for r in graph.connected_parts(df, groups).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
