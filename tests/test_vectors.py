import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoweave.operators import vectors as V


def test_a_pair_of_blocks_is_multiplied_in_bounded_memory():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(n, 8)) for n in (4096, 8192))
    asked, held = pd.DataFrame({"query_id": range(4096), "_a": list(a)}), pd.DataFrame({"id": range(8192), "_b": list(b)})
    tracemalloc.start()
    found = V.nearest_of_blocks(asked, held, 3, -1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000  # the whole product alone has 268 MB
    s = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert found["id"].tolist() == np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :3].ravel().tolist()


def test_nearest_with_many_ties(spark):
    """Copies of few vectors, zero and null ones: ties go to the smaller id."""
    base = np.random.default_rng(5).normal(size=(7, 4)).round(3)
    rows = [(i, base[i % 7].tolist()) for i in range(300)] + [(300, [0.0] * 4), (301, None), (302, [1.0, None, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    found = V.knn(v.withColumnRenamed("id", "query_id").filter("query_id < 20"), v, 9, block_rows=64).orderBy("query_id", "rank").collect()
    n = base / np.linalg.norm(base, axis=1)[:, None]
    s = np.round(n @ n.T, 12)
    for q in range(20):
        want = sorted(range(300), key=lambda i: (-s[q % 7, i % 7], i))[:9]
        assert [r["id"] for r in found if r["query_id"] == q] == want


def test_expansion_against_all_walks(spark):
    rng = np.random.default_rng(7)
    kinds = ["located_in", "part_of", "lives_in", "owns"]
    facts = [(f"f{i}", kinds[rng.integers(4)], f"v{rng.integers(30)}", f"v{rng.integers(30)}") for i in range(120)]
    anchors = [(q, f"v{rng.integers(32)}") for q in range(12) for _ in range(2)]
    weights = {"located_in": 1.0, "part_of": 0.8, "lives_in": 0.6}
    for depth, most in ((1, 4), (2, 5), (3, 6)):
        got = V.expand_anchors(spark.createDataFrame(anchors, "query_id long, entity_id string"), spark.createDataFrame(facts, "fact_id string, predicate string, subject_id string, object_id string"), weights, depth, most)
        want = []
        for q in range(12):
            best, front = {}, {e for x, e in anchors if x == q}
            for hop in range(1, depth + 1):
                met = [f for f in facts if f[2] in front or f[3] in front]
                for f in met:
                    best.setdefault((f[0], weights.get(f[1], 0.4)), hop)
                front = {f[3] for f in met if f[2] in front} | {f[2] for f in met if f[3] in front}
            want += [(q, *k, h) for k, h in sorted(best.items(), key=lambda x: (-x[0][1], x[1], x[0][0]))[:most]]
        assert sorted(map(tuple, got.select("query_id", "fact_id", "predicate_weight", "hop").collect())) == sorted(want)


def test_expansion_of_a_hub_is_done_once(spark):
    """Thousands of queries at a vertex of thousands of facts: a row for each of them would be 150 million."""
    facts = spark.range(30_000).select(F.concat(F.lit("f"), "id").alias("fact_id"), F.lit("lives_in").alias("predicate"), F.concat(F.lit("c"), "id").alias("subject_id"), F.lit("hub").alias("object_id"))
    anchors = spark.range(5_000).select(F.col("id").alias("query_id"), F.lit("hub").alias("entity_id"))
    began = time.monotonic()
    assert V.expand_anchors(anchors, facts, {"lives_in": 0.6}, 2, 20).count() == 100_000
    assert time.monotonic() - began < 60


def test_similar_pairs_against_all(spark):
    """Several blocks; null and zero vectors, an id twice."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 3))
    rows = [(f"v{i}", x.tolist()) for i, x in enumerate(base)] + [("zero", [0.0] * 3), ("null", None), ("v3", base[3].tolist())]
    found = [(r["a"], r["b"]) for r in V.similar_pairs(spark.createDataFrame(rows, "id string, vector array<double>"), 0.5, block_rows=40).collect()]
    n = base / np.linalg.norm(base, axis=1)[:, None]
    s = n @ n.T
    ids = [f"v{i}" for i in range(150)]
    want = [tuple(sorted((ids[i], ids[j]))) for i in range(150) for j in range(i) if s[i, j] >= 0.5]
    want += [tuple(sorted(("v3", ids[j]))) for j in range(150) if j != 3 and s[3, j] >= 0.5]
    assert sorted(found) == sorted(want)


def test_similar_pairs_leave_a_task_in_parts():
    """All 18 million pairs of a block are similar: as one frame they alone take 430 MB."""
    rows = pd.DataFrame({"id": range(6000), "vector": [np.array([1.0, 2.0])] * 6000, "_q": 0, "_r": 0})
    tracemalloc.start()
    found = sum(len(part) for part in V.pairs_of_blocks(iter([rows.assign(_side=0), rows.assign(_side=1)]), 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 6000 * 5999 // 2
    assert peak < 250_000_000
