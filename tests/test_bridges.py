"""Pairs across components: rules, the best pairs and drift-driven pairs against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import bridges as B

TOPOLOGY = "entity_id string, component long, component_size long, k_core int"


def people(spark, n, seed, clusters=3, components=4, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[: n // 4] = x[0]  # ties
    rows = [(f"e{i:04}", int(rng.integers(components)), int(rng.integers(clusters)), [float(v) for v in x[i]]) for i in range(n)]
    rows += [("zero", 0, 0, [0.0] * dim), ("null", 1, 0, None), ("hole", 1, 0, [None] * dim), ("short", 1, 0, [1.0, 2.0]), ("loose", 2, None, [1.0] * dim)]
    size = {c: sum(r[1] == c for r in rows) for c in range(components)}
    e = spark.createDataFrame([(i, c, size[c], k) for i, c, k, _ in rows], "entity_id string, component long, component_size long, cluster int")
    return rows, e, spark.createDataFrame([(i, v) for i, _, _, v in rows], "entity_id string, centre array<double>")


def cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y or not any(x) or not any(y):
        return None
    x, y = np.array(x) / np.linalg.norm(x), np.array(y) / np.linalg.norm(y)
    return round(float(x @ y), 9)


@pytest.mark.parametrize("seed,least,cell", [(1, 0.3, 16), (2, 0.9, 7), (3, -1.0, 500)])
def test_best_pairs_of_components_equal_all_pairs(spark, seed, least, cell):
    rows, e, centres = people(spark, 240, seed)
    want = {}
    for a in rows:
        for b in rows:
            s = cosine(a[3], b[3])
            if a[1] < b[1] and a[2] is not None and a[2] == b[2] and s is not None and s >= least:
                want.setdefault((a[1], b[1]), []).append((-s, a[0], b[0]))
    got = B.cross_component_best(e, centres, least, cell_rows=cell).collect()
    found = {}
    for r in got:
        found.setdefault((r.ca, r.cb), []).append((round(-r.score, 7), r.a, r.b))
    assert {k: sorted(round(-x[0], 7) for x in v) for k, v in found.items()} == {k: sorted(round(-x[0], 7) for x in sorted(v)[:5]) for k, v in want.items()}
    all_pairs = {(round(s, 7), a, b) for v in want.values() for s, a, b in v}
    assert {x for v in found.values() for x in v} <= all_pairs


def test_drift_pairs_equal_all_pairs(spark):
    rows, e, centres = people(spark, 200, 5)
    drifts = [(r[0], (r[2] + 1) % 3) for r in rows[::3] if r[2] is not None] + [("e0001", None), ("nobody", 1), (rows[0][0], (rows[0][2] + 1) % 3)]
    got = B.drift_best(spark.createDataFrame(drifts, "entity_id string, target int"), e, centres, cell_rows=16).collect()
    held = {r[0]: r for r in rows}
    for a, target in set(drifts):
        mine = sorted(round(r.score, 7) for r in got if r.a == a and r.target == target)
        if a not in held or target is None:
            assert mine == []
            continue
        scores = [cosine(held[a][3], r[3]) for r in rows if r[2] == target and r[1] != held[a][1]]
        assert mine == sorted(round(s, 7) for s in sorted((s for s in scores if s is not None), reverse=True)[:10])


def test_rules_of_taking_part(spark):
    t = [("a", 1, 2, 1), ("b", 1, 2, 0), ("c", 2, 1, 3), ("d", 2, 1, None), ("s", 2, 1, 2), ("n", None, None, 5), ("a", 1, 2, 1)]
    clusters = spark.createDataFrame([("a", 4), ("c", 4)], "entity_id string, cluster int")
    speakers = spark.createDataFrame([("s",)], "entity_id string")
    got = lambda rows: sorted(tuple(r) for r in B.bridge_entities(spark.createDataFrame(rows, TOPOLOGY), clusters, speakers).collect())
    assert got(t) == [("a", 1, 2, 4), ("c", 2, 1, 4)]
    assert got(t + [("b", 3, None, 0)]) == [("a", 1, 2, 4), ("c", 2, 1, 4)]  # of no account: core 0
    assert got(t + [("z", 3, None, 1)]) == []  # stale
    assert got([]) == []


def test_size_is_that_of_the_whole_component(spark):
    e = spark.createDataFrame([("a", 1, 2, 0), ("b", 2, 1, 0), ("c", 3, 9, 0)], "entity_id string, component long, component_size long, cluster int")
    v = spark.createDataFrame([(i, [1.0, 1.0]) for i in "abc"], "entity_id string, centre array<double>")
    assert [(r.a, r.b, r.score) for r in B.cross_component_best(e, v).collect()] == [("a", "c", 1.0)]
    none = e.filter("false")
    assert B.cross_component_best(none, v).count() == 0 and B.drift_best(none.select("entity_id", F.lit(0).alias("target")), e, v).count() == 0


def test_a_driven_pair_stays_driven(spark):
    one = spark.createDataFrame([("a", "b", 0.5), ("c", "d", 0.4)], "a string, b string, score double")
    two = spark.createDataFrame([("b", "a", 0.5), ("x", "e", -0.2)], "a string, b string, score double")
    assert sorted(map(tuple, B.bridge_pairs(one, two).collect())) == [("a", "b", 0.5, True), ("c", "d", 0.4, False), ("e", "x", -0.2, True)]
