"""Measures of graphs that one task holds, against known answers and against the rounds of larger graphs."""

import random

import pytest

from chronoweave.operators import graph
from chronoweave.operators.blocks import bridges, cut_vertices
from chronoweave.operators.components import connected_components
from chronoweave.operators.graph_cuts import betweenness


def some_pairs(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n, n + 1), (n + 2, n + 2)]


def test_full_snapshot_starts_from_all_vertices_and_in_few_jobs(spark):
    """A hub with 30 arms of 20 vertices: what lies beyond a vertex times what does not, over all 601 vertices."""
    arms, length = 30, 20
    pairs = [(0 if j == 0 else a * length + j, a * length + j + 1) for a in range(arms) for j in range(length)]
    n = arms * length + 1
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_id long")
    status = spark.sparkContext.statusTracker()
    before = max(status.getJobIdsForGroup(None), default=-1)
    rows = {r.v: r for r in graph.full_snapshot(df, spark.createDataFrame([(v,) for v in range(n + 1)], "v long"), rounds=2).collect()}
    assert max(status.getJobIdsForGroup(None)) - before < 200  # several for each round of each measure
    scale = (n - 1) * (n - 2)
    want = {0: arms * (arms - 1) * length**2 / scale, n: 0.0}
    for a in range(arms):
        for j in range(1, length + 1):
            want[a * length + j] = 2 * (length - j) * (n - 1 - (length - j)) / scale
    assert {v: r.betweenness for v, r in rows.items()} == pytest.approx(want)
    assert {v for v, r in rows.items() if r.is_cut} == {v for v in range(n) if want[v] > 0}
    assert all(r.core == (v < n) and r.component == (0 if v < n else None) for v, r in rows.items())


def test_betweenness_does_not_depend_on_the_way(spark):
    df = spark.createDataFrame(some_pairs(3, 90, 260) + [(500 + i, i % 4) for i in range(40)], "src long, dst long")
    sources = spark.createDataFrame([(v,) for v in (*range(0, 90, 2), 500, 504, 505)], "v long")
    whole, tiled = ({r.v: r.score for r in betweenness(df, sources, normalised=True, whole_arcs=most).collect()} for most in (1 << 20, 0))
    assert whole == pytest.approx(tiled) and len(set(whole.values())) > 50


def test_measures_do_not_depend_on_the_way(spark, monkeypatch):
    """The single solve of the full snapshot against the measures one by one, and ranks by rounds of joins."""
    df = spark.createDataFrame([(f"v{a}", f"v{b}", i) for i, (a, b) in enumerate(some_pairs(4, 60, 75))], "src string, dst string, edge_id long")
    told = {r.v: r for r in graph._measured(df).collect()}
    assert {v: r.community for v, r in told.items()} == {r.v: r.community for r in graph.communities(df).collect()}
    assert {v: r.component for v, r in told.items()} == {r.node: r.component for r in connected_components(df.filter("src <> dst")).collect()}
    assert {v for v, r in told.items() if r.is_cut} == {r.v for r in graph.cut_vertices(df).collect()}
    assert len({r.component for r in told.values()}) > 1 and len({r.community for r in told.values()}) > 3 and {r.is_cut for r in told.values()} == {True, False}
    ranks = lambda: {r.v: r["rank"] for r in graph.pagerank(df, df.selectExpr("src as v").distinct(), rounds=4).collect()}
    want = ranks()
    monkeypatch.setattr(graph, "TILE_ARCS", 0)
    assert ranks() == pytest.approx(want)


@pytest.mark.parametrize("most", [7, 40, 1 << 20])
def test_components_of_tasks_that_hold_few_edges(spark, most):
    df = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in some_pairs(6, 300, 230) + [(None, 1), (7, None)]], "src string, dst string")
    want = {tuple(r) for r in connected_components(df).collect()}
    assert {tuple(r) for r in connected_components(df, task_edges=most).collect()} == want and len(want) > 200


def test_cuts_and_bridges_do_not_depend_on_the_way(spark):
    pairs = some_pairs(8, 50, 55)
    df = spark.createDataFrame([(f"v{a}", f"v{b}", i) for i, (a, b) in enumerate([*pairs, *pairs[:9]])], "src string, dst string, edge_id long")
    whole, by_blocks = (({r.v for r in cut_vertices(df, most).collect()}, {r.edge_id for r in bridges(df, most).collect()}) for most in (1 << 20, 0))
    assert whole == by_blocks and len(whole[0]) > 5 and len(whole[1]) > 5
