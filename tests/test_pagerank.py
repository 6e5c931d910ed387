"""PageRank against a plain loop, and what it shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import graph as G
from tests.test_hops_names import shuffled


def test_against_a_loop(spark):
    """Parallel edges, self loops, isolated vertices and an edge to a vertex that is not listed."""
    rng = random.Random(9)
    names = [f"v{i:02d}" for i in range(40)]
    pairs = [(rng.choice(names[:35]), rng.choice(names[:35])) for _ in range(70)] + [("v01", "v02")] * 3 + [("v03", "v03"), ("v04", "other")]
    arcs = pairs + [(b, a) for a, b in pairs]
    degree = {v: sum(a == v for a, _ in arcs) for v in names}
    rank = dict.fromkeys(names, 1 / 40)
    for _ in range(7):
        loose = sum(rank[v] for v in names if not degree[v]) / 40
        flow = {v: sum(rank[a] / degree[a] for a, b in arcs if b == v and a in rank) for v in names}
        rank = {v: 0.15 / 40 + 0.85 * (flow[v] + loose) for v in names}
    got = G.pagerank(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(v,) for v in names], "v string"), rounds=7)
    assert {r.v: r["rank"] for r in got.collect()} == pytest.approx(rank)


def test_a_round_does_not_shuffle_names(spark):
    """40,000 arcs of long names over eight rounds."""
    name = lambda c: F.concat(F.lit("a long name of a vertex of a graph "), F.md5(c.cast("string")))
    edges = spark.range(20_000).select(name(F.col("id") % 100).alias("src"), name(F.col("id") % 3_001).alias("dst"))
    vertices = G.both_ways(edges).select(F.col("src").alias("v")).distinct()
    before = shuffled(spark)
    assert G.pagerank(edges, vertices, rounds=8).agg(F.round(F.sum("rank"), 9)).first()[0] == 1
    assert shuffled(spark) - before < 2_500_000
