"""Chains with their templates, and edges stamped with them, against the chains' own events."""

import random

from pyspark.sql import functions as F

from chronoweave.operators import causal as C


def test_templates_grow_with_the_chains(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(12), rng.randrange(12), f"2024-01-{1 + i % 20:02}", None if i % 6 else "2024-02-01") for i in range(26)]
    edges = spark.createDataFrame(rows, "edge_id long, cause_event_id long, effect_event_id long, created_at string, expired_at string")
    nodes = spark.createDataFrame([(i, None if i == 3 else "abc"[i % 3]) for i in range(11)], "event_id long, node string")
    since = F.lit("2024-01-08")
    want = C.templates(C.chains(edges, since, high=4), nodes).collect()
    found = C.named_chains(edges, nodes, since, high=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 50
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each event of a chain
    kept = C.patterns(found, 2)
    names, first = {r.template for r in kept.collect()}, {}
    for r in want:
        for i, e in enumerate(r.edges):
            if r.template in names:
                first[e] = min(first.get(e, ("~", 0)), (r.template, i))
    stamped = C.stamp_edges(found, kept)
    assert {r.edge_id: (r.template, r.position) for r in stamped.collect()} == first
    assert dict(stamped.dtypes) == {"edge_id": "bigint", "template": "string", "position": "int"}
