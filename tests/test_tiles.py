"""Core numbers and communities in rounds over tiles of the graph."""

import itertools
import random

from chronoweave.operators import graph


def few_arcs(monkeypatch, arcs):
    """Tiles of about so many arcs, and the number of tables that are written."""
    seen = []
    tiled, stash = graph.tiled, graph.stash

    def small(*args):
        out = tiled(*args, tile_arcs=arcs)
        seen.append(out.side)
        return out

    monkeypatch.setattr(graph, "tiled", small)
    written = []
    monkeypatch.setattr(graph, "stash", lambda df, *rest: (written.append(1), stash(df, *rest))[1])
    return seen, written


def test_core_numbers_in_tiles_take_few_rounds(spark, monkeypatch):
    """Vertices of many degrees: peeling goes level by level, bounds settle at once."""
    rng = random.Random(5)
    pairs = [(f"a{rng.randrange(12)}", f"b{int(rng.random() ** 2 * 150)}") for _ in range(700)] + [("a1", "b1")] * 3 + [("z", "z")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    want, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        want[v] = k
        for u in near.pop(v):
            if u in near:
                near[u].remove(v)
    seen, written = few_arcs(monkeypatch, 100)
    found = graph.core_numbers(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.v: r.core for r in found.collect()} == want
    assert seen[0] > 2 and len(written) <= graph.BOUND_ROUNDS + 8, (seen, len(written))


def test_core_numbers_without_edges(spark):
    assert graph.core_numbers(spark.createDataFrame([("a", "a")], "src string, dst string")).collect() == []
    assert graph.communities(spark.createDataFrame([("a", "a")], "src string, dst string")).collect() == []


def test_communities_do_not_depend_on_the_tiles(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(f"v{g}{rng.randrange(9)}", f"v{g}{rng.randrange(9)}") for g in range(5) for _ in range(45)] + [(f"v{a}0", f"v{b}1") for a, b in itertools.combinations(range(5), 2)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    want = {r.v: r.community for r in graph.communities(edges, rounds=4, levels=2).collect()}
    assert 1 < len(set(want.values())) < len(want) and all(want[c] == c <= v for v, c in want.items())
    seen, _ = few_arcs(monkeypatch, 40)
    got = graph.communities(edges, rounds=4, levels=2)
    assert {r.v: r.community for r in got.collect()} == want and seen[0] > 2
