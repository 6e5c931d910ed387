"""Spanning forest, single linkage and density clusters against a plain single-process form."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from chronoweave.operators.clustering import density_clusters
from chronoweave.operators.linkage import single_linkage, spanning_forest


def plain_forest(edges):
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    out = []
    for w, a, b in sorted((w, *sorted((a, b))) for a, b, w in edges if a != b):
        if root(a) != root(b):
            up[root(b)] = root(a)
            out.append((a, b, w))
    return out


def plain_clusters(ids, forest, min_size):
    """{id: (name, probability)} by merging in order and walking the condensed tree."""
    node, size, kids, at = {i: i for i in ids}, {i: 1 for i in ids}, {}, {}
    top = {i: i for i in ids}

    def root(v):
        while node[v] != v:
            v = node[v]
        return v

    for r, (a, b, w) in enumerate(sorted(forest, key=lambda e: (e[2], e[0], e[1]))):
        a, b = root(a), root(b)
        name = ("m", r)
        kids[name], at[name] = (top[a], top[b]), 1 / max(w, 1e-12)
        size[name] = size[top[a]] + size[top[b]]
        node[b], top[a] = a, name
    tops = [top[v] for v in ids if root(v) == v and size[top[v]] >= min_size]
    clusters, gone, where = {}, {}, {}

    def leaves(v):
        return [v] if v not in kids else leaves(kids[v][0]) + leaves(kids[v][1])

    def grow(head, born, parent):
        clusters[head] = {"born": born, "parent": parent, "own": 0.0, "kids": [], "death": 0.0}
        c, now = clusters[head], head
        while True:
            d = at[now]
            large = [k for k in kids[now] if size[k] >= min_size]
            small = [p for k in kids[now] if size[k] < min_size for p in leaves(k)]
            for p in small:
                gone[p], where[p] = d, head
            c["death"] = max(c["death"], d)
            c["own"] += len(small) * (d - born)
            if len(large) == 2:
                c["own"] += size[now] * (d - born)
                for k in large:
                    c["kids"].append(k)
                    grow(k, d, head)
                return
            if not large:
                return
            now = large[0]

    for t in tops:
        grow(t, 0.0, None)
    pick = {}

    def best(h):
        below = sum(best(k) for k in clusters[h]["kids"])
        own = -1.0 if clusters[h]["parent"] is None and len(tops) == 1 else clusters[h]["own"]
        pick[h] = own >= below
        return max(own, below)

    for t in tops:
        best(t)
    out = {}
    for p, h in where.items():
        chain = []
        while h is not None:
            chain.append(h)
            h = clusters[h]["parent"]
        taken = [h for h in chain if pick[h]]
        if taken:
            out[p] = (taken[-1], min(1.0, gone[p] / clusters[taken[-1]]["death"]))
    return out


@pytest.mark.parametrize("task_edges", [20, 1000])
def test_forest_and_linkage(spark, task_edges):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 30) / 4) for _ in range(150)] + [(100, 101, 1.0), (101, 100, 0.5)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    forest = spanning_forest(df, task_edges)
    want = plain_forest(edges)
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    ids = sorted({v for e in want for v in e[:2]})
    named, tree = single_linkage(spark.createDataFrame([(i,) for i in ids], "id long"), forest, task_edges)
    place = {r.id: r.node for r in named.collect()}
    assert place == {i: n for n, i in enumerate(ids)}
    held = {n: [i] for i, n in place.items()}
    for r, (a, b, w) in zip(sorted(tree.collect(), key=lambda r: r.node), sorted(want, key=lambda e: (e[2], e[0], e[1]))):
        assert r.w == w and r.n_left == len(held[r.left]) and r.n_right == len(held[r.right])
        assert {a, b} & set(held[r.left]) and {a, b} & set(held[r.right])
        held[r.node] = held[r.left] + held[r.right]
    assert len(tree.collect()) == len(want)


@pytest.mark.parametrize("min_size, task_edges", [(3, 10**6), (5, 10**6), (12, 100)])
def test_clusters_equal_the_plain_tree(spark, min_size, task_edges):
    rng = np.random.default_rng(min_size)
    middles = rng.normal(size=(6, 8))
    x = np.vstack([middles[g] + rng.normal(0, 0.08 * (1 + g), (50, 8)) for g in range(6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.maximum(1 - unit @ unit.T, 1e-12)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    forest = plain_forest([(i, j, reach[i, j]) for i in range(300) for j in range(i)])
    want = plain_clusters(range(300), forest, min_size)
    got = {r.id: r for r in density_clusters(df, min_size, neighbours=299, task_edges=task_edges).collect()}
    groups = [defaultdict(set), defaultdict(set)]
    for i in range(300):
        assert (got[i].cluster >= 0) == (i in want)
        if i in want:
            groups[0][got[i].cluster].add(i)
            groups[1][want[i][0]].add(i)
            assert math.isclose(got[i].probability, want[i][1], rel_tol=1e-6)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))
    assert [len(groups[0][c]) for c in range(len(groups[0]))] == sorted(map(len, groups[0].values()), reverse=True)


def test_a_chain_of_splits_is_one_task(spark):
    """A condensed tree of 400 levels, each with a leaf; by levels as well on a small one."""
    import random

    from chronoweave.operators.clustering import stable

    def chosen(rows):
        own, kids = {c: o for c, _, o in rows}, {}
        for c, p, _ in rows:
            kids.setdefault(p, []).append(c)
        tops = kids[None]
        if len(tops) == 1:
            own[tops[0]] = -1.0
        best, out = {}, {}
        for c in sorted(own):
            best[c] = max(own[c], sum(best[k] for k in kids.get(c, [])))
        for c in sorted(own, reverse=True):
            p = next(p for k, p, _ in rows if k == c)
            out[c] = (out[p] if p is not None else None) or (c if own[c] >= sum(best[k] for k in kids.get(c, [])) else None)
        return out

    rng = random.Random(2)
    for levels, roots, most in ((400, 1, 10_000), (6, 2, 1), (6, 2, 10_000)):
        rows = []
        for r in range(roots):
            names = [1000 * (r + 1) - 2 * i for i in range(levels)]
            rows += [(c, names[i - 1] if i else None, rng.random() * (levels - i)) for i, c in enumerate(names)]
            rows += [(c - 3, c, rng.random()) for c in names]
        df = spark.createDataFrame([(c, p, 0.0, o) for c, p, o in rows], "cluster long, parent long, born double, own double")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
        assert {r.cluster: r.chosen for r in stable(df, most).collect()} == chosen(rows)
        assert levels < 100 or len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 20
