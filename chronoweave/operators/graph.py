"""Graph measures as loops of joins over an edge list (src, dst); parallel edges are kept unless stated."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.blocks import cut_vertices
from chronoweave.operators.components import TASK_EDGES, connected_components
from chronoweave.operators.graph_cuts import betweenness
from chronoweave.operators.intervals import numbered
from chronoweave.operators.tiles import TILE_ARCS, Tiles, blocks, longs, named, received, summed, tiled, unpacked
from chronoweave.operators.whole import cores, cuts_and_bridges, in_one_task, least_reached, ranks, settled
from chronoweave.plans.stash import drop_stash, stash


def entity_edges(facts: DataFrame) -> DataFrame:
    """(src, dst, edge_id, kind): active facts between two different entities."""
    f = facts.filter("expired_at is null and object_id is not null and object_id <> subject_id")
    return f.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("fact_id").alias("edge_id"), F.col("predicate").alias("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(e.select("dst", "src"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, degree) with 0 for isolated vertices."""
    d = both_ways(edges).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return vertices.select("v").join(d, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


#: Parts that the members of a leaf class are dealt to.
LEAF_PARTS = 64


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, v, hop): vertices within ``depth`` undirected steps of each seed, itself left out, at their nearest.

    Vertices whose only neighbour is the same lie equally far from all others, so the least of them stands for all in the
    search, and its rows are multiplied at the end, where nothing is shuffled any more. Each level but the last is
    written before the next one reads it, so the plan stays one join long.
    """
    arcs = stash(both_ways(edges.filter("src <> dst")).distinct())
    leaf = arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"), F.min("dst").alias("hub")).filter("d = 1").select("v", "hub")
    heads = leaf.groupBy("hub").agg(F.min("v").alias("head"), F.count("*").alias("n")).filter("n > 1")
    classes = stash(leaf.join(heads, "hub").select("v", "head"))
    others = classes.filter("v <> head").select("v")
    slim = arcs.join(others.toDF("src"), "src", "left_anti").join(others.toDF("dst"), "dst", "left_anti")
    slim = stash(slim.join(classes.filter("v = head").select(F.col("v").alias("dst"), F.lit(True).alias("many")), "dst", "left").select("src", "dst", F.coalesce("many", F.lit(False)).alias("many")))
    drop_stash(arcs)
    asked = stash(seeds.select("seed").distinct().join(classes.toDF("seed", "head"), "seed", "left").select("seed", F.coalesce("head", "seed").alias("start"), F.col("head").isNotNull().alias("leaf")))
    starts = asked.groupBy(F.col("start").alias("v")).agg(F.max("leaf").alias("many"))
    seen = stash(starts.select(F.col("v").alias("start"), "v", "many", F.lit(0).alias("hop")))
    for h in range(1, depth + 1):
        front = seen.filter(F.col("hop") == h - 1).select("start", F.col("v").alias("src"))
        step = front.join(slim, "src").select("start", F.col("dst").alias("v"), "many", F.lit(h).alias("hop"))
        new = stash(seen.unionByName(step).groupBy("start", "v", "many").agg(F.min("hop").alias("hop")))
        drop_stash(seen)
        seen = new
        if seen.filter(F.col("hop") == h).isEmpty():
            break
    alone = asked.filter("not leaf").select("start")  # such a start is its own only seed
    leaves = asked.filter("leaf").select("start", "seed")

    def of_seeds(rows: DataFrame) -> DataFrame:
        """(seed, ...) of (start, ...) rows."""
        mine = rows.join(alone, "start", "left_semi").withColumnRenamed("start", "seed")
        return mine.unionByName(rows.join(leaves, "start").drop("start").select(mine.columns))

    plain = of_seeds(seen.filter("not many and hop > 0").select("start", "v", "hop"))
    if classes.isEmpty():
        return plain
    heads_seen = seen.filter("many").select("start", F.col("v").alias("head"), F.when(F.col("hop") == 0, 2).otherwise(F.col("hop")).alias("hop"))
    dealt = of_seeds(heads_seen.filter(F.col("hop") <= depth)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LEAF_PARTS - 1))))
    members = classes.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(LEAF_PARTS)).cast("int"))
    return plain.unionByName(dealt.join(members, ["head", "_part"]).filter("seed <> v").select("seed", "v", "hop"))


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges between vertices near any seed."""
    near = hops(edges, seeds, depth).select("v").union(seeds.select("seed")).distinct()
    return edges.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")


def paths(edges: DataFrame, pairs: DataFrame, depth: int, most: int) -> DataFrame:
    """(a, b, path): edge paths of at most ``depth`` undirected steps, no edge twice, the ``most`` shortest of a pair."""
    arcs = edges.select("src", "dst", "edge_id").union(edges.select("dst", "src", "edge_id"))
    front = pairs.select("a", "b", F.col("a").alias("src"), F.array().cast("array<string>").alias("path"))
    found = None
    for _ in range(depth):
        front = front.join(arcs, "src").filter(~F.array_contains("path", F.col("edge_id"))).select("a", "b", F.col("dst").alias("src"), F.array_append("path", F.col("edge_id")).alias("path"))
        hit = front.filter("src = b").select("a", "b", "path")
        found = hit if found is None else found.union(hit)
    order = Window.partitionBy("a", "b").orderBy(F.size("path"), F.array_join("path", ","))
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select("a", "b", F.array_join("path", ",").alias("path"))


#: Rounds in which bounds of core numbers may settle before vertices are peeled.
BOUND_ROUNDS = 12


def core_numbers(edges: DataFrame) -> DataFrame:
    """(v, core): coreness, parallel edges counted.

    A vertex's bound is at first its degree, then the greatest h such that edges to neighbours of a bound of h or more are h
    or more. Where no bound changes any more, they are the core numbers. Long chains settle a vertex a round; a graph that
    has not settled after ``BOUND_ROUNDS`` is peeled instead.
    """
    names, arcs, tiles = _numbered_tiles(edges)
    if tiles is None:
        return names.select("v", F.lit(0).cast("long").alias("core"))
    if tiles.side == 1:
        told = in_one_task(names.select("x"), tiles.rows, lambda held, x, y, w: {"core": cores(len(held), x, y, w)}, "core long")
        found = stash(told.join(names, "x").select("v", "core"))
        for done in (names, arcs, tiles.rows):
            drop_stash(done)
        return found
    state = blocks(arcs.groupBy("x").agg(F.sum("w").alias("told")).withColumn("extra", F.lit(0)), tiles.side, ["told", "extra"])
    for _ in range(BOUND_ROUNDS):
        new = stash(state.groupBy("f").cogroup(tiles.spread(state).groupBy("f")).applyInPandas(_bounded, "f int, told binary, extra binary, moved boolean"))
        drop_stash(state)
        state, settled = new.drop("moved"), new.filter("moved").isEmpty()
        state._stash_path = new._stash_path
        if settled:
            found = stash(unpacked(state, tiles.side, ["told"]).join(names, "x").select("v", F.col("told").alias("core")))
            break
    else:
        found = _peeled(edges)
    for done in (names, arcs, tiles.rows, state):
        drop_stash(done)
    return found


def _numbered_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stashed (v, x) and (x, y, w): vertices with edges to others, in order, and both arcs of every two, with their edges' number."""
    e = stash(edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("w")))
    names = named(e.select(F.col("src").alias("v")).union(e.select("dst")))
    ends = stash(e.join(names.toDF("src", "x"), "src").join(names.toDF("dst", "y"), "dst").select("x", "y", "w"))
    drop_stash(e)
    arcs = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    arcs._stash_path = ends._stash_path
    return names, arcs


def _numbered_tiles(edges: DataFrame) -> tuple[DataFrame, DataFrame, Tiles | None]:
    """``_numbered_arcs`` and their tiles; None without any."""
    names, arcs = _numbered_arcs(edges)
    n = names.count()
    return names, arcs, tiled(arcs, n) if n else None


def _bounded(held: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
    row, (at, which, w, values, _) = held.iloc[0], received(met)
    was = longs(row["told"])
    at, which, w = at[::-1], which[::-1], w[::-1]  # greatest bounds first, vertices in falling order
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    many = np.cumsum(w)
    many -= np.repeat((many - w)[first], np.diff(np.r_[first, len(at)]))
    new = np.zeros(len(was), np.int64)
    new[at[first]] = np.maximum.reduceat(np.minimum(many, values[which]), first) if len(at) else 0
    new = np.minimum(new, was)
    return pd.DataFrame([[row["f"], new.tobytes(), row["extra"], bool((new < was).any())]], columns=["f", "told", "extra", "moved"])


def _peeled(edges: DataFrame) -> DataFrame:
    """(v, core): coreness, parallel edges counted, by peeling in bulk.

    At a level k all vertices of degree k or less go at once. A level that takes several rounds is peeled by chains: with
    these vertices goes every vertex of degree k + 1 that a chain of such vertices joins to one of them, since each of
    these loses an edge in turn, so a long path goes in one round.
    """
    arcs = stash(both_ways(edges).filter("src <> dst"))
    left = stash(arcs.select(F.col("src").alias("v")).distinct())
    out, k, turns = [], 0, 0
    while True:
        degree = stash(left.join(arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")), "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d")))
        low = degree.agg(F.min("d")).first()[0]
        if low is None:
            break
        k, turns = max(k, low), turns + 1 if low <= k else 1
        doomed = degree.filter(F.col("d") <= k)
        if turns > 4:
            near = degree.filter(F.col("d") <= k + 1)
            inner = arcs.join(near.select(F.col("v").alias("src")), "src", "left_semi").join(near.select(F.col("v").alias("dst")), "dst", "left_semi")
            chains = connected_components(inner.select("src", "dst").union(near.select("v", F.col("v").alias("w"))))
            doomed = near.join(chains.withColumnRenamed("node", "v"), "v").withColumn("least", F.min("d").over(Window.partitionBy("component"))).filter(F.col("least") <= k)
        gone = stash(doomed.select("v", F.lit(k).cast("long").alias("core")))
        out.append(gone)
        held = left, arcs, degree
        left = stash(left.join(gone, "v", "left_anti"))
        arcs = stash(arcs.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
        for x in held:
            drop_stash(x)
    found = left.withColumn("core", F.lit(0).cast("long"))
    for gone in out:
        found = found.union(gone)
    return found


#: Neighbours of a vertex that lie in one list: those whose numbers are in one range of so many.
PACKED = 1 << 16


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """(v, rank) over undirected edges, summing to 1; what isolated vertices hold is spread over all.

    Rounds go on until ranks change by less than ``tolerance`` in all, or for a given number; ``damping`` bounds them.
    Vertices are numbered, and an arc is a number in a list of its start's neighbours.
    """
    n = vertices.count()
    if not n:
        return vertices.select("v", F.lit(0.0).alias("rank"))
    named = stash(numbered(vertices.select("v"), ["v"], {"x": F.lit(1)}).select("v", F.col("x").cast("long").alias("x")))
    ends = edges.select("src", "dst").join(named.toDF("src", "x"), "src", "left").join(named.toDF("dst", "y"), "dst", "left").select("x", "y")
    ends = stash(ends.union(ends.select("y", "x")).filter("x is not null"))
    most = rounds or math.ceil(math.log(tolerance / 2) / math.log(damping)) + 4
    if ends.count() <= TILE_ARCS:
        found = stash(_ranked(named, ends, damping, tolerance, most).join(named, "x").select("v", "rank"))
        for done in (named, ends):
            drop_stash(done)
        return found
    degree = ends.groupBy("x").agg(F.count("*").alias("d"))
    packed = stash(ends.filter("y is not null").groupBy("x", F.expr(f"y div {PACKED}")).agg(F.collect_list("y").alias("ys")).select("x", "ys"))
    rank = stash(named.select("x").join(degree, "x", "left").select("x", "d", F.lit(1.0 / n).alias("rank")))
    for i in range(1, most + 1):  # each round is written: the next one reads its ranks three times
        share = rank.filter("d is not null").select("x", (F.col("rank") / F.col("d")).alias("s"))
        flow = share.join(packed, "x").select(F.explode("ys").alias("x"), "s").groupBy("x").agg(F.sum("s").alias("s"))
        loose = rank.filter("d is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        new = rank.join(flow, "x", "left").crossJoin(F.broadcast(loose))  # one row
        new = stash(new.select("x", "d", F.col("rank").alias("was"), ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + F.col("loose") / n)).alias("rank")))
        drop_stash(rank)
        rank = new
        if i % 4 == 0 and new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
            break
    for done in (ends, packed):
        drop_stash(done)
    return rank.join(named, "x").select("v", "rank")


def _ranked(named: DataFrame, ends: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    """(x, rank) of the (x) vertices by (x, y) arcs, null y being no vertex, in one task."""

    def solve(held: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        n, x, met = len(held), arcs["x"].to_numpy(np.int64), arcs["y"].notna().to_numpy()
        degree = np.bincount(x, minlength=n).astype(np.float64)
        return pd.DataFrame({"x": np.arange(n), "rank": ranks(n, x[met], arcs["y"][met].to_numpy(np.int64), degree, damping, tolerance, most)})

    one = [rows.withColumn("_one", F.lit(0)).groupBy("_one") for rows in (named.select("x"), ends)]
    return one[0].cogroup(one[1]).applyInPandas(solve, "x long, rank double")


def participation(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(v, p): 1 less the sum of squared shares of a vertex's edges by neighbour group; null for degree 0."""
    k = both_ways(edges).join(groups.toDF("dst", "g"), "dst").groupBy(F.col("src").alias("v"), "g").agg(F.count("*").alias("k"))
    p = k.groupBy("v").agg(F.sum("k").alias("d"), F.sum(F.col("k") * F.col("k")).alias("q")).select("v", (1 - F.col("q") / (F.col("d") * F.col("d"))).alias("p"))
    return groups.toDF("v", "g").select("v").join(p, "v", "left")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of (v, community) over undirected edges with parallel edges counted; 0 without edges."""
    e = edges.filter("src <> dst").select("src", "dst")
    met = e.join(labels.toDF("src", "cs"), "src").join(labels.toDF("dst", "cd"), "dst")
    row = met.agg(F.count("*").alias("m"), F.count(F.when(F.col("cs") == F.col("cd"), 1)).alias("inside")).first()
    if not row["m"]:
        return 0.0
    per = both_ways(e).join(labels.toDF("src", "c"), "src").groupBy("c").agg(F.count("*").alias("k"))
    square = per.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
    return row["inside"] / row["m"] - square / (4.0 * row["m"] ** 2)


#: Rounds of moves on a graph, and graphs of communities.
ROUNDS, LEVELS = 24, 6


def communities(edges: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """(v, community) by modularity moves: local moves, then the same on the graph of communities, until none helps.

    In a round every vertex computes its gain of joining each neighbour community, and half of the vertices, by a hash
    of vertex and round, move to the best one if the gain is positive (ties to the smaller community). Vertices that
    would swap for ever cannot, since the halves change; reruns agree. Moves may leave a community in parts that no edge
    of it joins; these are parted at the end, which never lowers modularity. It is named by its smallest member.
    Vertices are numbered in their order and arcs lie in tiles; a gain is a whole number, ``total`` times the weight.
    """
    names, arcs, first = _numbered_tiles(edges)
    if first is None:
        return names.select("v", F.col("v").alias("community"))
    if first.side == 1:
        told = in_one_task(_with_turns(names, rounds, levels), first.rows, lambda held, x, y, w: {"least": settled(_turns_of(held, levels), x, y, w, rounds)}, "least long")
        found = stash(told.join(names, "x").join(names.toDF("community", "least"), "least").select("v", "community"))
        for done in (names, arcs, first.rows):
            drop_stash(done)
        return found
    total = arcs.agg(F.sum("w")).first()[0]  # twice the edges
    of = stash(names.select("x", F.col("x").alias("node")))
    nodes = stash(arcs.groupBy("x").agg(F.sum("w").alias("k")).join(names, "x").select("x", "k", "v"))
    for level in range(levels):
        tiles = tiled(arcs, nodes.count()) if level else first
        state = blocks(nodes.select("x", F.col("x").alias("told"), "k", _turns(level, rounds).alias("turns")), tiles.side, ["told", "k", "turns"])
        quiet, moved_any = 0, False
        for i in range(rounds):
            held = _weighed(state, tiles.side)
            new = stash(held.groupBy("f").cogroup(tiles.spread(held).groupBy("f")).applyInPandas(_moved(i, total), "f int, told binary, k binary, turns binary, moved boolean"))
            moved = not new.filter("moved").isEmpty()
            for done in (state, held):
                drop_stash(done)
            state = new.drop("moved")
            state._stash_path = new._stash_path
            quiet, moved_any = (0, True) if moved else (quiet + 1, moved_any)
            if quiet == 2:
                break
        if not moved_any:
            break
        # the graph of communities, numbered in their order
        found = stash(unpacked(state, tiles.side, ["told", "k"]))
        parts = named(found.select(F.col("told").alias("v"))).toDF("told", "y")
        met = tiles.spread(state.withColumn("extra", F.col("told")))
        lifted = state.groupBy("f").cogroup(met.groupBy("f")).applyInPandas(_lifted, "a long, b long, w long").groupBy("a", "b").agg(F.sum("w").alias("w"))
        lifted = stash(lifted.join(parts.toDF("a", "x"), "a").join(parts.toDF("b", "y"), "b").select("x", "y", "w"))
        into = stash(found.join(parts, "told").select(F.col("x").alias("node"), "y"))
        told = nodes.select(F.col("x").alias("told"), "v")
        nodes = stash(found.groupBy("told").agg(F.sum("k").alias("k")).join(parts, "told").join(told, "told").select(F.col("y").alias("x"), "k", "v"))
        of = stash(of.join(into, "node").select("x", F.col("y").alias("node")))
        arcs = lifted
    # parts that no edge of their community joins
    met = first.inside(blocks(of.select("x", F.col("node").alias("told")), first.side, ["told"]))
    parts = connected_components(met, "x", "y").toDF("x", "part")
    least = of.join(parts, "x", "left").select("x", F.coalesce("part", "x").alias("least"))
    return stash(least.join(names, "x").join(names.toDF("community", "least"), "least").select("v", "community"))


def _turns(level: int, rounds: int) -> Column:
    """A bit for each round in which ``v`` may move."""
    return sum((F.when(F.pmod(F.xxhash64("v", F.lit(level * 1000 + i)), F.lit(2)) == 0, F.lit(1 << i)).otherwise(0) for i in range(rounds)), F.lit(0).cast("long"))


def _with_turns(names: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    return names.select("x", *[_turns(level, rounds).alias(f"turns{level}") for level in range(levels)])


def _turns_of(held: pd.DataFrame, levels: int = LEVELS) -> list[np.ndarray]:
    return [held[f"turns{level}"].to_numpy() for level in range(levels)]


def _weighed(state: DataFrame, side: int) -> DataFrame:
    """Stashed ``state`` (f, told, k, turns) with ``extra``: for each vertex the sum of k over its community ``told``."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, told, k in zip(batch["f"], batch["told"], batch["k"]):
                ids, at = np.unique(longs(told), return_inverse=True)
                sums = np.zeros(len(ids), np.int64)
                np.add.at(sums, at, longs(k))
                parts = [(d, f, ids[ids % side == d].tobytes(), sums[ids % side == d].tobytes()) for d in range(side)]
                yield pd.DataFrame(parts, columns=["d", "f", "ids", "sums"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([longs(x) for x in rows["ids"]]), return_inverse=True)
        sums, bounds = np.zeros(len(ids), np.int64), np.cumsum([0, *(len(x) // 8 for x in rows["ids"])])
        np.add.at(sums, at, np.concatenate([longs(x) for x in rows["sums"]]))
        return rows.assign(sums=[sums[at[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])])

    def fill(held: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        ids, sums = (np.concatenate([longs(x) for x in met[c]]) for c in ("ids", "sums"))
        order = np.argsort(ids)
        at = np.searchsorted(ids[order], longs(held["told"].iloc[0]))
        return held.assign(extra=[sums[order][at].tobytes()])

    shape = "d int, f int, ids binary, sums binary"
    sums = state.select("f", "told", "k").mapInPandas(ask, shape).groupBy("d").applyInPandas(total, shape)
    return stash(state.groupBy("f").cogroup(sums.groupBy("f")).applyInPandas(fill, "f int, told binary, k binary, turns binary, extra binary"))


def _moved(turn: int, total: int) -> Callable:
    kind = np.int64 if total < 1 << 31 else np.longdouble  # exact for products of weights

    def move(held: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        row, (at, which, w, values, weight) = held.iloc[0], received(met)
        own, k, turns, mine = (longs(row[c]) for c in ("told", "k", "turns", "extra"))
        k = k.astype(kind)
        c = values[which]
        home = c == own[at]
        # the gain of standing in c, its own weight taken out of its present community
        gain = w * kind(total) - k[at] * (weight[which] - np.where(home, k[at], 0))
        stay = -k * (mine - k)  # without a neighbour in one's own community only its other members' weight counts
        stay[at[home]] = gain[home]
        order = np.lexsort((c, -gain, at))
        best = order[np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])] if len(at) else order
        v = at[best]
        goes = (gain[best] > stay[v]) & (turns[v] >> turn & 1 == 1)
        new = own.copy()
        new[v[goes]] = c[best[goes]]
        return pd.DataFrame([[row["f"], new.tobytes(), row["k"], row["turns"], bool(goes.any())]], columns=["f", "told", "k", "turns", "moved"])

    return move


def _lifted(held: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
    """(a, b, w): the weights between the communities of a narrow block's vertices and others."""
    at, which, w, values, _ = received(met)
    ids, own = np.unique(longs(held["told"].iloc[0]), return_inverse=True)
    a, b, w = summed(own[at], which, w)
    a, b = ids[a], values[b]
    return pd.DataFrame({"a": a, "b": b, "w": w})[a != b]


def connected_parts(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(v, community): the (v, community) groups cut into the parts that their own edges join, named by smallest member."""
    met = edges.join(groups.toDF("src", "_a"), "src").join(groups.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst")
    parts = connected_components(met).toDF("v", "part")
    return stash(groups.select("v").join(parts, "v", "left").select("v", F.coalesce("part", "v").alias("community")))


def all_edges(facts: DataFrame, same_as: DataFrame) -> DataFrame:
    """(kind, id, src, dst) of fact edges and identity links (id, src, dst), in order of kind and id."""
    both = facts.withColumn("kind", F.lit("fact")).unionByName(same_as.withColumn("kind", F.lit("same_as")))
    return both.select("kind", "id", "src", "dst").orderBy("kind", "id")


def capped(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """At most ``most`` rows of every key, in a stated total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def topology_findings(edges: DataFrame, vertices: DataFrame, hubs: int = 10) -> DataFrame:
    """(v, degree, kind): isolate, island (outside the largest component), hub (the largest degrees), leaf or inner."""
    d = degrees(edges, vertices)
    parts = connected_components(edges.filter("src <> dst")).withColumnRenamed("node", "v")
    main = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component", F.lit(True).alias("_main"))
    top = d.orderBy(F.desc("degree"), "v").limit(hubs).select("v", F.lit(True).alias("_hub"))
    met = d.join(parts.join(F.broadcast(main), "component", "left"), "v", "left").join(F.broadcast(top), "v", "left")  # one row and ``hubs`` rows
    kind = F.when(F.col("degree") == 0, "isolate").when(F.col("_main").isNull(), "island").when(F.col("_hub"), "hub").when(F.col("degree") <= 2, "leaf").otherwise("inner")
    return met.select("v", "degree", kind.alias("kind"))


def topology_snapshot(edges: DataFrame, vertices: DataFrame, rounds: int | None = None, core: bool = True) -> DataFrame:
    """One row a vertex: component and its size, degree, coreness, PageRank; null component and core 0 for isolates.

    ``core=False`` leaves coreness out.
    """
    edges = stash(edges)
    parts = connected_components(edges.filter("src <> dst"), task_edges=TASK_EDGES).withColumnRenamed("node", "v")
    return _topology(edges, vertices, rounds, parts, core_numbers(edges) if core else None)


def _topology(edges: DataFrame, vertices: DataFrame, rounds: int | None, parts: DataFrame, cored: DataFrame | None) -> DataFrame:
    size = parts.groupBy("component").agg(F.count("*").alias("component_size"))
    met = degrees(edges, vertices).join(parts.join(size, "component"), "v", "left")
    if cored is not None:
        met = met.join(cored, "v", "left")
    met = met.join(pagerank(edges, vertices, rounds=rounds).withColumnRenamed("rank", "pagerank"), "v", "left")
    core = [F.coalesce("core", F.lit(0)).alias("core")] if cored is not None else []
    return met.select("v", "component", F.coalesce("component_size", F.lit(1)).alias("component_size"), "degree", *core, "pagerank")


def _measured(edges: DataFrame) -> DataFrame:
    """Stashed (v, component, core, community, is_cut) of the vertices with edges to others."""
    names, arcs, tiles = _numbered_tiles(edges)
    if tiles is not None and tiles.side == 1:

        def solve(held: pd.DataFrame, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
            n, once = len(held), x < y
            cut, _ = cuts_and_bridges(n, x[once], y[once])
            return {"_part": least_reached(n, x, y), "core": cores(n, x, y, w), "_group": settled(_turns_of(held), x, y, w, ROUNDS), "is_cut": cut}

        told = in_one_task(_with_turns(names), tiles.rows, solve, "_part long, core long, _group long, is_cut boolean")
        found = told.join(names, "x").join(names.toDF("component", "_part"), "_part").join(names.toDF("community", "_group"), "_group")
        found = stash(found.select("v", "component", "core", "community", "is_cut"))
    else:
        parts = connected_components(edges.filter("src <> dst"), task_edges=TASK_EDGES).withColumnRenamed("node", "v")
        cuts = cut_vertices(edges).select("v", F.lit(True).alias("is_cut"))
        found = stash(parts.join(core_numbers(edges), "v").join(communities(edges), "v").join(cuts, "v", "left").select("v", "component", "core", "community", F.coalesce("is_cut", F.lit(False)).alias("is_cut")))
    for done in (names, arcs, *([tiles.rows] if tiles else [])):
        drop_stash(done)
    return found


def full_snapshot(edges: DataFrame, vertices: DataFrame, rounds: int | None = None) -> DataFrame:
    """``topology_snapshot`` with is_cut, community, participation and betweenness of (src, dst, edge_id) edges.

    An isolate is in a community of its own, no cut vertex, on no shortest path, and its participation is null.
    Betweenness is exact: all vertices are sources.
    """
    edges = stash(edges)
    told = _measured(edges)
    groups = told.select("v", "community")
    between = stash(betweenness(edges, told.select("v"), normalised=True).withColumnRenamed("score", "betweenness"))
    met = _topology(edges, vertices, rounds, told.select("v", "component"), told.select("v", "core"))
    met = met.join(groups, "v", "left").join(participation(edges, groups).withColumnRenamed("p", "participation"), "v", "left").join(told.select("v", "is_cut"), "v", "left").join(between, "v", "left")
    return met.withColumns({"community": F.coalesce("community", "v"), "is_cut": F.coalesce("is_cut", F.lit(False)), "betweenness": F.coalesce("betweenness", F.lit(0.0))})
