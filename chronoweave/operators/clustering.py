"""Density clustering on cosine distance by a spanning forest, its single-linkage tree and the condensed tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.linkage import TASK_EDGES, single_linkage, spanning_forest
from chronoweave.operators.vectors import knn
from chronoweave.plans.stash import drop_stash, stash


def reach_edges(vectors: DataFrame, min_samples: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, w), (id, core)): mutual reachability along the graph of nearest neighbours, and core distances.

    A core distance is that of the ``min_samples``-th nearest point, the point itself being the first.
    """
    v = vectors.select("id", "vector")
    near = stash(knn(v.withColumnRenamed("id", "query_id"), v, neighbours + 1).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.greatest(1 - F.col("similarity"), F.lit(1e-12)).alias("d")).filter("a <> b"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    core = stash(near.withColumn("r", nth).filter(F.col("r") == min_samples - 1).select(F.col("a").alias("id"), F.col("d").alias("core")))
    met = near.join(core.toDF("a", "ca"), "a").join(core.toDF("b", "cb"), "b")
    return stash(met.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))), core


def _settle(links: DataFrame) -> DataFrame:
    """(node, head) of (node, up) links, ``up`` null at heads: pointers are followed twice as far in every round."""
    now = stash(links.select("node", F.coalesce("up", "node").alias("head")))
    while True:
        new = stash(now.join(now.select(F.col("node").alias("head"), F.col("head").alias("next")), "head").select("node", F.col("next").alias("head"), (F.col("next") != F.col("head")).alias("moved")))
        drop_stash(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("node", "head")


def condensed(points: DataFrame, tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """((node, cluster, gone), (cluster, parent, born, own)) of a single-linkage tree, see ``density_clusters``.

    A cluster is named by its topmost merge. ``gone`` is the density at which a point leaves its cluster, ``born`` the
    one at which a cluster leaves its parent, ``own`` the cluster's stability.
    """
    density = 1 / F.greatest("w", F.lit(1e-12))
    t = tree.select("*", (F.col("n_left") + F.col("n_right")).alias("n"), ((F.col("n_left") >= min_size) & (F.col("n_right") >= min_size)).alias("split"), density.alias("at"))
    below = t.select(F.col("left").alias("node"), F.col("node").alias("parent"), "split", "at").unionByName(t.select(F.col("right").alias("node"), F.col("node").alias("parent"), "split", "at"))
    big = t.filter(F.col("n") >= min_size).select("node", "n", F.col("split").alias("splits"), "at")
    met = stash(big.join(below.select("node", "parent", F.col("split").alias("head"), F.col("at").alias("born")), "node", "left"))
    head = _settle(met.select("node", F.when(F.coalesce("head", F.lit(True)), F.lit(None)).otherwise(F.col("parent")).alias("up")))
    head = stash(head.toDF("node", "cluster"))
    # points leave at their first merge of min_size points; a smaller merge has few steps to go
    at = points.select("node", F.col("node").alias("now"))
    out = None
    for _ in range(min_size):
        step = stash(at.join(below.select(F.col("node").alias("now"), "parent"), "now").join(t.select(F.col("node").alias("parent"), "n", "at"), "parent").select("node", F.col("parent").alias("now"), "n", "at"))
        there = step.filter(F.col("n") >= min_size).select("node", F.col("now").alias("merge"), F.col("at").alias("gone"))
        out = there if out is None else out.unionByName(there)
        at = step.filter(F.col("n") < min_size).select("node", "now")
        if at.isEmpty():
            break
    left = stash(out.join(head.toDF("merge", "cluster"), "merge").select("node", "cluster", "gone"))
    tops = met.join(head, "node").filter(F.col("node") == F.col("cluster")).select("cluster", F.col("parent").alias("node"), F.coalesce("born", F.lit(0.0)).alias("born"))
    clusters = stash(tops.join(head.select("node", F.col("cluster").alias("parent")), "node", "left").select("cluster", "parent", "born"))
    ends = met.filter("splits").join(head, "node").select("cluster", F.col("n").cast("double").alias("k"), "at")
    leaves = left.groupBy("cluster", F.col("gone").alias("at")).agg(F.count("*").cast("double").alias("k")).select("cluster", "k", "at")
    mass = ends.unionByName(leaves).join(clusters, "cluster").groupBy("cluster").agg(F.sum(F.col("k") * (F.col("at") - F.col("born"))).alias("own"))
    # a point that stays to a split leaves with its own side, so only what is lost before counts for the parent
    return left, stash(clusters.join(mass, "cluster", "left").select("cluster", "parent", "born", F.coalesce("own", F.lit(0.0)).alias("own")))


def _stable(rows: pd.DataFrame) -> pd.DataFrame:
    """``stable`` of the (cluster, parent, own) rows of whole trees; a parent's name is greater than its children's."""
    rows = rows.sort_values("cluster", ignore_index=True)
    place = {c: i for i, c in enumerate(rows["cluster"].tolist())}
    up = [-1 if pd.isna(p) else place[int(p)] for p in rows["parent"]]
    own, below, chosen = rows["own"].tolist(), [0.0] * len(rows), [None] * len(rows)
    for i, p in enumerate(up):
        if p >= 0:
            below[p] += max(own[i], below[i])
    names = rows["cluster"].tolist()
    for i in reversed(range(len(rows))):
        above = chosen[up[i]] if up[i] >= 0 else None
        chosen[i] = above if above is not None else names[i] if own[i] >= below[i] else None
    return pd.DataFrame({"cluster": rows["cluster"], "chosen": pd.array(chosen, dtype="Int64")})


def stable(clusters: DataFrame, task_clusters: int = TASK_EDGES) -> DataFrame:
    """(cluster, chosen): for every cluster the most stable one that is chosen at or above it, if there is one.

    From the leaves up, a cluster is as stable as it is itself or as the best below it are together; the root of all is
    never chosen. Up to ``task_clusters`` clusters, which a chain of splits may hold one by one, are one task's; more take
    a round a level of the condensed tree.
    """
    roots = clusters.filter("parent is null")
    only = roots.count() == 1
    rows = clusters.select("cluster", "parent", F.when(F.col("parent").isNull() & F.lit(only), F.lit(-1.0)).otherwise(F.col("own")).alias("own"))
    if rows.count() <= task_clusters:
        kind = dict(rows.dtypes)["cluster"]
        return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_stable, f"cluster {kind}, chosen {kind}")
    kids = rows.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("kids"))
    waits = stash(rows.join(kids, "cluster", "left").select("cluster", "parent", "own", F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(0.0).alias("below")))
    done = None
    while not waits.isEmpty():
        ready = stash(waits.filter("kids = 0").select("cluster", "parent", F.greatest("own", "below").alias("best"), (F.col("own") >= F.col("below")).alias("takes")))
        done = ready if done is None else done.unionByName(ready)
        up = ready.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("k"), F.sum("best").alias("b"))
        waits = stash(waits.filter("kids > 0").join(up, "cluster", "left").select("cluster", "parent", "own", (F.col("kids") - F.coalesce("k", F.lit(0))).alias("kids"), (F.col("below") + F.coalesce("b", F.lit(0.0))).alias("below")))
    if done is None:
        return clusters.select("cluster", F.col("cluster").alias("chosen"))
    done = stash(done)  # one table, not one a level, for the way down
    front, told = stash(done.filter("parent is null").select("cluster", F.when(F.col("takes"), F.col("cluster")).alias("chosen"))), None
    while not front.isEmpty():
        told = front if told is None else told.unionByName(front)
        next_ = done.join(front.select(F.col("cluster").alias("parent"), F.col("chosen").alias("above")), "parent")
        front = stash(next_.select("cluster", F.coalesce("above", F.when(F.col("takes"), F.col("cluster"))).alias("chosen")))
    return told


def density_clusters(vectors: DataFrame, min_size: int = 5, min_samples: int = 5, neighbours: int = 15, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, cluster, probability) of (id, vector) rows; noise has cluster -1 and probability 0.

    The graph of the ``neighbours`` nearest by mutual reachability has a minimum spanning forest; cutting its edges from
    the longest down gives the single-linkage tree. A merge of two sides of ``min_size`` points or more is a split into
    two clusters, smaller sides are points that leave theirs. A cluster's stability is the sum over its points of the
    density (1 / distance) at which they leave less that at which it was born; it is chosen if no clusters inside it
    are together more stable. All points together are no cluster; parts that no edge joins part at density 0. Clusters are
    numbered by size, then by smallest id; a probability is the density at which a point leaves over the largest at
    which one leaves the cluster itself, at most 1. Fewer than ``min_size`` points are all noise; an empty table gives
    an empty table. Vectors that are null or hold nulls are noise. With all others as neighbours the tree is exact.
    """
    ids = vectors.select("id")
    noise = ids.select("id", F.lit(-1).cast("int").alias("cluster"), F.lit(0.0).alias("probability"))
    if vectors.count() < min_size:
        return noise
    edges, core = reach_edges(vectors, min_samples, neighbours)
    forest = spanning_forest(edges, task_edges)
    drop_stash(edges)
    if forest.isEmpty():
        return noise
    points, tree = single_linkage(core, forest, task_edges)
    left, clusters = condensed(points, tree, min_size)
    if clusters.isEmpty():
        return noise
    chosen = stash(stable(clusters).filter("chosen is not null"))
    death = left.groupBy(F.col("cluster").alias("chosen")).agg(F.max("gone").alias("leaves"))
    splits = clusters.filter("parent is not null").groupBy(F.col("parent").alias("chosen")).agg(F.max("born").alias("parts"))
    found = left.join(chosen, "cluster").join(points, "node").join(death, "chosen", "left").join(splits, "chosen", "left")
    most = F.greatest("leaves", "parts")
    found = stash(found.select("id", "chosen", F.least(F.col("gone") / most, F.lit(1.0)).alias("probability")))
    per = found.groupBy("chosen").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    named = per.select("chosen", (F.row_number().over(Window.orderBy(F.desc("n"), "lo")) - 1).cast("int").alias("cluster"))  # a row a cluster
    told = found.join(named, "chosen").select("id", "cluster", "probability")
    return ids.join(told, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def cluster_stats(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stats rows with the number of clusters and of noise points written into them."""
    row = clusters.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise"))
    return stats.drop("clusters", "noise").crossJoin(F.broadcast(row))  # one row
