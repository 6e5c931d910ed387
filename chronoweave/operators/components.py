"""Connected components by alternating large-star and small-star joins, or in one task where that holds the graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.whole import least_reached
from chronoweave.plans.stash import drop_stash, stash

#: Edges that a task holds.
TASK_EDGES = 1 << 20


def ends_of(held: list[pa.RecordBatch], u: str = "u", v: str = "v") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names in order, u, v) of (u, v) edges, numbered."""
    t = pa.Table.from_batches(held)
    told = pa.chunked_array([*t.column(u).chunks, *t.column(v).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(told.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[told.indices.to_numpy()]
    return told.dictionary.take(pa.array(order)), codes[: t.num_rows], codes[t.num_rows :]


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(u, v) from each vertex to the least one that these edges join it to."""
    names, x, y = ends_of(held)
    up = least_reached(len(names), x, y)
    own = np.flatnonzero(up != np.arange(len(up)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(up[own]))], ["u", "v"])


def _thinned(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most:
                star = _stars(held)
                held, rows = [star], star.num_rows
                if rows > most // 2:  # too many vertices to gain more here
                    yield star
                    held, rows = [], 0
        if held:
            yield _stars(held)

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    if held:
        names, x, y = ends_of(held)
        up = least_reached(len(names), x, y)
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(up))], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, task_edges: int = 0) -> DataFrame:
    """(node, component) of every node of an undirected edge list; the component is the smallest node in it.

    Each round links every neighbour of a node to the smallest neighbour (large star: the greater ones, small star: the
    others), until no edge changes. Rounds grow with the logarithm of the diameter. Edges only ever shrink in number;
    a hub's neighbours are aggregated, never gathered in a list. Self loops keep a node that has no other edge.
    With ``task_edges`` tasks of so many edges first put a star in place of each part they see, as long as that takes
    a third away, and where a task holds what is left, it ends there.
    """
    a, b = F.col(src), F.col(dst)
    loops = edges.filter(a == b).select(a.alias("node")).distinct()
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stash(now if task_edges else now.distinct())
    loops = stash(loops)
    if task_edges:
        shape, left = ", ".join(f"{c} {t}" for c, t in now.dtypes), now.count()
        while left > task_edges:
            new = stash(now.repartitionByRange(math.ceil(left / task_edges), "u").mapInArrow(_thinned(task_edges), shape))
            drop_stash(now)
            now, was, left = new, left, new.count()
            if left > was * 2 // 3:
                break
        if left <= task_edges:
            kind = dict(now.dtypes)["u"]
            found = stash(now.repartition(1).mapInArrow(_solved, f"node {kind}, component {kind}"))
            drop_stash(now)
            return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
        new = stash(now.distinct())
        drop_stash(now)
        now = new
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        new = stash(small)
        told = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        drop_stash(now)
        now = new
        if (told["n"], told["x"]) == sign:
            break
        sign = (told["n"], told["x"])
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
