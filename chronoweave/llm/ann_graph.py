"""Operator 1: approximate nearest neighbours by a robust-pruned directed graph.

A shard's distinct vectors get one more component that turns the largest inner product into the smallest distance.
Vectors are inserted in batches: a greedy beam search of the graph so far proposes neighbours, and pruning with a
relaxed distance keeps diverse edges, for the new vector and for those it links back to. A query runs a beam search
from the shard's medoid; the beam is scored by exact inner products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.vector_search import matrix, search, top_rows, usable

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
INDEX = "shard int, dim int, place int, ids array<long>, vector array<double>, edges array<int>"


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one length: nearest by distance to (query, 0) is largest by inner product with the query."""
    squares = (vectors**2).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]]).astype(np.float32)


def beam_search(points: np.ndarray, squares: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances less the query's own square) of the best ``beam`` nodes met; -1 pads.

    All queries step together: each expands its ``width`` best nodes not expanded yet until its beam has none.
    """
    n, many = len(points), len(queries)
    nodes = np.full((many, beam), -1, np.int64)
    dist = np.full((many, beam), np.inf, np.float32)
    done = np.ones((many, beam), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = squares[start] - 2 * (queries @ points[start])
    seen = np.zeros((many, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(many)
    while len(live):
        waits = ~done[live]
        order = np.argsort(~waits, axis=1, kind="stable")[:, :width]  # beams are sorted by distance
        valid = np.take_along_axis(waits, order, axis=1)
        chosen = np.where(valid, np.take_along_axis(nodes[live], order, axis=1), n)
        done[live[:, None], order] = True
        near = edges[chosen].reshape(len(live), -1)
        near = np.where(np.take_along_axis(seen[live], near, axis=1), n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[live[:, None], near] = True
        d = squares[near] - 2 * np.einsum("qnd,qd->qn", points.take(np.minimum(near, n - 1), axis=0), queries[live], optimize=True)
        d = np.where(near == n, np.inf, d)
        all_nodes = np.concatenate([nodes[live], near], axis=1)
        all_dist = np.concatenate([dist[live], d.astype(np.float32)], axis=1)
        all_done = np.concatenate([done[live], near == n], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        nodes[live] = np.take_along_axis(all_nodes, order, axis=1)
        dist[live] = np.take_along_axis(all_dist, order, axis=1)
        done[live] = np.take_along_axis(all_done, order, axis=1)
        live = live[~done[live].all(axis=1)]
    return np.where(np.isfinite(dist), nodes, -1), dist


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """``degree`` diverse ones of each owner's candidates (-1 pads): the nearest drops what it is nearer to, relaxed."""
    n = len(points)
    candidates = np.sort(np.where(candidates == owners[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    held = points[candidates]
    away = ((held - points[owners][:, None]) ** 2).sum(axis=2)
    away[candidates < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(away, order, axis=1)
    held = points[candidates]
    squares = (held**2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * held @ held.transpose(0, 2, 1)
    alive = np.isfinite(away)
    out = np.full((len(owners), degree), n, np.int64)
    rows = np.arange(len(owners))
    for slot in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, slot] = candidates[rows, pick][some]
        alive &= (alpha * alpha * between[rows, pick] > away) | ~some[:, None]
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """(edges with the number of points as padding, medoid)."""
    n = len(points)
    edges = np.full((n + 1, degree), n, np.int64)
    middle = points.mean(axis=0)
    medoid = int(((points - middle) ** 2).sum(axis=1).argmin())
    squares = np.append((points**2).sum(axis=1), np.inf).astype(np.float32)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        found, _ = beam_search(points, squares, edges, medoid, points[new], beam)
        found = np.concatenate([found, np.broadcast_to(new, (len(new), len(new)))[:, : min(len(new), 32)]], axis=1)
        edges[new] = robust_prune(points, new, found, degree, alpha)
        source = np.repeat(new, degree)
        target = edges[new].ravel()
        source, target = source[target < n], target[target < n]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        owners, first = np.unique(target, return_index=True)
        counts = np.diff(np.append(first, len(target)))
        back = np.full((len(owners), counts.max(initial=0)), -1, np.int64)
        back[np.repeat(np.arange(len(owners)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        held = np.where(edges[owners] == n, -1, edges[owners])
        for i in range(0, len(owners), 1024):
            mine = slice(i, i + 1024)
            edges[owners[mine]] = robust_prune(points, owners[mine], np.concatenate([held[mine], back[mine]], axis=1), degree, alpha)
        at += size
        size = min(batch, size * 2)
    return all_reached(points, edges, medoid), medoid


def reached(edges: np.ndarray, start: int) -> np.ndarray:
    """Which of the nodes (and the padding) a walk along the edges from ``start`` comes to."""
    seen = np.zeros(len(edges), bool)
    seen[-1] = seen[start] = True
    front = np.array([start])
    while len(front):
        near = np.unique(edges[front])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def all_reached(points: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """``edges`` with a further slot, as often as needed, until every node is reached from ``start``.

    Pruning may drop the last edge into a node. Each node not reached gets an edge from its nearest reached one; of those
    with the same nearest, the nearest of all, and the others have a nearer one in the next round.
    """
    n = len(points)
    while not (seen := reached(edges, start)).all():
        lost, held = np.flatnonzero(~seen), np.flatnonzero(seen[:-1])
        squares = (points[held] ** 2).sum(axis=1)
        near, away = np.empty(len(lost), np.int64), np.empty(len(lost))
        for i in range(0, len(lost), 512):
            d = squares - 2 * points[lost[i : i + 512]] @ points[held].T
            near[i : i + 512] = held[d.argmin(axis=1)]
            away[i : i + 512] = d.min(axis=1) + (points[lost[i : i + 512]] ** 2).sum(axis=1)
        order = np.lexsort((lost, away, near))
        first = order[np.flatnonzero(np.append(True, np.diff(near[order]) != 0))]
        slot = np.full((n + 1, 1), n, np.int64)
        slot[near[first], 0] = lost[first]
        edges = np.hstack([edges, slot])
    return edges


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("cls")
    vectors = matrix(table.column("vector"), np.float64)
    edges, medoid = build_graph(lifted(vectors))
    n = len(table)
    place = np.arange(n, dtype=np.int32)
    place[medoid] = -1 - medoid  # marks the start
    flat = edges[:n].astype(np.int32)
    return pa.table({
        "shard": table.column("shard"), "dim": table.column("dim"), "place": place, "ids": table.column("ids"), "vector": table.column("vector"),
        "edges": pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel())),
    })


def _finder(k: int, beam: int):
    def find(index: pa.Table) -> Callable[[pa.Table], pa.Table]:
        place = index.column("place").to_numpy().astype(np.int64)
        medoid = int(-1 - place.min())
        place = np.where(place < 0, medoid, place)
        index = index.take(pa.array(np.argsort(place)))
        exact = matrix(index.column("vector"), np.float64)
        points = lifted(exact)
        squares = np.append((points**2).sum(axis=1), np.inf).astype(np.float32)
        flat = matrix(index.column("edges"), np.int64)
        edges = np.vstack([flat, np.full((1, flat.shape[1]), len(index))])

        def ask(asks: pa.Table) -> pa.Table:
            queries = matrix(asks.column("vector"), np.float64)
            ids = asks.column("query").to_numpy()
            parts = []
            for i in range(0, len(queries), 512):
                mine = queries[i : i + 512]
                near = np.hstack([mine, np.zeros((len(mine), 1))]).astype(np.float32)
                if len(points) <= max(beam, 2 * k):  # the beam would hold all of them
                    found = np.broadcast_to(np.arange(len(points)), (len(mine), len(points)))
                else:
                    found, _ = beam_search(points, squares, edges, medoid, near, max(beam, 2 * k))
                score = np.einsum("qnd,qd->qn", exact[found], mine)
                parts.append(top_rows(index.column("ids"), found, score, ids[i : i + 512], k))
            return pa.concat_tables(parts)

        return ask

    return find


def nearest_neighbours(
    vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 8192, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Approximately the ``k`` rows of largest inner product with each row whose id is divisible by ``every``.

    Every usable row is indexed and is a candidate of all queries but its own. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do null ids; vectors of different lengths never meet.
    Returns query_id, rank (from 1), vec_id, score (the inner product in double precision), best first and ties to the
    smaller vec_id; fewer than ``k`` rows where there are fewer candidates. Repeated rows count once; of rows that
    share an id but not the vector, the one of the least vector counts. An empty table gives an empty table.
    """
    vector = F.col(vector_col)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    return search(rows, F.col("vec_id") % every == 0, k, shard_rows, _build, INDEX, _finder(k, beam), "double")
