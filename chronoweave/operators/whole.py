"""Measures of graphs that one task holds, over numbered vertices and arcs listed both ways; rounds are loops in memory.

Each gives the same as the rounds of joins that larger graphs take.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.tiles import arcs_of, summed


def in_one_task(nodes: DataFrame, tile: DataFrame, solve: Callable[..., dict], shape: str) -> DataFrame:
    """``shape``: what ``solve`` makes of all (x, ...) nodes, in order, and the x, y and w of the only tile's arcs."""

    def run(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held = held.drop(columns="_one").sort_values("x")
        return pd.DataFrame({"x": held["x"].to_numpy()} | solve(held, *arcs_of(rows)))

    one = [rows.withColumn("_one", F.lit(0)).groupBy("_one") for rows in (nodes, tile)]
    return one[0].cogroup(one[1]).applyInPandas(run, f"x long, {shape}")


def least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component: greater roots hang themselves under lesser ones."""
    up = np.arange(n)
    while len(x):
        a, b = up[x], up[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
    return up


def bounds_of(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the arcs out of v are ``order[bounds[v]:bounds[v + 1]]``."""
    order = np.argsort(x, kind="stable")
    return order, np.searchsorted(x[order], np.arange(n + 1))


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all the ranges."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else size


def cores(n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Core numbers by peeling: what falls to k or less goes, its neighbours lose its edges."""
    order, bounds = bounds_of(n, x)
    y, w = y[order], w[order]
    degree = np.zeros(n, np.int64)
    np.add.at(degree, x, w)
    core, left, k = np.zeros(n, np.int64), np.ones(n, bool), 0
    while left.any():
        by = np.flatnonzero(left)
        k = max(k, int(degree[by].min()))
        gone = by[degree[by] <= k]
        while len(gone):
            core[gone], left[gone] = k, False
            arcs = runs(bounds[gone], bounds[gone + 1])
            arcs = arcs[left[y[arcs]]]
            np.subtract.at(degree, y[arcs], w[arcs])
            gone = np.unique(y[arcs][degree[y[arcs]] <= k])
    return core


def cuts_and_bridges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut, bridge): whether each vertex and each of the (a, b) edges splits its component when it goes."""
    order, bounds = bounds_of(n, np.concatenate([a, b]))
    others, edges = np.concatenate([b, a])[order].tolist(), (order % max(1, len(a))).tolist()
    ends, at = bounds[1:].tolist(), bounds[:-1].tolist()
    number, low = [-1] * n, [0] * n
    cut, bridge, count = np.zeros(n, bool), np.zeros(len(a), bool), 0
    for top in range(n):
        if number[top] >= 0:
            continue
        number[top] = low[top] = count
        count += 1
        path, branches = [(top, -1)], 0
        while path:
            v, by = path[-1]
            i = at[v]
            if i < ends[v]:
                at[v] = i + 1
                u, e = others[i], edges[i]
                if e == by:
                    continue
                if number[u] < 0:
                    number[u] = low[u] = count
                    count += 1
                    path.append((u, e))
                elif number[u] < low[v]:
                    low[v] = number[u]
                continue
            path.pop()
            if not path:
                break
            p = path[-1][0]
            if low[v] < low[p]:
                low[p] = low[v]
            if low[v] > number[p]:
                bridge[by] = True
            if p == top:
                branches += 1
            elif low[v] >= number[p]:
                cut[p] = True
        cut[top] = branches > 1
    return cut, bridge


def settled(turns: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int) -> np.ndarray:
    """The communities of ``communities``, by their least members; ``turns[level]`` has a bit for each round."""
    n, total = len(turns[0]), int(w.sum())
    kind = np.int64 if total < 1 << 31 else np.longdouble  # exact for products of weights
    first, of, v = (x, y), np.arange(n), np.arange(n)
    k = np.zeros(n, np.int64)
    np.add.at(k, x, w)
    for level in turns:
        turn, told, quiet, moved = level[v], np.arange(len(v)), 0, False
        for i in range(rounds):
            weight = np.zeros(len(v), np.int64)
            np.add.at(weight, told, k)
            goes, into = _moves(told, k.astype(kind), weight, *summed(x, told[y], w), total, kind)
            mine = turn[goes] >> i & 1 == 1
            told[goes[mine]] = into[mine]
            quiet, moved = (0, True) if mine.any() else (quiet + 1, moved)
            if quiet == 2:
                break
        if not moved:
            break
        heads, into = np.unique(told, return_inverse=True)
        of, v = into[of], v[heads]
        a, b = into[x], into[y]
        x, y, w = summed(a[a != b], b[a != b], w[a != b])
        k, was = np.zeros(len(heads), np.int64), k
        np.add.at(k, into, was)
    x, y = first
    same = of[x] == of[y]
    return least_reached(n, x[same], y[same])


def _moves(told: np.ndarray, k: np.ndarray, weight: np.ndarray, at: np.ndarray, c: np.ndarray, w: np.ndarray, total: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(v, community): the vertices that gain by a move, and the best (least of equal ones) neighbour community of each."""
    if not len(at):
        return at, c
    home = c == told[at]
    gain = w.astype(kind) * kind(total) - k[at] * (weight[c] - np.where(home, k[at], 0))
    stay = -k * (weight[told] - k)
    stay[at[home]] = gain[home]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    best = np.maximum.reduceat(gain, start)
    top = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[start, len(at)])))  # in order of c
    top = top[np.r_[True, at[top][1:] != at[top][:-1]]]
    v = at[top]
    goes = best > stay[v]
    return v[goes], c[top][goes]


def ranks(n: int, x: np.ndarray, y: np.ndarray, degree: np.ndarray, damping: float, tolerance: float, rounds: int) -> np.ndarray:
    """The rounds of ``pagerank``; ``degree`` counts arcs to anywhere, 0 where there are none."""
    loose, rank = degree == 0, np.full(n, 1.0 / n)
    for i in range(1, rounds + 1):
        share = np.divide(rank, degree, out=np.zeros(n), where=~loose)
        was, rank = rank, (1 - damping) / n + damping * (np.bincount(y, share[x], n) + rank[loose].sum() / n)
        if i % 4 == 0 and np.abs(rank - was).sum() < tolerance:
            break
    return rank


class Sums:
    """Sums over arcs into each vertex of rows of a matrix, some targets at a time.

    Targets go by falling number of arcs, so the i-th arcs of a block of them are a slice; wide targets go alone.
    """

    ROWS, WIDE = 256, 4096

    def __init__(self, n: int, x: np.ndarray, y: np.ndarray):
        order, bounds = bounds_of(n, y)
        self.n, self.x, size = n, x[order], np.diff(bounds)
        by = np.argsort(-size, kind="stable")
        by = by[size[by] > 0]
        self.wide = [(v, self.x[bounds[v] : bounds[v + 1]]) for v in by[size[by] > self.WIDE].tolist()]
        by = by[size[by] <= self.WIDE]
        self.blocks = []
        for lo in range(0, len(by), self.ROWS):
            mine = by[lo : lo + self.ROWS]
            longest = int(size[mine[0]])
            many = np.searchsorted(-size[mine], -np.arange(longest), "left").tolist()  # targets with more than i arcs
            grid = np.concatenate([self.x[bounds[mine[:m]] + i] for i, m in enumerate(many)])
            self.blocks.append((mine, many, grid))

    def of(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The sums for ``wanted`` targets (and some others)."""
        out, live = np.zeros_like(rows), rows.any(axis=1)
        for v, x in self.wide:
            x = x[live[x] & wanted[v]]
            for lo in range(0, len(x), self.WIDE):
                out[v] += rows[x[lo : lo + self.WIDE]].sum(axis=0)
        for mine, many, grid in self.blocks:
            if wanted[mine].any() and live[grid].any():
                acc, at = np.zeros((len(mine), rows.shape[1])), 0
                for m in many:
                    acc[:m] += rows[grid[at : at + m]]
                    at += m
                out[mine] = acc
        return out


def dependencies(sums: Sums, hang: np.ndarray, ids: np.ndarray, times: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Brandes' dependencies on all vertices of the sources ``ids``, times how often each counts (see ``betweenness``)."""
    n, k = len(hang), len(ids)
    level, paths, cols = np.full((n, k), -1, np.int16), np.zeros((n, k)), np.arange(k)
    level[ids, cols], paths[ids, cols] = 0, 1.0
    wave, far = paths, 0
    while wave.any():  # as many rounds as the longest shortest path
        far += 1
        new = level < 0
        met = sums.of(wave, new.any(axis=1))
        mine = new & (met > 0)
        level[mine] = far
        wave = np.where(mine, met, 0.0)
        paths = paths + wave
    delta = np.repeat(hang.astype(np.float64)[:, None], k, axis=1)
    met = None
    for at in range(far - 1, -1, -1):
        mine = level == at
        if met is not None:
            delta += np.where(mine, paths * met, 0.0)
        if at:
            met = sums.of(np.divide(1 + delta, paths, out=np.zeros_like(paths), where=mine), (level == at - 1).any(axis=1))
    return np.where(level > 0, delta, 0.0) @ times + np.where(level == 0, delta - 1, 0.0) @ leaves
