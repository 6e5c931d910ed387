"""Operator 2: exact top-k inner products of quantised vectors by ball-tree branch and bound.

Each shard's distinct vectors are split into a tree of balls. A ball's largest possible inner product with a query is
``query . centre + |query| radius``. A query first goes down to the leaf of the best bound, which gives it a k-th score
unless a pilot shard has found a better one; then it goes down the tree level by level, leaves out every subtree whose
bound is below that score before looking inside, and visits the leaves that are left by falling bound.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.vector_search import matrix, search, top_rows, usable

LEAF = 128
INDEX = "shard int, dim int, place int, ids array<long>, vector array<long>"
#: Beyond this a sum of products may not be exact in a double.
EXACT = 2.0**53


class Tree(NamedTuple):
    """Balls with their two children (-1 in a leaf) and the range of places that they hold."""

    centres: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    first: np.ndarray
    last: np.ndarray


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """(tree, order): the tree's places number the points in ``order``."""
    centres, radii, children, first, last, order = [], [], [], [], [], []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:  # the first child before the second, so that a ball's places follow one another
        rows, parent, side = todo.pop()
        mine = points[rows]
        centre = mine.mean(axis=0)
        away = np.sqrt(((mine - centre) ** 2).sum(axis=1))
        node = len(centres)
        if parent >= 0:
            children[parent][side] = node
        centres.append(centre)
        radii.append(away.max() * (1 + 1e-9) + 1e-9)
        children.append([-1, -1])
        first.append(sum(map(len, order)) if len(rows) <= leaf else -1)
        last.append(first[-1] + len(rows) if len(rows) <= leaf else -1)
        if len(rows) <= leaf:
            order.append(rows)
            continue
        one = mine[away.argmax()]
        two = mine[((mine - one) ** 2).sum(axis=1).argmax()]
        by = np.argsort(mine @ (two - one), kind="stable")
        half = len(rows) // 2
        todo += [(rows[by[half:]], node, 1), (rows[by[:half]], node, 0)]
    return Tree(np.array(centres), np.array(radii), np.array(children), np.array(first), np.array(last)), np.concatenate(order)


def search_tree(points: np.ndarray, rank: np.ndarray, tree: Tree, queries: np.ndarray, floor: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the ``keep`` best points of each query, ties to the smaller ``rank``, and the balls bounded."""
    norms = np.sqrt((queries**2).sum(axis=1))
    best = np.full((len(queries), keep), -np.inf)
    place = np.full((len(queries), keep), -1, np.int64)
    ranks = np.append(rank, np.iinfo(np.int64).max)
    bounded = 0

    def bound(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        nonlocal bounded
        bounded += len(q)
        value = np.einsum("qd,qd->q", queries[q], tree.centres[node]) + norms[q] * tree.radii[node]
        return value + np.abs(value) * 1e-9 + 1e-6

    def visit(q: np.ndarray, leaf: np.ndarray) -> None:
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            mine, rows = q[part], np.arange(tree.first[leaf[part[0]]], tree.last[leaf[part[0]]])
            scores = np.concatenate([best[mine], queries[mine] @ points[rows].T], axis=1)
            places = np.concatenate([place[mine], np.broadcast_to(rows, (len(mine), len(rows)))], axis=1)
            top = np.lexsort((ranks[places], -scores), axis=1)[:, :keep]
            best[mine], place[mine] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(places, top, axis=1)

    every = np.arange(len(queries))
    home = np.zeros(len(queries), np.int64)
    while len(down := np.flatnonzero(tree.children[home, 0] >= 0)):
        kids = tree.children[home[down]]
        home[down] = np.where(bound(down, kids[:, 0]) >= bound(down, kids[:, 1]), kids[:, 0], kids[:, 1])
    visit(every, home)

    q, node, most = every, np.zeros(len(queries), np.int64), np.full(len(queries), np.inf)
    found = []
    while len(q):
        is_leaf = tree.children[node, 0] < 0
        found.append((q[is_leaf], node[is_leaf], most[is_leaf]))
        kids = tree.children[node[~is_leaf]]
        q, most = np.repeat(q[~is_leaf], 2), np.repeat(most[~is_leaf], 2)
        node = kids.ravel()
        most = np.minimum(most, bound(q, node))
        open_ = most >= np.maximum(best[q, -1], floor[q])
        q, node, most = q[open_], node[open_], most[open_]
    q, node, most = (np.concatenate(x) for x in zip(*found))
    away = node != home[q]
    q, node, most = q[away], node[away], most[away]
    by = np.lexsort((-most, q))
    q, node, most = q[by], node[by], most[by]
    turn = np.arange(len(q)) - np.searchsorted(q, q)
    for now in range(turn.max(initial=-1) + 1):
        mine = np.flatnonzero(turn == now)
        mine = mine[most[mine] >= np.maximum(best[q[mine], -1], floor[q[mine]])]
        if len(mine):
            visit(q[mine], node[mine])
    return place, best, bounded


def exact_products(points: np.ndarray, places: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) like ``search_tree`` for whole numbers of any size: doubles propose, Python's integers decide."""
    place = np.full((len(queries), keep), -1, np.int64)
    score = np.zeros((len(queries), keep), np.int64)
    rough, wide = points.astype(np.float64), points.astype(object)
    lengths = np.sqrt((rough**2).sum(axis=1))
    for i, query in enumerate(queries):
        mine = query.astype(np.float64)
        value = rough @ mine
        slack = (lengths * np.sqrt((mine**2).sum())) * (len(mine) * 2.0**-51)
        low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (value - slack, value + slack))
        some = np.flatnonzero(high >= np.sort(low)[-min(keep, len(low))])
        told = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in wide[some] @ query.astype(object)]
        top = sorted(range(len(some)), key=lambda j: (-told[j], places[some[j]]))[:keep]
        place[i, : len(top)] = places[some[top]]
        score[i, : len(top)] = [told[j] for j in top]
    return place, score


def _builder(leaf: int):
    def build(table: pa.Table) -> pa.Table:
        """Index rows numbered by leaf, so that a reader finds the same balls without splitting again."""
        points = matrix(table.column("vector"), np.float64)
        _, order = ball_tree(points, leaf)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return pa.table({"shard": table.column("shard"), "dim": table.column("dim"), "place": place, "ids": table.column("ids"), "vector": table.column("vector")})

    return build


def numbered_tree(points: np.ndarray, leaf: int) -> Tree:
    """The tree of points that are in its order already: halves of halves."""
    centres, radii, children, first, last = [], [], [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        centre = points[a:b].mean(axis=0)
        if parent >= 0:
            children[parent][side] = len(centres)
        centres.append(centre)
        radii.append(np.sqrt(((points[a:b] - centre) ** 2).sum(axis=1)).max() * (1 + 1e-9) + 1e-9)
        children.append([-1, -1])
        first.append(a)
        last.append(b)
        if b - a > leaf:
            half = a + (b - a) // 2
            todo += [(half, b, len(centres) - 1, 1), (a, half, len(centres) - 1, 0)]
    return Tree(np.array(centres), np.array(radii), np.array(children), np.array(first), np.array(last))


def _finder(k: int, leaf: int):
    def find(index: pa.Table) -> Callable[[pa.Table], pa.Table]:
        index = index.sort_by("place")
        held = index.column("ids").combine_chunks()
        smallest = held.flatten().to_numpy()[held.offsets.to_numpy()[:-1] - held.offsets[0].as_py()]
        whole = matrix(index.column("vector"), np.int64)
        dim = whole.shape[1]
        most = int((EXACT / dim) ** 0.5)  # products of components up to this add up exactly
        is_big = (np.abs(whole.astype(np.float64)) > most).any(axis=1)
        small, big = np.flatnonzero(~is_big), np.flatnonzero(is_big)
        points = whole[small].astype(np.float64)
        # with large rows taken out the halves no longer match: split again
        tree, order = (numbered_tree(points, leaf), None) if not len(big) else ball_tree(points, leaf) if len(small) else (None, None)
        if order is not None:
            small, points = small[order], points[order]

        def ask(asks: pa.Table) -> pa.Table:
            queries = matrix(asks.column("vector"), np.int64)
            names = asks.column("query").to_numpy()
            large = (np.abs(queries.astype(np.float64)) > most).any(axis=1)
            floor = asks.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor - np.abs(floor) * 2.0**-50)
            parts = []
            some = np.flatnonzero(~large)
            if len(some) and len(small):
                place, score, _ = search_tree(points, smallest[small], tree, queries[some].astype(np.float64), floor[some], k + 1)
                parts.append((some, np.where(place >= 0, small[place], -1), np.where(place >= 0, score, 0).astype(np.int64)))
            for mine, rows in ((some, big), (np.flatnonzero(large), np.arange(len(whole)))):
                if len(mine) and len(rows):
                    by = rows[np.argsort(smallest[rows], kind="stable")]
                    place, score = exact_products(whole[by], np.arange(len(by)), queries[mine], k + 1)
                    parts.append((mine, np.where(place >= 0, by[place], -1), score))
            return pa.concat_tables([top_rows(index.column("ids"), place, score, names[mine], k) for mine, place, score in parts])

        return ask

    return find


def exact_top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 8192, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest inner products of each row whose id is divisible by ``every``, of floor(scale * component).

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths never meet. Returns query_id, rank (from 1), vec_id, score (long), ties to the smaller vec_id;
    fewer than ``k`` rows where there are fewer candidates. Repeated rows count once; of rows that share an id but not
    the vector, the one of the least vector counts. An empty table gives an empty table. Components and products that
    do not fit 64 bits are held at the bounds of a long; all others are exact.
    """
    vector = F.col(vector_col)
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector))
    # a long holds what a double beyond it would be cut to
    held = lambda x: F.when(x >= F.lit(2.0**63), F.lit((1 << 63) - 1)).when(x <= F.lit(-(2.0**63)), F.lit(-(1 << 63))).otherwise(F.floor(x).cast("long"))
    cells = F.transform(vector, lambda x: held(x.cast("double") * scale))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), cells.alias("vector"))
    return search(rows, F.col("vec_id") % every == 0, k, shard_rows, _builder(leaf), INDEX, _finder(k, leaf), "long", pilot=True)
