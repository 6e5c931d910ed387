"""What the two vector searches share: classes of equal vectors, shards of rows that queries stream through, the merge.

Equal vectors form one class that keeps the ids a result can show (the k + 1 smallest), so a vector that a third of
all rows hold is indexed and searched once. Classes are dealt to shards by a hash. A shard's index rows come first in
their partition and are read once; the queries follow as a stream, and the best of every shard are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.stash import stash

FOUND = "query long, vec_id long, score {score}"
#: Query rows searched at a time.
QUERY_ROWS = 4096


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """(vec_id, vector): of rows that share an id, the one of the least vector."""
    again = stash(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    held = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(again, "vec_id", "left_anti").unionByName(held)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(cls, vector, ids) from (vec_id, vector): the k + 1 smallest ids of each distinct vector; cls is the smallest."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_r", first).filter(F.col("_r") <= k + 1)  # limited before the shuffle too
    held = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return held.select(F.element_at("ids", 1).alias("cls"), "vector", "ids")


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def top_rows(ids: pa.ChunkedArray, place: np.ndarray, score: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """The k + 1 best (score descending, then id) rows of each query, from classes ``place`` [query, candidate].

    A place of -1 is no candidate.
    """
    held = ids.combine_chunks()
    bounds, flat = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten().to_numpy()
    q, j = np.nonzero(place >= 0)
    p = place[q, j]
    sizes = bounds[p + 1] - bounds[p]
    row = np.repeat(np.arange(len(p)), sizes)
    vec = flat[np.repeat(bounds[p] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
    q, s = q[row], score[q[row], j[row]]
    order = np.lexsort((vec, -s, q))
    q, vec, s = q[order], vec[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank <= k
    return pa.table({"query": queries[q[keep]], "vec_id": vec[keep], "score": s[keep]})


def merge(found: DataFrame, k: int) -> DataFrame:
    """(query, best): the k + 1 best (score, vec_id) of each query class over all shards, as one array."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    few = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    return few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("best"))


def neighbours(asking: DataFrame, merged: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row of (query_id, query) without itself, k at most."""
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    rows = asking.join(merged, "query").select("query_id", F.posexplode(own).alias("i", "b"))
    return rows.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _streamed(find: Callable[[pa.Table], Callable[[pa.Table], pa.Table]]):
    """A function of Arrow batches sorted by (shard, dim, kind): index rows (kind 0) make a searcher, queries use it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "kind")], axis=1)
            cuts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))) if len(marks) else []
            for a, b in zip(cuts, [*cuts[1:], len(marks)]):
                shard, kind, part = tuple(marks[a, :2]), marks[a, 2], batch.slice(a, b - a)
                if shard != at:
                    at, held, ready = shard, [], None
                if kind == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        ready = find(pa.Table.from_batches(held))
                    for i in range(0, part.num_rows, QUERY_ROWS):
                        yield from ready(pa.Table.from_batches([part.slice(i, QUERY_ROWS)])).to_batches()

    return run


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    shard_rows: int,
    build: Callable[[pa.Table], pa.Table],
    index_schema: str,
    find: Callable[[pa.Table], Callable[[pa.Table], pa.Table]],
    score_type: str,
    pilot: bool = False,
) -> DataFrame:
    """Neighbours of the query rows of (vec_id, vector) among all rows of the same dimension.

    ``build`` turns the classes of a shard into index rows once; ``find`` makes of a shard's index rows a function that
    searches it with query rows. With ``pilot`` each query first searches one shard, and its k-th score reaches the
    others in column ``floor``.
    """
    rows = one_row_an_id(rows)
    classes = stash(vector_classes(rows, k).withColumn("dim", F.size("vector")))
    shards = max(1, -(-classes.count() // shard_rows))
    index = classes.withColumn("shard", F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(shards)).cast("int")).groupBy("shard", "dim").applyInArrow(build, index_schema)
    index = stash(index) if pilot and shards > 1 else index
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    asking = stash(asked.join(classes.select("cls", "vector"), "vector").select("query_id", F.col("cls").alias("query")))
    queries = classes.join(asking.select(F.col("query").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("query"), "vector", "dim")
    home = F.pmod(F.xxhash64("query", F.lit(6)), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))

    def visit(asks: DataFrame) -> DataFrame:
        mine = index.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return mine.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind").mapInArrow(_streamed(find), FOUND.format(score=score_type))

    unknown = F.lit(None).cast(score_type).alias("floor")
    if not pilot or shards == 1:
        return neighbours(asking, merge(visit(queries.select("query", "vector", "dim", unknown, every.alias("shard"))), k), k)
    first = stash(visit(queries.select("query", "vector", "dim", unknown, home.alias("shard"))))
    floors = first.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    rest = queries.join(floors, "query", "left").select("query", "vector", "dim", "floor", every.alias("shard")).filter(F.col("shard") != home)
    return neighbours(asking, merge(first.unionByName(visit(rest)), k), k)
