"""Operator 11: ranked lexical search by bag deduplication.

Documents are restricted to the words of the items. Those with the same restricted bag and the same length factor form
a class: a hash of both finds it, and the bag itself is part of the grouping key, so equal hashes alone join nothing. A class
is scored once against all items, as a product of a small dense matrix of its terms with the items' term counts. An
item's best documents lie in its best classes, which are then expanded by ascending doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.textbytes import LOWER, PUNCTUATION, span_hashes, text_chunks, word_spans
from chronoweave.plans.stash import drop_stash, stash

#: Items and distinct words of one block; a block's tables go to every task, further blocks read the classes again.
BLOCK_ITEMS = 512
BLOCK_TERMS = 1 << 15
#: Cells of a dense matrix in a task.
CELLS = 1 << 22


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, bounds of the texts): runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, PUNCTUATION)
    return span_hashes(low, starts, ends), bounds


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of the (item, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                term, bounds = term_counts(data, offsets)
                for i in range(b - a):
                    found, times = np.unique(term[bounds[i] : bounds[i + 1]], return_counts=True)
                    name = names.slice(a + i, 1).take(pa.array(np.zeros(len(found), np.int64)))
                    yield pa.RecordBatch.from_arrays([name, pa.array(found.view(np.int64)), pa.array(times)], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times long")


def bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: all its terms, and the sorted ones of the ``vocabulary`` with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                term, bounds = term_counts(data, offsets)
                spot = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                mine = np.flatnonzero(vocabulary[spot] == term)
                text = np.searchsorted(bounds, mine, side="right") - 1
                cell, tf = np.unique(text * len(vocabulary) + spot[mine], return_counts=True)
                ends = np.searchsorted(cell // len(vocabulary), np.arange(b - a + 1)).astype(np.int32)
                terms = vocabulary[cell % len(vocabulary)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


def _blocks(told: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, their sorted terms, counts of each term in each item), block by block, of (item, term, times) rows."""
    told = told.sort_by([("item", "ascending"), ("term", "ascending")])
    item, term, times = (told.column(c).to_numpy() for c in ("item", "term", "times"))
    names, first = np.unique(item, return_index=True)
    first = np.append(first, len(item))
    at = 0
    while at < len(names):
        to = max(at + 1, min(at + BLOCK_ITEMS, int(np.searchsorted(first, first[at] + BLOCK_TERMS, side="right")) - 1))
        mine = slice(first[at], first[to])
        terms = np.unique(term[mine].view(np.uint64))
        counts = np.zeros((len(terms), to - at))
        counts[np.searchsorted(terms, term[mine].view(np.uint64)), np.repeat(np.arange(to - at), np.diff(first[at : to + 1]))] = times[mine]
        yield names[at:to], terms, counts
        at = to


def best_classes(classes: DataFrame, names: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, k: int) -> DataFrame:
    """(item, score, cls, least) of the ``k`` best classes of each item in every task, ties to the smallest ``least``.

    All is whole numbers: a score is a sum of products below 2**53, or else is added up in two halves.
    """
    split = float((weight * counts.T).sum(axis=1).max(initial=0)) * 1e6 >= 2**53

    def merged(held: list[np.ndarray]) -> list[np.ndarray]:
        item, score, cls, least = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((cls, least, -score, item))
        item, score, cls, least = item[order], score[order], cls[order], least[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < k
        return [item[keep], score[keep], cls[keep], least[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[np.zeros(0, np.int64)] * 4]
        step = max(1, CELLS // max(len(terms), len(names)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column("terms")
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy().view(np.uint64)
                tf = batch.column("tfs").flatten().to_numpy()
                spot = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                met = terms[spot] == term
                rows, spot, tf = rows[met], spot[met], tf[met]
                m = batch.column("m").to_numpy()[rows]
                part = weight[spot] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                dense = np.zeros((len(lists), len(terms)))
                if split:
                    dense[rows, spot] = part >> 20
                    score = (dense @ counts).astype(np.int64) << 20
                    dense[rows, spot] = part & ((1 << 20) - 1)
                    score += (dense @ counts).astype(np.int64)
                else:
                    dense[rows, spot] = part
                    score = (dense @ counts).astype(np.int64)
                least = batch.column("least").to_numpy()
                order = np.argsort(least, kind="stable")
                score, least, cls = score[order], least[order], batch.column("cls").to_numpy()[order]
                if len(order) > 4 * k:  # what is below an item's k-th score here is not among its k best
                    floor = np.maximum(np.partition(score, len(order) - k, axis=0)[len(order) - k], 1)
                    row, col = np.nonzero(score >= floor)
                else:
                    row, col = np.nonzero(score > 0)
                best.append([names[col], score[row, col], cls[row], least[row]])
                if len(best) > 8:
                    best = [merged(best)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(best)], ["item", "score", "cls", "least"])

    return classes.select("terms", "tfs", "m", "cls", "least").mapInArrow(run, "item long, score long, cls long, least long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item, over every whole text.

    Returns item_id, rank (int, from 1), doc_id, score; ties go by ascending doc_id. A null or empty text, of a document
    or an item, has no terms and no rank. Rows without an id take no part, though a document's are counted in the
    statistics; each repeated row is a document, and of an item's repeated rows the least text counts. Further columns
    do no harm; empty tables give an empty table. Terms are told apart by 64-bit hashes. Items go to the tasks in blocks
    of at most ``BLOCK_ITEMS`` items, and the terms of all items to the driver: a stated query set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    told = item_terms(items.filter("item is not null").groupBy("item").agg(F.min("text").alias("text"))).toArrow()
    vocabulary = np.unique(told.column("term").to_numpy().view(np.uint64))
    shape = "item_id long, rank int, doc_id long, score long"
    if not len(vocabulary):
        return spark.createDataFrame([], shape)
    held = stash(bags(docs, vocabulary))
    total = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], max(total["terms"] or 0, 1)
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L")
    members = held.filter(F.size("terms") > 0).withColumn("m", m).withColumn("cls", F.xxhash64("terms", "tfs", "m"))
    classes = stash(members.groupBy("cls", "m", "terms", "tfs").agg(F.count("*").alias("size"), F.min("doc_id").alias("least")))
    df = classes.select("size", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("size").alias("df"))
    weighed = df.select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).toArrow()
    w = np.zeros(len(vocabulary), np.int64)
    w[np.searchsorted(vocabulary, weighed.column("term").to_numpy().view(np.uint64))] = weighed.column("w").to_numpy()

    best = None
    for names, terms, counts in _blocks(told):
        mine = best_classes(classes.filter("least is not null"), names, terms, counts, w[np.searchsorted(vocabulary, terms)], k)
        best = mine if best is None else best.unionAll(mine)
    first = Window.partitionBy("item").orderBy(F.desc("score"), "least", "cls")
    best = stash(best.withColumn("r", F.row_number().over(first)).filter(f"r <= {k}").drop("r"))
    # The members of the classes that some item ranks, by hash and bag: the k smallest ids of each are all that any item
    # can list.
    bag = ["cls", "m", "terms", "tfs"]
    ranked = stash(classes.join(F.broadcast(best.select("cls", "least").distinct()) if len(told) <= 1_000_000 else best.select("cls", "least").distinct(), ["cls", "least"]).select("least", *bag))
    listed = members.filter("doc_id is not null").join(F.broadcast(ranked) if ranked.count() * len(vocabulary) <= 1_000_000 else ranked, bag).select("cls", "least", "doc_id")
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("cls", "least").orderBy("doc_id"))).filter(f"r <= {k}").drop("r")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = best.join(listed, ["cls", "least"]).withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    out = stash(found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score"))
    for done in (held, classes, best, ranked):
        drop_stash(done)
    return out
