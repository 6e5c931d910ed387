"""Operator 13: removal of repeated passages behind a count-min prefilter.

A window is 50 consecutive words. What stands for it in the sketch is its least 8-word gram by hash: equal windows have
the same one, so the number of documents with that gram is never below the number with the window. Each batch of rows
makes a sparse count-min sketch (cells and counts of its documents' grams, in two rows of cells); the sketches are
merged by addition. A second pass takes the windows whose estimate is two or more documents and groups exactly these by
128-bit hashes of all their words, for the least doc_id of each. Documents of the same words are one case of this that
needs no windows: all but those of the least id go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.textbytes import mix, powers, span_hashes, text_chunks, word_spans
from chronoweave.plans.stash import drop_stash, stash

#: Words of the gram that stands for a window.
GRAM = 8
#: Cells of the sketch for each gram of the documents, in each of its two rows.
CELLS_A_GRAM = 4
_SALTS = (np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165))


def rolled(word: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(word) + 1)
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(mix(word) * up[: len(word)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers, from running minima to both sides of block borders."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def window_grams(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, its first word in the text, its standing gram, word hashes); windows lie in one text."""
    starts, ends, bounds = word_spans(data, offsets)
    word = span_hashes(data, starts, ends)
    gram = min(GRAM, width)
    grams = least_within(rolled(word, gram), width - gram + 1)
    at = np.arange(len(grams))
    text = np.searchsorted(bounds, at, side="right") - 1
    inside = at + width <= bounds[text + 1]
    return text[inside], (at - bounds[text])[inside], grams[inside], word


#: A row of the input: its document and a hash that tells rows of one id apart.
ROW = ["doc_id", "key"]
ROW_SHAPE = "doc_id long, key long"


def profiles(docs: DataFrame) -> DataFrame:
    """(ROW, n_words, sha) of the (ROW, text) rows; ``sha`` is that of all words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column(2):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], [*ROW, "n_words", "sha"])

    return docs.select(*ROW, "text").mapInArrow(run, f"{ROW_SHAPE}, n_words long, sha string")


def grams_of(docs: DataFrame, width: int) -> DataFrame:
    """(ROW, gram): the standing grams of each text's windows, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2)):
                text, _, gram, _ = window_grams(data, offsets, width)
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                text, gram = text[new], gram[new]
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                rows = pa.array(a + text[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(gram[new].view(np.int64))], [*ROW, "gram"])

    return docs.select(*ROW, "text").mapInArrow(run, f"{ROW_SHAPE}, gram long")


def _cell(gram: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(gram ^ _SALTS[row]) & np.uint64(width - 1)).view(np.int64)


def partition_sketches(grams: DataFrame, width: int) -> DataFrame:
    """(row, cell, documents): a sparse count-min sketch of every batch of (ROW, gram) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(np.uint64)
            for row in (0, 1):
                cell, count = np.unique(_cell(gram, row, width), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), row, np.int32)), pa.array(cell), pa.array(count)], ["row", "cell", "documents"])

    return grams.mapInArrow(run, "row int, cell long, documents long")


def estimated_repeats(grams: DataFrame, width: int) -> DataFrame:
    """The (ROW, gram) rows whose gram stands in two documents or more by both rows of the merged sketch of ``width`` cells."""
    merged = partition_sketches(grams, width).groupBy("row", "cell").agg(F.sum("documents").alias("documents"))
    crowded = stash(merged.filter("documents >= 2").select("row", "cell"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*ROW, "gram")), *(pa.array(_cell(gram, row, width)) for row in (0, 1))], [*ROW, "gram", "c0", "c1"])

    placed = grams.select(*ROW, "gram").mapInArrow(place, f"{ROW_SHAPE}, gram long, c0 long, c1 long")
    for row in (0, 1):
        placed = placed.join(crowded.filter(f"row = {row}").select(F.col("cell").alias(f"c{row}")), f"c{row}", "left_semi")
    out = stash(placed.select(*ROW, "gram"))
    drop_stash(crowded)
    return out


def suspect_windows(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(ROW, place, h1, h2): windows of the texts whose standing gram is among the text's (ROW, gram) ``marks``."""
    held = marks.groupBy(*ROW).agg(F.collect_list("gram").alias("grams"))  # at most one a word of a text
    met = docs.join(held, ROW).select(*ROW, "text", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(2)):
                text, place, gram, word = window_grams(data, offsets, width)
                first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))) if len(gram) else np.zeros(0, np.int64)
                bounds = np.searchsorted(text[first], np.arange(b - a + 1))
                hit = np.zeros(len(first), bool)
                for i in range(b - a):
                    mine = slice(bounds[i], bounds[i + 1])
                    hit[mine] = np.isin(gram[first[mine]], batch.column(3)[a + i].values.to_numpy().view(np.uint64))
                keep = np.flatnonzero(np.repeat(hit, np.diff(np.append(first, len(gram)))))
                counts = np.diff(np.searchsorted(word_spans(data, offsets)[0], offsets))
                at = (np.cumsum(counts) - counts)[text[keep]] + place[keep]
                hashes = [rolled(w, width)[at].view(np.int64) for w in (word, mix(word ^ _SALTS[0]))] if len(at) else [np.zeros(0, np.int64)] * 2
                rows = pa.array(a + text[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[keep].astype(np.int32)), *map(pa.array, hashes)], [*ROW, "place", "h1", "h2"])

    return met.mapInArrow(run, f"{ROW_SHAPE}, place int, h1 long, h2 long")


def _cut(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(ROW, n_removed, kept): of the texts with (ROW, places), the words gone and the SHA-256 of what stays."""
    met = docs.select(*ROW, "text").join(places, ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha = [], []
            for text, held in zip(batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                place = held.values.to_numpy()
                np.add.at(edge, place, 1)
                np.add.at(edge, place + width, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [*ROW, "n_removed", "kept"])

    return met.mapInArrow(run, f"{ROW_SHAPE}, n_removed long, kept string")


def passage_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a window of ``width`` words covers which also starts in a document of a smaller doc_id.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).
    Windows are judged on the input. A null text is empty, and texts below ``width`` words stay whole. Rows of one
    doc_id are one document, whose windows do not remove each other; a row without an id neither loses words nor makes
    others lose any. Further columns do no harm; an empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    whole = stash(profiles(docs))
    able = whole.filter((F.col("n_words") >= width) & F.col("doc_id").isNotNull())
    leads = stash(able.groupBy("sha").agg(F.min("doc_id").alias("doc_id")))
    ours = leads.join(able, ["sha", "doc_id"]).select(*ROW)
    grams = stash(grams_of(docs, width).join(ours, ROW, "left_semi"))
    cells = 1 << max(10, (CELLS_A_GRAM * grams.count()).bit_length())
    marks = estimated_repeats(grams, cells)
    drop_stash(grams)
    suspects = stash(suspect_windows(docs, marks, width))
    # Written, so that the join below has two plain shuffles, of which Spark can split a large partition.
    least = suspects.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h1", "h2", "least")
    least = stash(least)
    gone = suspects.join(least, ["h1", "h2"]).filter("least < doc_id").select(*ROW, "place").distinct()
    places = stash(gone.groupBy(*ROW).agg(F.collect_list("place").alias("places")))  # at most one a word of a text
    for done in (marks, suspects, least):
        drop_stash(done)
    cut = stash(_cut(docs, places, width).distinct())
    drop_stash(places)
    gone_whole = (F.col("n_words") >= width) & F.col("doc_id").isNotNull() & (F.col("lead") < F.col("doc_id"))
    rows = whole.join(leads.select("sha", F.col("doc_id").alias("lead")), "sha", "left").join(cut, ROW, "left")
    rows = rows.select(
        "doc_id", "n_words",
        F.when(gone_whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone_whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    out = stash(rows)
    for done in (whole, leads, cut):
        drop_stash(done)
    return out
