"""Operator 4: exact token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol for each byte. The adjacent pair of the lowest rank is popped from a heap and merged
until no ranked pair is left; the piece's tokens are its first symbols less the merges. No token ids are made.
Counts of distinct pieces are kept in a bounded table in each Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.pretoken import Splitter, WordTable, byte_letters, distinct, load_vocabulary
from chronoweave.llm.textbytes import text_chunks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeCounter:
    """Counts the tokens of texts from the ranked merges of a byte-level vocabulary."""

    def __init__(self, vocabulary: str):
        d = json.loads(vocabulary)
        merges = d["model"]["merges"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges)
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.splitter = Splitter({t["content"]: t["id"] for t in d["added_tokens"]})
        self.table = WordTable()

    def piece(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        size = len(raw)
        if size < 2:
            return size
        symbols: list = [self.letters[b] for b in raw]
        ranks = self.ranks
        heap = [(r, i) for i in range(size - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return size
        heapq.heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= size or ranks.get((left, symbols[j])) != rank:
                continue  # a neighbour was merged since this pair was pushed
            merges += 1
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := ranks.get((left, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], left))) is not None:
                heapq.heappush(heap, (r, h))
        return size - merges

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        starts, ends, bounds, special = self.splitter.split(data, offsets)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        keys, first, inverse = distinct(data, starts, ends)
        new = self.table.missing(keys)
        raw = data.tobytes()
        counts = np.array([self.piece(raw[a:b]) for a, b in zip(starts[first[new]], ends[first[new]])], np.int64)
        self.table.add(keys[new], np.ones(len(counts), np.int64), counts)
        each = self.table.lists()[1][self.table.rows(keys)][inverse].astype(np.int64)
        each[np.searchsorted(starts, list(special))] = 1
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


_COUNTERS: dict[int, MergeCounter] = {}


def _counter(vocabulary: str) -> MergeCounter:
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = MergeCounter(vocabulary)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the vocabulary's own library counts them.

    Args: ``docs`` with any further columns; ``vocabulary_path`` a byte-level ``tokenizers`` file, read on the driver
    and broadcast (a fixed 2 MB); ``limit`` the token count that ``over_limit`` marks as exceeded.
    Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null or empty text has no tokens;
    repeated rows and null ids are kept; an empty table gives an empty table.
    """
    vocabulary, _ = load_vocabulary(vocabulary_path)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            column = batch.column(1)
            sizes, tokens = [], []
            for _, _, data, offsets in text_chunks(column):
                sizes.append(np.diff(offsets))
                tokens.append(counter.count(data, offsets))
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
