"""Operator 7: packing documents into fixed-length sequences by cutting-stock column generation.

Every document is cut into full pieces and at most one remainder. Full pieces are sequences of their own. The
histogram of remainder lengths (fewer entries than the sequence length, whatever the corpus) goes to the driver, where
a linear program over patterns is solved by column generation: a knapsack dynamic program prices the next pattern, the
simplex basis takes it in. Rounded-down pattern counts plus a best-fit pass over the few lengths left give a plan, and
the documents, ranked inside each length, are assigned to the plan's slots on the executors.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.pretoken import Splitter, WordTable, distinct, load_vocabulary
from chronoweave.llm.textbytes import text_chunks
from chronoweave.plans.running import running_start
from chronoweave.plans.stash import stash

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CUT_SCHEMA = "doc_id long, doc_tokens long, crcs array<long>"


class Encoder:
    """Token ids of texts by the ``tokenizers`` library, asked once for each distinct pre-token a worker meets."""

    def __init__(self, vocabulary: str, specials: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.splitter = Splitter(specials)
        self.table = WordTable()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        starts, ends, bounds, special = self.splitter.split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, first, inverse = distinct(data, starts, ends)
        new = self.table.missing(keys)
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts[first[new]], ends[first[new]])]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self.table.add(keys[new], np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))
        where, flat = self.table.lists()
        rows = self.table.rows(keys)[inverse]
        begin, sizes = where[rows], where[rows + 1] - where[rows]
        if special:  # a special string was encoded as its own text, so its list is its id already
            spots = np.searchsorted(starts, list(special))
            assert (sizes[spots] == 1).all()
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return flat[np.arange(sums[-1]) + np.repeat(begin - sums[:-1], sizes)], sums[bounds]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: str, specials: dict[str, int]) -> Encoder:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, specials)
    return _ENCODERS[key]


def cut_documents(docs: DataFrame, vocabulary_path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_tokens, crcs): token counts with the end id, and a CRC-32 of each piece's little-endian ids."""
    vocabulary, specials = load_vocabulary(vocabulary_path)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, specials))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*held.value)
        for batch in batches:
            tokens: list[int] = []
            crcs: list[list[int]] = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                ids, bounds = encoder.ids(data, offsets)
                raw = memoryview(ids.astype("<u4").tobytes())
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    mine = [zlib.crc32(raw[4 * i : 4 * min(i + length, b)]) for i in range(a, b, length)]
                    if (b - a) % length:
                        mine[-1] = zlib.crc32(tail, mine[-1])
                    else:
                        mine.append(zlib.crc32(tail))
                    tokens.append(b - a + 1)
                    crcs.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, CUT_SCHEMA)


def _price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best unbounded knapsack: (value, copies of each size)."""
    worth = np.full(room + 1, -np.inf)
    worth[sizes] = values
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        tries = worth[1 : c + 1] + best[c - 1 :: -1]
        i = int(np.argmax(tries))
        if tries[i] > best[c - 1]:
            best[c], took[c] = tries[i], i + 1
        else:
            best[c] = best[c - 1]
    counts = np.zeros(room + 1, np.int64)
    c = room
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[room]), counts[sizes]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 1500, patience: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one row each: copies of every size) and whole-number uses that cover ``demand`` exactly or more.

    Column generation stops at the optimum, when the program's value is within ``gap`` of a lower bound, or when
    ``patience`` columns have not bettered it by a tenth of that. Uses are the program's solution rounded down; what remains is packed best-fit, longest first, into patterns of its own.
    """
    n = len(sizes)
    if not n:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    basis, x = _first_basis(sizes, demand, room)
    inverse = np.linalg.inv(basis)
    bound = float((sizes * demand).sum()) / room
    last, since = x.sum(), 0
    for _ in range(rounds):
        since += 1
        if since >= patience:
            if x.sum() > last * (1 - gap / 10):
                break
            last, since = x.sum(), 0
        prices = inverse.sum(axis=0)
        value, column = _price(prices, sizes, room)
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        step = inverse @ column
        ok = step > 1e-9
        ratio = np.full(n, np.inf)
        ratio[ok] = x[ok] / step[ok]
        out = int(np.argmin(ratio))
        move = ratio[out]
        x = np.maximum(x - move * step, 0)
        x[out] = move
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = column
    patterns, uses = basis.T.copy(), np.floor(x + 1e-7).astype(np.int64)
    left = demand - patterns.T @ uses
    while (left < 0).any():  # a rounding error of the solver made too many
        over = np.flatnonzero((patterns[:, int(np.argmin(left))] > 0) & (uses > 0))[0]
        uses[over] -= 1
        left = demand - patterns.T @ uses
    keep = uses > 0
    rest = _best_fit(sizes, left, room)
    return np.vstack([patterns[keep], rest]), np.concatenate([uses[keep], np.ones(len(rest), np.int64)])


def _first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A starting basis: each pattern takes the longest lengths that fit and is used until one length is used up.

    The length that a pattern uses up is in no later pattern, so the patterns are linearly independent.
    """
    n = len(sizes)
    left = demand.astype(float)
    open_sizes = list(range(n - 1, -1, -1))
    basis, x = np.zeros((n, n), np.int64), np.zeros(n)
    for column in range(n):
        free = room
        for i in open_sizes:
            if sizes[i] <= free:
                basis[i, column] = free // sizes[i] if not basis[:, column].any() else min(free // sizes[i], max(1, int(left[i] // max(left[open_sizes[0]], 1))))
                free -= basis[i, column] * int(sizes[i])
            if free < sizes[open_sizes[-1]]:
                break
        inside = np.flatnonzero(basis[:, column])
        ratio = left[inside] / basis[inside, column]
        gone = int(inside[np.argmin(ratio)])
        x[column] = ratio.min()
        left[inside] = np.maximum(left[inside] - x[column] * basis[inside, column], 0)
        left[gone] = 0
        open_sizes.remove(gone)
    return basis, x


def _best_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Patterns for the items left after rounding: fill each with the longest items that fit. ``left`` is small."""
    left = left.copy()
    made = []
    order = np.argsort(-sizes)
    while left.any():
        free, row = room, np.zeros(len(sizes), np.int64)
        for i in order:
            if left[i] and sizes[i] <= free:
                k = min(int(left[i]), int(free // sizes[i]))
                row[i] += k
                left[i] -= k
                free -= k * int(sizes[i])
        made.append(row)
    return np.array(made, np.int64).reshape(len(made), len(sizes))


def slots(sizes: np.ndarray, patterns: np.ndarray, uses: np.ndarray) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a sequence, first offset) in order of rank."""
    first = np.concatenate([[0], np.cumsum(uses)])
    # the longest pieces of a pattern come first in its sequences
    placed = np.cumsum((patterns * sizes)[:, ::-1], axis=1)[:, ::-1] - patterns * sizes
    out = {}
    for i, size in enumerate(sizes.tolist()):
        p = np.flatnonzero(patterns[:, i])
        copies = patterns[p, i]
        ranks = np.concatenate([[0], np.cumsum(copies * uses[p])[:-1]])
        out[size] = np.stack([ranks, first[p], copies, placed[p, i]])
    return out


def pack(
    docs: DataFrame, vocabulary_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document's ids, ended by ``end_id``, into sequences of at most ``length``.

    Args: ``docs`` with any further columns; ``vocabulary_path`` a ``tokenizers`` file, read on the driver and
    broadcast (a fixed 2 MB).
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text
    is the end id alone; repeated rows and null ids are packed like others; an empty table gives an empty table.
    """
    cuts = stash(cut_documents(docs, vocabulary_path, length, end_id, id_col, text_col))
    cuts = cuts.withColumn("rest", F.col("doc_tokens") % length).withColumn("full", (F.col("doc_tokens") / length).cast("long"))
    held = cuts.filter("rest > 0").groupBy(F.col("rest").cast("int").alias("rest")).count().orderBy("rest").collect()  # < length rows
    sizes = np.array([r["rest"] for r in held], np.int64)
    patterns, uses = cutting_stock(sizes, np.array([r["count"] for r in held], np.int64), length)
    plan = docs.sparkSession.sparkContext.broadcast(slots(sizes, patterns, uses))
    made = int(uses.sum())

    order = ["doc_id", "doc_tokens", "crcs"]
    ranked = running_start(cuts, ["rest"], order, F.lit(1).cast("long"), "rank")
    ranked = running_start(ranked, [], order, F.col("full"), "full_before")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tokens, crcs, rank, before = (batch.column(i) for i in range(5))
            n = tokens.to_numpy(zero_copy_only=False)
            rest = n % length
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            ranks = rank.to_numpy(zero_copy_only=False)
            for size in np.unique(rest[rest > 0]).tolist():
                at = np.flatnonzero(rest == size)
                first, base, copies, placed = plan.value[size]
                j = np.searchsorted(first, ranks[at], side="right") - 1
                k = ranks[at] - first[j]
                sequence[at] = base[j] + k // copies[j]
                offset[at] = placed[j] + k % copies[j] * size
            pieces = -(-n // length)
            row = np.repeat(np.arange(len(n)), pieces)
            i = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            last = (i == pieces[row] - 1) & (rest[row] > 0)
            full_before = before.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    doc.take(pa.array(row)),
                    pa.array(i * length),
                    pa.array(np.where(last, rest[row], length)),
                    crcs.flatten(),
                    pa.array(n[row]),
                    pa.array(np.where(last, sequence[row], made + full_before[row] + i)),
                    pa.array(np.where(last, offset[row], 0)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "doc_tokens", "crcs", "rank", "full_before").mapInArrow(assign, SCHEMA)
