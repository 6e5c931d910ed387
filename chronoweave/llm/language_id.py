"""Operator 10: language identification by a byte convolutional network.

A window of bytes passes through filters of several widths, the largest response of each filter over the window is
kept, and a softmax turns these into language probabilities. The network is trained in numpy on a bounded sample of
labelled windows; every window of every text is classified, and a text's windows are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.textbytes import LOWER, text_chunks

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The network is trained on the windows of at most this many labelled texts, taken by a hash of the id.
SAMPLE = 4_000
WINDOWS_PER_TEXT = 4
FOLDS = 3


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of WINDOW bytes, padded with zeros, A-Z lower-cased; text of each). They cover every byte once."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), many)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][text][:, None]
    low = np.append(LOWER[data], np.uint8(0))
    return np.where(inside, low[np.minimum(at, len(data))], 0), text


class ByteConvNet:
    """Filters over one-hot bytes, as tables of 256 responses for each place in a filter."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window, and at which byte if ``where``."""
        kept, spots = [], []
        for table in self.tables:
            w = len(table)
            n = WINDOW - w + 1
            response = table[0].take(x[:, :n].ravel(), axis=0)
            for k in range(1, w):
                response += table[k].take(x[:, k : n + k].ravel(), axis=0)
            response = response.reshape(len(x), n, FILTERS)
            if where:
                spots.append(response.argmax(axis=1))
            kept.append(response.max(axis=1))
        return np.maximum(np.hstack(kept) + self.bias, 0), spots

    def probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """Probabilities of each window. Responses of neighbouring places are joined to tables by byte pairs first."""
        joined = []
        for table in self.tables:
            pairs = [(k, (table[k][:, None] + table[k + 1][None, :]).reshape(1 << 16, FILTERS)) for k in range(0, len(table) - 1, 2)]
            joined.append((len(table), pairs, table[-1] if len(table) % 2 else None))
        parts = []
        for i in range(0, len(x), batch):
            one = np.ascontiguousarray(x[i : i + batch].T).astype(np.int64)
            two = one[:-1] * 256 + one[1:]
            kept = []
            for w, pairs, last in joined:
                n = WINDOW - w + 1
                response = None if last is None else last.take(one[w - 1 : w - 1 + n], axis=0)
                for k, table in pairs:
                    part = table.take(two[k : k + n], axis=0)
                    response = part if response is None else np.add(response, part, out=response)
                kept.append(response.max(axis=0))
            z = np.maximum(np.hstack(kept) + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross-entropy; max pooling sends a filter's gradient to one place of each window."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                bx, by = x[order[i : i + batch]], y[order[i : i + batch]]
                rows = np.arange(len(bx))
                h, spots = self.pooled(bx, where=True)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[rows, by] -= 1
                d /= len(bx)
                dh = (d @ self.out.T) * (h > 0)
                grads = []
                for t, (table, spot) in enumerate(zip(self.tables, spots)):
                    g = np.zeros_like(table)
                    mine = dh[:, t * FILTERS : (t + 1) * FILTERS]
                    for k in range(len(table)):
                        np.add.at(g[k], (bx[rows[:, None], spot + k], np.arange(FILTERS)[None, :]), mine)
                    grads.append(g)
                grads += [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit_language(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet:
    """Train on (text, lang) of at most ``sample`` documents with a language outside the held-out fold.

    The fold is crc32(id as text) mod 3; 1 is held out. At most WINDOWS_PER_TEXT windows of a sampled text are used,
    spread evenly over it. Null ids, texts and languages are not learnt from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and length(text) > 0").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 1)

    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # of rows that share a sampled id, the one of the least text
    taken = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")
    held = taken.mapInArrow(_sample_windows, "doc_id long, lang string, windows array<binary>").toArrow().sort_by("doc_id")
    pairs = [(np.frombuffer(w, np.uint8), lang) for lang, ws in zip(held.column("lang").to_pylist(), held.column("windows").to_pylist()) for w in ws]
    langs = sorted({lang for _, lang in pairs}) or ["und"]
    net = ByteConvNet(langs)
    if pairs and len(langs) > 1:
        net.train(np.stack([w for w, _ in pairs]), np.array([langs.index(lang) for _, lang in pairs]))
    return net


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1)):
            found, text = windows(data, offsets)
            lists = []
            for d in range(b - a):
                low, high = np.searchsorted(text, [d, d + 1])
                take = np.unique(np.linspace(low, high - 1, min(WINDOWS_PER_TEXT, high - low)).astype(int)) if high > low else []
                lists.append([found[i].tobytes() for i in take])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "lang", "windows"])


def predict_language(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (its mean probability over the windows) of every whole text to ``docs``.

    ``und`` with score 0 is the result for a text that is null or has no letter. Columns called lang_pred or score are
    replaced, others stay. Repeated rows and null ids are treated like others; an empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(net)
    pred = "_pred"
    while pred in {c.lower() for c in docs.columns}:
        pred += "_"
    names = [*docs.columns, pred]
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(place), 1 << 20):
                x, text = windows(data, offsets)
                p = net.probabilities(x)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
                mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
                best = mean.argmax(axis=1)
                pred = pa.StructArray.from_arrays([pa.array([net.langs[i] for i in best], pa.string()), pa.array(np.minimum(mean[np.arange(b - a), best], 1.0))], ["lang", "score"])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pred], names)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.mapInArrow(run, schema)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(letters, F.col(f"{pred}.lang")).otherwise("und").alias("lang_pred"), F.when(letters, F.col(f"{pred}.score")).otherwise(0.0).alias("score"))
