"""Operator 5: a quality classifier by ordinal cumulative-link regression on graded ratings.

A text's hashed words, word endings and word shapes share one weight vector; ordered thresholds cut the score into
grades: P(grade > k) = sigmoid(score - threshold k). The expected grade ranks texts and a tail probability selects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.textbytes import SPACE, mix, span_hashes, text_chunks, word_spans

FEATURES = 1 << 17
#: The classifier is fitted on at most this many rated texts, taken by a hash of the id.
SAMPLE = 8_000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each occurrence: three a word, bounds of the texts)."""
    starts, ends, bounds = word_spans(data, offsets, SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), bounds
    hashes = span_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64)
    near = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][bounds[1:] > bounds[:-1]]] = False
    shape = same * 1 + _UPPER[data[starts]] * 2 + (_UPPER[data[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1)) * 4 + ~_LETTER[data[ends - 1]] * 8 + ~_LETTER[data[starts]] * 16
    shape = shape + np.minimum(ends - starts, 24) // 4 * 32
    ending = mix((last << np.uint64(8)) + near + np.uint64(1 << 32))
    form = mix(shape.astype(np.uint64) + np.uint64(2 << 32))
    cut = np.uint64(64 - FEATURES.bit_length() + 1)
    return np.stack([hashes >> cut, ending >> cut, form >> cut], axis=1).ravel().astype(np.int64), bounds * 3


def _vectors(docs: DataFrame) -> DataFrame:
    """(grade, features, values): the distinct features of each text with their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                found, bounds = text_features(data, offsets)
                pairs = [np.unique(found[s:e], return_counts=True) for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([(p[1] / max(p[1].sum(), 1)).astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                    ["grade", "features", "values"],
                )

    return docs.select("grade", "text").mapInArrow(run, "grade int, features array<int>, values array<float>")


class OrdinalModel:
    """Shared weights and ordered thresholds of a cumulative-link regression with the logit link."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, low: int = 0):
        self.weights, self.thresholds, self.low = weights, thresholds, low

    @classmethod
    def fit(cls, rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, rounds: int = 120, ridge: float = 3e-7, rate: float = 0.3) -> OrdinalModel:
        """``rows`` of the entries are sorted. Adam on the mean log-likelihood; gaps between thresholds are exponentials."""
        low, high = (int(grades.min()), int(grades.max())) if len(grades) else (0, 0)
        w = np.zeros(FEATURES)
        if low == high:
            return cls(w, np.zeros(0), low)
        g, n, cuts = grades - low, len(grades), high - low
        share = np.array([np.clip((g > k).mean(), 1e-3, 1 - 1e-3) for k in range(cuts)])
        start = np.maximum.accumulate(np.log(1 / share - 1) + 1e-3 * np.arange(cuts))
        t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        rare = np.bincount(features, values, minlength=FEATURES)
        scale = 1 / np.sqrt(rare / n + 1e-4)  # shares of rare features move as fast as those of common ones
        values = values * scale[features]
        moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(cuts), np.zeros(cuts)]
        for step in range(1, rounds + 1):
            gaps = np.exp(t[1:])
            theta = t[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            eta = np.bincount(rows, values * w[features], minlength=n)
            upper = 1 / (1 + np.exp(-np.clip(np.pad(theta, (0, 1), constant_values=60)[g] - eta, -60, 60)))
            lower = 1 / (1 + np.exp(-np.clip(np.pad(theta, (1, 0), constant_values=-60)[g] - eta, -60, 60)))
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            d_eta = (du - dl) / n
            grad = np.bincount(features, values * d_eta[rows], minlength=FEATURES) + ridge * w
            d_theta = np.zeros(cuts)
            np.add.at(d_theta, g[g < cuts], -du[g < cuts] / n)
            np.add.at(d_theta, g[g > 0] - 1, dl[g > 0] / n)
            tail = np.cumsum(d_theta[::-1])[::-1]
            d_t = np.concatenate([tail[:1], tail[1:] * gaps])
            for x, d, i, pace in ((w, grad, 0, rate), (t, d_t, 2, 0.05)):
                moments[i] = 0.9 * moments[i] + 0.1 * d
                moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * d * d
                x -= pace * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
        return cls(w * scale, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]), low)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > low + k) in column k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def fit_quality(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``sample`` rated texts of ``ratings`` (id, grade), taken by a hash of the id."""
    rated = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    rated = rated.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    taken = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade"))  # one row a sampled id
    held = _vectors(texts).toArrow()
    features, values = held.column("features").combine_chunks(), held.column("values").combine_chunks()
    sizes = np.array([len(x) for x in features], np.int64) if len(held) else np.zeros(0, np.int64)
    flat = features.flatten().to_numpy(zero_copy_only=False) if len(held) else np.zeros(0, np.int32)
    weight = values.flatten().to_numpy(zero_copy_only=False) if len(held) else np.zeros(0, np.float32)
    grades = held.column("grade").to_numpy() if len(held) else np.zeros(0, np.int64)
    return OrdinalModel.fit(np.repeat(np.arange(len(grades)), sizes), flat.astype(np.int64), weight.astype(np.float64), grades)


def score_quality(docs: DataFrame, model: OrdinalModel, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add expected_grade and tail (P(grade >= at_least)) of every whole text to ``docs``, whose columns all stay.

    A null, empty or blank text gets the score of no features. Repeated rows and null ids are scored like others; an
    input column called expected_grade or tail is replaced; an empty table gives an empty table.
    """
    docs = docs.drop("expected_grade", "tail")
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.low))
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, low = held.value
        fitted = OrdinalModel(weights, thresholds, low)
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(place)):
                found, bounds = text_features(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(weights[found], dtype=np.float64)])
                score = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
                tails = fitted.tails(score)
                k = at_least - low - 1
                tail = np.ones(b - a) if k < 0 else tails[:, k] if k < tails.shape[1] else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pa.array(low + tails.sum(axis=1)), pa.array(tail)], schema.names)

    return docs.mapInArrow(run, schema)
