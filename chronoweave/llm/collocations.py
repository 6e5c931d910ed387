"""Operator 12: phrase collocations by marginalising the longest windows.

Only one window is counted at each word: the word and the three that follow it in its piece, by lead columns, padded at
the piece's end. A phrase occurs once for each window that it begins, so a ROLLUP over the windows' words sums every
shorter phrase from them. Words that occur too seldom to stand in a candidate are padded too, and a sorted pass over the
windows of a pair adds up those that no frequent longer phrase needs before the ROLLUP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.textbytes import LOWER, mix, span_hashes, text_chunks, word_spans
from chronoweave.plans.stash import drop_stash, stash

#: Longest phrase, in words.
ORDER = 4
#: Most words that get a short number and go to every task (64 MB); the rest keep their hashes and are not padded.
NUMBERED = 4_000_000
#: Pairs whose words are both among the so many most frequent are dealt by their third word too.
HOT = 64
SALTS = 32
CHUNK = 8 << 20
BREAKS = np.zeros(256, bool)
BREAKS[[10, 11, 12, 13, *b".,;:!?"]] = True
BETWEEN = BREAKS.copy()
BETWEEN[[9, 32]] = True
WORDS = ["w1", "w2", "w3", "w4"]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds of the texts, word hashes, piece of each word, lower-cased bytes)."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, BETWEEN)
    piece = np.cumsum(BREAKS[low])[starts] + np.searchsorted(offsets[1:], starts, side="right") if len(starts) else np.zeros(0, np.int64)
    return starts, ends, bounds, span_hashes(low, starts, ends), piece, low


def _lang_keys(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language, mixed into those of its words."""
    coded = langs.dictionary_encode()
    names = pa.array(coded.dictionary.to_pylist(), pa.large_string())
    keys = np.zeros(len(names), np.uint64)
    for a, b, data, offsets in text_chunks(names):
        keys[a:b] = span_hashes(data, offsets[:-1], offsets[1:])
    return mix(keys + np.uint64(1))[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, lang, word, f) of the (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            lang_key = _lang_keys(langs)
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                starts, ends, bounds, word, _, low = _pieces(data, offsets)
                if not len(word):
                    continue
                row = np.repeat(np.arange(a, b), np.diff(bounds))
                key, first, f = np.unique(mix(word + lang_key[row]), return_index=True, return_counts=True)
                raw = low.tobytes()
                text = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), langs.take(pa.array(row[first])), pa.array(text, pa.binary()).cast(pa.string()), pa.array(f)], ["key", "lang", "word", "f"])

    rows = docs.mapInArrow(run, "key long, lang string, word string, f long")
    return rows.groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("f").alias("f"))


def windows(docs: DataFrame, keys: np.ndarray, ids: np.ndarray, whole: bool, turn: int = 0, turns: int = 1) -> DataFrame:
    """(w1..w4, c): a window at every word that has a successor, 0 for padding, and how often it occurs in a chunk.

    ``keys`` are the sorted hashes of numbered words, ``ids`` their numbers. If they are the ``whole`` of the frequent
    words, all others are padding; else others keep their hash, as a negative number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_key = _lang_keys(batch.column(0))
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                _, _, bounds, word, piece, _ = _pieces(data, offsets)
                if len(word) < 2 or not len(keys):
                    continue
                word = mix(word + lang_key[np.repeat(np.arange(a, b), np.diff(bounds))])
                spot = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                lead = np.zeros((len(word) + ORDER, ORDER), np.int64)
                lead[: len(word), 0] = np.where(keys[spot] == word, ids[spot], 0 if whole else word.view(np.int64) | np.iinfo(np.int64).min)
                piece = np.append(piece, np.full(ORDER, -1))
                for i in range(1, ORDER):
                    ok = (piece[: len(word)] == piece[i : i + len(word)]) & (lead[: len(word), i - 1] != 0)
                    lead[: len(word), i] = np.where(ok, lead[i : i + len(word), 0], 0)
                lead = lead[: len(word)]
                lead = lead[(lead[:, 0] != 0) & (lead[:, 1] != 0)]
                hashed = mix(lead[:, 0].view(np.uint64) + mix(lead[:, 1].view(np.uint64)))
                if turns > 1:
                    mine = hashed % np.uint64(turns) == turn
                    lead, hashed = lead[mine], hashed[mine]
                for i in (2, 3):
                    hashed = mix(hashed + lead[:, i].view(np.uint64))
                lead = lead[np.argsort(hashed)]  # equal windows stand together; others of one hash at worst stay apart
                first = np.flatnonzero(np.append(True, (lead[1:] != lead[:-1]).any(axis=1))) if len(lead) else np.zeros(0, np.int64)
                c = np.diff(np.append(first, len(lead)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(lead[first, i])) for i in range(ORDER)), pa.array(c)], [*WORDS, "c"])

    return docs.mapInArrow(run, ", ".join(f"{w} long" for w in WORDS) + ", c long")


def _runs(same: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that are the ``same`` as the row before."""
    return np.flatnonzero(~same)


class _Sums:
    """Adds up sorted windows batch by batch; holds the open window, triple and pair, whatever their size."""

    def __init__(self, least: int, hot: int):
        self.least, self.hot = least, hot
        self.key = None  # of the open window
        self.more = np.zeros((3, 2), np.int64)  # counts of the open (window, triple, pair), and what of them was emitted, without the open lower ones

    def add(self, key: np.ndarray, c: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (windows, counts) that are needed beyond this batch: frequent phrases, and the rest of shorter ones."""
        if self.key is not None:
            key, c = np.vstack([self.key, key]), np.concatenate([[0], c])
        if not len(key):
            return key, c
        out_key, out_c = [], []
        same = np.ones((len(key), ORDER), bool)
        same[0] = False
        for i in range(ORDER):
            same[1:, i] = key[1:, i] == key[:-1, i]
            if i:
                same[:, i] &= same[:, i - 1]
        emitted = np.zeros(len(key), np.int64)
        rows, total = np.arange(len(key)), c
        for level, width in enumerate((4, 3, 2)):
            first = _runs(same[rows, width - 1])
            total, emitted, rows = np.add.reduceat(total, first), np.add.reduceat(emitted, first), rows[first]
            total[0] += self.more[level, 0]
            emitted[0] += self.more[level, 1]
            closed = len(rows) - (0 if last else 1)
            short = key[rows]
            short[:, width:] = 0
            if width == 2:
                need = (total >= self.least) | ((np.abs(short[:, :2]) <= self.hot) & (short[:, :2] > 0)).all(axis=1)
            else:
                need = (total >= self.least) & (key[rows, width - 1] != 0)
            need[closed:] = False
            rest = need & (total > emitted)
            out_key.append(short[rest])
            out_c.append((total - emitted)[rest])
            open_total, open_emitted = int(total[-1]), int(emitted[-1])
            emitted = np.where(need, total, emitted)
            if not last:
                self.more[level] = open_total, open_emitted
        if last:
            self.key = None
        else:
            self.key = key[-1:].copy()
            self.more[2] -= self.more[1]
            self.more[1] -= self.more[0]
        return np.vstack(out_key), np.concatenate(out_c)


def frequent(rows: DataFrame, least: int, hot: int = HOT) -> DataFrame:
    """(w1..w4, f) of every phrase of two and more words that occurs ``least`` times, by ROLLUP over windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(least, hot)
        empty = np.zeros((0, ORDER), np.int64)

        def send(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(key[:, i])) for i in range(ORDER)), pa.array(c)], [*WORDS, "c"])

        for batch in batches:
            if batch.num_rows:
                yield send(*sums.add(np.stack([batch.column(i).to_numpy() for i in range(ORDER)], axis=1), batch.column(ORDER).to_numpy()))
        if sums.key is not None:
            yield send(*sums.add(empty, np.zeros(0, np.int64), last=True))

    common = F.col("w1").between(1, hot) & F.col("w2").between(1, hot)
    dealt = rows.withColumn("salt", F.when(common, F.pmod(F.xxhash64("w3"), F.lit(SALTS))).otherwise(0))
    dealt = dealt.repartition("w1", "w2", "salt").sortWithinPartitions(*WORDS).drop("salt")
    needed = dealt.mapInArrow(run, ", ".join(f"{w} long" for w in WORDS) + ", c long")
    summed = needed.rollup(*WORDS).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    # A prefix that ends in padding is a shorter one's rest.
    real = F.when(F.col("g") == 0, F.col("w4") != 0).when(F.col("g") == 1, F.col("w3") != 0).otherwise(F.col("g") == 3)
    return summed.filter(real & (F.col("f") >= least)).select(*[F.coalesce(w, F.lit(0)).alias(w) for w in WORDS], "f")


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, cover: int = 80, turns: int = 2, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``first`` phrases of 2 to 4 words of each language by how tightly their words hold together, over whole texts.

    A candidate occurs ``least`` times within pieces; its score is floor(2000000 a / (l + r)) at its weakest cut.
    Candidates inside a longer candidate that has ``cover`` hundredths of their occurrences are dropped. Returns lang,
    rank (from 1), phrase, a, l, r, n, score; n counts all words of the language. A null language is ``und``, a null
    text is empty; repeated rows count as often as they stand, and further columns do no harm. A language without
    candidates has no rows, nor has an empty table. Words are told apart by 64-bit hashes. ``turns`` parts of the pairs
    are counted one after the other, all of them over all rows, so that a part's shuffle is gone before the next.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = stash(word_counts(docs))
    n = stash(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    common = counts.filter(F.col("f") >= least)
    many = common.count()
    if not many:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    told = common.orderBy(F.desc("f"), "key").limit(NUMBERED).select("key").toArrow().column("key").to_numpy().view(np.uint64)
    by = np.argsort(told)
    keys, ids, whole = told[by], by + 1, many <= NUMBERED
    named = spark.createDataFrame(pa.table({"key": told.view(np.int64), "id": np.arange(1, len(told) + 1)}))
    common = common.join(F.broadcast(named) if len(told) <= 1_000_000 else named, "key", "left")
    words = stash(common.select(F.coalesce("id", F.col("key").bitwiseOR(F.lit(np.iinfo(np.int64).min))).alias("id"), "lang", "word", "f"))

    turned = [stash(frequent(windows(docs, keys, ids, whole, turn, turns), least)) for turn in range(turns)]
    phrases = turned[0]
    for more in turned[1:]:
        phrases = phrases.unionAll(more)

    def part(i: int, j: int):
        """The words from ``i`` to ``j`` as a key."""
        held = [F.col(WORDS[x]) for x in range(i, j)] + [F.lit(0).cast("long")] * (ORDER - (j - i))
        return F.struct(*[c.alias(w) for c, w in zip(held, WORDS)])

    length = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    inside = {3: [(0, 2), (1, 3)], 4: [(0, 3), (1, 4), (0, 2), (1, 3), (2, 4)]}
    longer = phrases.filter("w3 <> 0").withColumn("x", F.explode(F.when(F.col("w4") == 0, F.array(*[part(*x) for x in inside[3]])).otherwise(F.array(*[part(*x) for x in inside[4]]))))
    most = longer.select("x.*", "f").groupBy(*WORDS).agg(F.max("f").alias("within"))
    alone = phrases.join(most, WORDS, "left").filter(F.col("within").isNull() | (100 * F.col("within") < cover * F.col("f"))).drop("within")

    every = phrases.select(*WORDS, "f").unionAll(words.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], "f"))
    shaped = {m: F.array(*[F.struct(F.lit(k).alias("k"), part(0, k).alias("left"), part(k, m).alias("right")) for k in range(1, m)]) for m in (2, 3, 4)}
    cut = alone.withColumn("cut", F.explode(F.when(length == 2, shaped[2]).when(length == 3, shaped[3]).otherwise(shaped[4]))).select(*WORDS, F.col("f").alias("a"), "cut.*")
    cut = cut.join(every.select(F.struct(*WORDS).alias("left"), F.col("f").alias("l")), "left").join(every.select(F.struct(*WORDS).alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("cast(cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    cut = cut.withColumn("score", score).groupBy(*WORDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select(*WORDS, "a", "s.score", "s.l", "s.r")
    cut = cut.join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    near = stash(cut.withColumn("r0", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("r0") <= first).drop("r0"))
    spelt = near
    for i, w in enumerate(WORDS):
        spelt = spelt.join(words.select(F.col("id").alias(w), F.col("word").alias(f"t{i}")), w, "left")
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", "t0", "t1", "t2", "t3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first).join(F.broadcast(n) if n.count() <= 100_000 else n, "lang")
    out = stash(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for done in (counts, n, words, near, *turned):
        drop_stash(done)
    return out
