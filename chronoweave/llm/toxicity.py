"""Operator 3: toxicity by class-conditional Kneser-Ney models of words and of the word that follows another.

Labelled training texts give, for each (word before, word), its count in toxic and in ordinary texts, under whole 64-bit
hashes and in as many rows as the texts have pairs; a text starts and ends with a mark. In class c

    P(w)     = (max(c(w) - D1, 0) + D1 N1+(c) Pcont(w)) / c()
    P(w | h) = (max(c(h, w) - D2, 0) + D2 N1+(h .) P(w)) / c(h), or P(w) if h is not known in the class

and Pcont, the share of all distinct contexts, is one for both classes, so a rare expression is not judged by one class
alone. The log-likelihood ratio of the pairs splits into what the history, the word and the pair add to it, so each is
looked up on its own. A text's score is a logistic function of its length-normalised ratios of both orders and of its
length, calibrated on training texts whose counts are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.textbytes import LOWER, PUNCTUATION, mix, span_hashes, text_chunks, word_spans
from chronoweave.plans.stash import drop_stash, stash

#: Most calibration rows (a few numbers each) that reach the driver; beyond it rows are taken by hash.
CALIBRATION_ROWS = 100_000
FOLDS = 5
#: A word whose ratio is below a margin counts as equally likely in both classes there. It keeps what a language or a
#: topic shifts a little for every word from hiding the few words that only one class uses.
MARGINS = (1.0, 2.0, 3.0)
#: Counting takes the words, and scoring the texts, in so many turns; a turn's shuffle is gone before the next.
COUNT_TURNS = 4
SCORE_TURNS = 6
#: About so many keys of the table, and bytes of text, for each part that the questions of the texts are dealt to.
PART_KEYS = 1_500_000
PART_BYTES = 24 << 20
#: What the table holds: of a word the ratio and that of its history, of a pair what it adds to both.
HELD = [("key", np.uint64), ("ratio", np.float32), ("history", np.float32)]
SUMS = ["s0", "s1", "s2", "s3", "pairs"]
#: Hashes of the marks at a text's ends.
START, END = np.uint64(0), np.uint64(1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, bounds of the texts) of every word and of the end mark of each text that has words.

    Words are hashes of runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.
    """
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, PUNCTUATION)
    word = span_hashes(low, starts, ends)
    some = np.flatnonzero(np.diff(bounds))
    word = np.insert(word, bounds[some + 1], END)
    bounds = bounds + np.append(0, np.cumsum(np.diff(bounds) > 0))
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    before[bounds[some]] = START
    return word, before, bounds


def _key(word: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The key of a word (even) or a pair (odd)."""
    if before is None:
        return mix(word) & ~np.uint64(1)
    return mix(word + mix(before + np.uint64(1))) | np.uint64(1)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the keys, the same number of them in each part."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def fold_of(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def pair_counts(train: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """(before, word, ordinary, toxic): counts of all (toxic, text) rows, for the words of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)) > 0
            for a, b, data, offsets in text_chunks(batch.column(1)):
                word, before, bounds = _words(data, offsets)
                mine = np.flatnonzero(mix(word) % np.uint64(turns) == turn)
                if not len(mine):
                    continue
                is_toxic = np.repeat(toxic[a:b], np.diff(bounds))[mine]
                word, before = word[mine], before[mine]
                order = np.lexsort((before, word))
                word, before = word[order], before[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
                first = np.flatnonzero(new)
                t = np.add.reduceat(is_toxic[order].astype(np.int64), first)
                n = np.diff(np.append(first, len(word)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(n - t), pa.array(t)],
                    ["before", "word", "ordinary", "toxic"],
                )

    rows = train.select("toxic", "text").mapInArrow(run, "before long, word long, ordinary long, toxic long")
    return rows.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


CLASSES = ("toxic", "ordinary")


def _tally(counts: DataFrame) -> Counter:
    """Occurrences, types, and expressions that occur once and twice, of each class; and all types."""
    tests = (("types", "> 0"), ("ones", "= 1"), ("twos", "= 2"))
    row = counts.agg(F.count("*").alias("types"), *[F.sum(c).alias(f"n_{c}") for c in CLASSES], *[F.count_if(F.expr(f"{c} {test}")).alias(f"{k}_{c}") for c in CLASSES for k, test in tests]).first()
    return Counter({k: v or 0 for k, v in row.asDict().items()})


def discount(tally: Counter, c: str) -> float:
    return float(np.clip(tally[f"ones_{c}"] / max(tally[f"ones_{c}"] + 2 * tally[f"twos_{c}"], 1), 0.1, 0.95))


class Model:
    """The totals of the counts, from which a word's or a pair's own counts give its probabilities."""

    def __init__(self, words: Counter, pairs: Counter):
        self.words, self.pairs = words, pairs
        self.d1, self.d2 = ({c: discount(x, c) for c in CLASSES} for x in (words, pairs))

    def word(self, c: str, count: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """P(w); both numbers are 0 for a word that training did not see."""
        shared = (contexts + 1) / (self.pairs["types"] + self.words["types"] + 1)
        free = self.d1[c] * max(self.words[f"types_{c}"], 1)
        return (np.maximum(count - self.d1[c], 0) + free * shared) / max(self.words[f"n_{c}"], 1)

    def history(self, c: str, uses: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The weight of P(w) after a word, by its uses and the number of different words after it."""
        return np.where(uses > 0, self.d2[c] * kinds / np.maximum(uses, 1), 1.0)

    def word_ratio(self, toxic: np.ndarray, ordinary: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return np.log(self.word("toxic", toxic, contexts)) - np.log(self.word("ordinary", ordinary, contexts))

    def history_ratio(self, uses: dict[str, np.ndarray], kinds: dict[str, np.ndarray]) -> np.ndarray:
        return np.log(self.history("toxic", uses["toxic"], kinds["toxic"])) - np.log(self.history("ordinary", uses["ordinary"], kinds["ordinary"]))

    def pair_extra(self, pair: dict[str, np.ndarray], word: dict[str, np.ndarray], contexts: np.ndarray, uses: dict[str, np.ndarray], kinds: dict[str, np.ndarray]) -> np.ndarray:
        """What a pair's ratio has beyond those of its history and its word."""
        out = 0.0
        for c, sign in (("toxic", 1), ("ordinary", -1)):
            lower = self.history(c, uses[c], kinds[c]) * self.word(c, word[c], contexts)
            own = np.where(uses[c] > 0, np.maximum(pair[c] - self.d2[c], 0) / np.maximum(uses[c], 1), 0.0) + lower
            out = out + sign * (np.log(own) - np.log(lower))
        return out


def _by_part(rows: DataFrame) -> DataFrame:
    """(part, HELD): the rows of (part, HELD) as arrays sorted by key, a row a part: there are as many parts as bound it."""

    def pack(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_numpy() for c, _ in HELD}
        order = np.argsort(held["key"].view(np.uint64))
        return pa.table({"part": table.column("part").slice(0, 1)} | {c: pa.array([held[c][order].astype(t).tobytes()], pa.binary()) for c, t in HELD})

    return rows.groupBy("part").applyInArrow(pack, "part long, " + ", ".join(f"{c} binary" for c, _ in HELD))


def counted(train: DataFrame, least_parts: int = 12, turns: int = COUNT_TURNS) -> tuple[list[DataFrame], Model, int]:
    """Stashed (part, HELD) of every word, history and pair of the (toxic, text) rows, the model, and the parts."""
    counts, words, befores, one, two = [], [], [], Counter(), Counter()
    for turn in range(turns):
        mine = stash(pair_counts(train, turn, turns))
        by_word = stash(mine.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("contexts")))
        befores.append(stash(mine.groupBy("before").agg(*[F.sum(c).alias(f"uses_{c}") for c in CLASSES], *[F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in CLASSES])))
        one.update(_tally(by_word))
        two.update(_tally(mine))
        counts.append(mine)
        words.append(by_word)
    model = Model(one, two)
    parts = max(least_parts, -(-(one["types"] + two["types"]) // PART_KEYS))
    sums = ["uses_toxic", "uses_ordinary", "kinds_toxic", "kinds_ordinary"]
    history = stash(_union(befores).groupBy("before").agg(*[F.sum(c).alias(c) for c in sums]))
    shape = "part long, key long, ratio double, history double"

    def row_of(key: np.ndarray, ratio: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_part(key, parts)), pa.array(key.view(np.int64)), pa.array(ratio), pa.array(before)], ["part", *[c for c, _ in HELD]])

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = column(batch, "node").view(np.uint64)
            ratio = model.word_ratio(*(column(batch, c).astype(float) for c in ("toxic", "ordinary", "contexts")))
            uses, kinds = ({c: column(batch, f"{k}_{c}").astype(float) for c in CLASSES} for k in ("uses", "kinds"))
            yield row_of(_key(key), np.where(key == START, 0.0, ratio), model.history_ratio(uses, kinds))

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, word = (column(batch, c).view(np.uint64) for c in ("before", "word"))
            pair, lower = ({c: column(batch, f"{k}_{c}").astype(float) for c in CLASSES} for k in ("pair", "word"))
            uses, kinds = ({c: column(batch, f"{k}_{c}").astype(float) for c in CLASSES} for k in ("uses", "kinds"))
            extra = model.pair_extra(pair, lower, column(batch, "contexts").astype(float), uses, kinds)
            yield row_of(_key(word, before), extra, np.zeros(len(word)))

    every = _union(words)
    met = every.withColumnRenamed("word", "node").join(history.withColumnRenamed("before", "node"), "node", "full_outer").na.fill(0)
    tables = [stash(_by_part(met.mapInArrow(of_words, shape)))]
    for mine, by_word in zip(counts, words):
        pairs = mine.select("before", "word", *[F.col(c).alias(f"pair_{c}") for c in CLASSES])
        met = pairs.join(by_word.select("word", "contexts", *[F.col(c).alias(f"word_{c}") for c in CLASSES]), "word").join(history, "before")
        tables.append(stash(_by_part(met.mapInArrow(of_pairs, shape))))
        drop_stash(mine)
    for done in (*words, *befores, history):
        drop_stash(done)
    return tables, model, parts


def text_sums(docs: DataFrame, table: DataFrame, model: Model, parts: int) -> DataFrame:
    """(text_key, n, SUMS) of the (text_key, text) rows: words with the end mark, the summed ratios of the words and
    their excesses over the margins, and the summed ratios of the pairs. Texts without words have no row.

    What a chunk of texts asks of one part is one row: distinct keys, and for each of them the texts it stands in.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 16):
                batch = whole.slice(at, 1 << 16)
                names = batch.column(0).to_numpy()
                for a, b, data, offsets in text_chunks(batch.column(1)):
                    word, before, bounds = _words(data, offsets)
                    if not len(word):
                        continue
                    text = np.repeat(np.arange(b - a, dtype=np.uint16), np.diff(bounds))
                    begun = np.flatnonzero(np.diff(bounds)).astype(np.uint16)
                    key = np.concatenate([_key(word), _key(np.full(len(begun), START)), _key(word, before)])
                    order = np.argsort(key, kind="stable")
                    key, text = key[order], np.concatenate([text, begun, text])[order]
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    ends = np.append(first, len(key))
                    runs = np.diff(ends).astype(np.uint32)
                    cuts = np.searchsorted(_part(key[first], parts), np.arange(parts + 1))
                    name = names[a:b].tobytes()
                    for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if j > i:
                            cells = (name, key[first[i:j]].tobytes(), runs[i:j].tobytes(), text[ends[i] : ends[j]].tobytes())
                            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)], ["part", "names", "keys", "runs", "texts"])

    unseen = float(model.word_ratio(*(np.zeros(1) for _ in range(3)))[0])
    start = int(_key(np.array([START]))[0])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        known, ratios, histories = (np.frombuffer(b"".join(held.column(c).to_pylist()), t) for c, t in HELD)
        by = np.argsort(known, kind="stable")  # a row for each turn of counting
        known, ratios, histories = known[by], ratios[by], histories[by]
        out = []
        for row in range(asked.num_rows):
            names, key, runs, text = (np.frombuffer(asked.column(c)[row].as_py(), t) for c, t in (("names", np.int64), ("keys", np.uint64), ("runs", np.uint32), ("texts", np.uint16)))
            pair = key & np.uint64(1) == 1
            ratio, history = np.where(pair | (key == start), 0.0, unseen), np.zeros(len(key))
            if len(known):
                spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                met = known[spot] == key
                ratio, history = np.where(met, ratios[spot], ratio), np.where(met, histories[spot], 0.0)
            own = np.where(pair, 0.0, ratio)
            parts_ = [(~pair & (key != start)).astype(float), own, *(np.maximum(own - m, 0) for m in MARGINS), ratio + history]
            sums = np.stack([np.bincount(text, np.repeat(x, runs), len(names)) for x in parts_], axis=1)
            some = np.flatnonzero(np.bincount(text, minlength=len(names)))
            out.append((names[some], sums[some]))
        if not out:
            return pa.table({"text_key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())} | {c: pa.array([], pa.float64()) for c in SUMS})
        names, sums = (np.concatenate(x) for x in zip(*out))
        return pa.table({"text_key": names, "n": sums[:, 0].astype(np.int64)} | {c: np.ascontiguousarray(sums[:, 1 + i]) for i, c in enumerate(SUMS)})

    asked = docs.select("text_key", "text").mapInArrow(ask, "part long, names binary, keys binary, runs binary, texts binary")
    met = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answer, "text_key long, n long, " + ", ".join(f"{c} double" for c in SUMS))
    return met.groupBy("text_key").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the columns of ``x`` are few."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _read(table) -> np.ndarray:
    """The features of an Arrow table's (n, SUMS) columns: length-normalised ratios, also by the length's root, and length."""
    n = table.column("n").to_numpy()
    means = np.stack([table.column(c).to_numpy() for c in SUMS], axis=1) / np.maximum(n, 1)[:, None]
    return np.hstack([np.ones((len(n), 1)), 10 * means, means * np.sqrt(n)[:, None], np.log1p(n)[:, None] / 5])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", count_turns: int = COUNT_TURNS, score_turns: int = SCORE_TURNS) -> DataFrame:
    """A toxicity score for every whole text, learnt from ``labels`` (id, label) outside the held-out fold.

    The fold is crc32(id as text) mod 5: 0 is held out, 1 calibrates, the rest are counted. All their labelled texts
    are used. Rows with a null label are not learnt from; of repeated labels of one id the larger holds.
    Returns one row per input row: doc_id, held_out, score (0 to 1), predicted. A null or empty text gets the score of
    a text without words; a null id is not held out and not learnt from; without labels the score is 0.5. Repeated
    rows and further columns do no harm; an empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("doc_id", "text"))
    fold = fold_of("doc_id")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(fold_of("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    small = marks.count() <= 1_000_000  # 16 MB
    marks = F.broadcast(marks) if small else marks
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tables, model, parts = counted(docs.join(marks, "doc_id").filter(fold > 1), max(12, -(-size // (PART_BYTES * score_turns))), count_turns)
    table, turns = _union(tables), []
    for turn in range(score_turns):
        mine = docs.filter(F.pmod("text_key", F.lit(score_turns)) == turn)
        turns.append(stash(text_sums(mine, table, model, parts)))
    for held in tables:
        drop_stash(held)
    sums = _union(turns)

    # Equal rows (of one id and text) have added up under one key.
    rows = docs.groupBy("text_key", "doc_id").agg(F.count("*").alias("copies")).join(sums, "text_key", "left")
    rows = rows.select("doc_id", "copies", *[(F.coalesce(c, F.lit(0)) / F.col("copies")).alias(c) for c in ("n", *SUMS)])
    part = rows.join(marks, "doc_id").filter(fold == 1)
    held = max(1, -(-part.count() // CALIBRATION_ROWS))
    told = part.filter(F.pmod(F.xxhash64("doc_id"), F.lit(held)) == 0).select("toxic", "n", *SUMS).toArrow()
    weights = np.zeros(2 * len(SUMS) + 2)
    if told.num_rows:
        weights = _fit_logistic(_read(told), (told.column("toxic").to_numpy() > 0).astype(float))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(_read(batch) @ weights, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = rows.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    rows = rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n", *SUMS)
    return rows.mapInArrow(finish, "doc_id long, held_out boolean, score double, predicted int")
