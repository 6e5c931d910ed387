"""Vector reads in blocks, drift measures, and retrieval over ranked lists."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scalar import cosine
from chronoweave.plans.stash import stash


#: Rows of a block of queries or vectors.
BLOCK_ROWS = 8192
#: Cells of a matrix product that a task holds at once (16 MB).
PRODUCT_CELLS = 1 << 21


def _blocks(rows: DataFrame, key: str, name: str, other: str, mine: int, others: int) -> DataFrame:
    """One copy of each row for every block of the other side."""
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _cosines(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all of ``b``, -2 where one is zero."""
    s = a @ b.T
    s /= np.maximum(size_a, 1e-300)[:, None]
    s /= np.maximum(size_b, 1e-300)
    s[size_a == 0], s[:, size_b == 0] = -2.0, -2.0
    return s


def nearest_of_blocks(asked: pd.DataFrame, held: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """(query_id, id, similarity) of the ``k`` nearest of a block of (id, _b) to each row of a block of (query_id, _a)."""
    empty = pd.DataFrame({"query_id": [], "id": [], "similarity": []})
    if not len(asked) or not len(held):
        return empty
    a, b = np.stack(asked["_a"].to_numpy()).astype(np.float64), np.stack(held["_b"].to_numpy()).astype(np.float64)
    own = held["id"].to_numpy()
    order = np.argsort(own, kind="stable")
    b, own = b[order], own[order]
    sizes = [np.linalg.norm(x, axis=1) for x in (a, b)]
    step, kept = max(1, PRODUCT_CELLS // len(b)), []
    for lo in range(0, len(a), step):
        s = _cosines(a[lo : lo + step], b, sizes[0][lo : lo + step], sizes[1])
        away = -np.round(s, 12)
        most = min(k, s.shape[1])
        kth = np.partition(away, most - 1, axis=1)[:, most - 1]
        row, col = np.nonzero(away <= kth[:, None])  # the best, and others equal to the last of them
        by = np.lexsort((col, away[row, col], row))
        row, col = row[by], col[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < most], col[place < most]
        kept.append((row + lo, col, s[row, col]))
    row, col, s = (np.concatenate(x) for x in zip(*kept))
    found = pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "id": own[col], "similarity": s})
    return found[found["similarity"] >= least]


def knn(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, similarity, rank) of the k most similar by cosine, ties to the smaller id.

    Exact: blocks of ``queries`` (query_id, vector) meet blocks of ``vectors`` (id, vector), each pair is multiplied a
    few queries at a time, so a task's memory does not follow the product's size, and only a pair's best k are shuffled. Null vectors
    and those with null components are left out; a zero vector is similar to none.
    """
    fine = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    q, v = (x.select(c, "vector").filter(fine) for x, c in ((queries, "query_id"), (vectors, "id")))
    many = [max(1, -(-x.count() // block_rows)) for x in (q, v)]
    kinds = dict(q.dtypes) | dict(v.dtypes)

    # new names for both sides: they may come from one table
    left = _blocks(q.select("query_id", F.col("vector").alias("_a")), "query_id", "_q", "_v", many[0], many[1])
    right = _blocks(v.select("id", F.col("vector").alias("_b")), "id", "_w", "_r", many[1], many[0])
    met = left.groupBy("_q", "_v").cogroup(right.groupBy("_r", "_w"))
    found = met.applyInPandas(lambda asked, held: nearest_of_blocks(asked, held, k, least), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round(F.col("similarity"), 12).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pairs_of_blocks(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """The similar pairs of two blocks of (id, vector, _side, _q, _r), or of one if _q = _r, a part of the product at a time."""
    sides = [[], []]
    for batch in batches:
        for side in (0, 1):
            rows = batch[batch["_side"] == side]
            if len(rows):
                sides[side].append((rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64), batch["_q"].iloc[0] == batch["_r"].iloc[0]))
    if not sides[0] or not sides[1]:
        return
    own = sides[0][0][2]
    ids, (x, y) = ([np.concatenate([part[i] for part in side]) for side in sides] for i in (0, 1))
    sizes = [np.linalg.norm(f, axis=1) for f in (x, y)]
    step = max(1, PRODUCT_CELLS // len(y))
    for lo in range(0, len(x), step):
        s = _cosines(x[lo : lo + step], y, sizes[0][lo : lo + step], sizes[1])
        a, b = ids[0][lo : lo + step, None], ids[1][None, :]
        i, j = np.nonzero((s >= least) & ((a < b) if own else (a != b)))
        a, b = ids[0][i + lo], ids[1][j]
        yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s[i, j]})


def similar_pairs(vectors: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of (id, vector) rows with a cosine of ``least`` or more; exact, by blocks.

    Two blocks meet once. Their pairs leave the task a few rows of the product at a time: where all are similar they are
    the square of a block.
    """
    v = vectors.select("id", "vector").filter(F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    many = max(1, -(-v.count() // block_rows))
    kind = dict(v.dtypes)["id"]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from pairs_of_blocks(batches, least)

    block = F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    one = v.select("id", "vector", F.lit(0).alias("_side"), block.alias("_q")).withColumn("_r", F.explode(F.sequence(F.col("_q"), F.lit(many - 1))))
    two = v.select("id", "vector", F.lit(1).alias("_side"), block.alias("_r")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_r"))))
    return one.unionByName(two).groupBy("_q", "_r").applyInPandas(near, f"a {kind}, b {kind}, similarity double")


def embed_column(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str, out: str, prefix: str = "search_document: ", size: int = 64) -> DataFrame:
    """Add ``out``: vectors of prefixed texts, made in batches by the caller's function on the executors."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = embed([prefix + (t or "") for t in batch[text]])
            if found.shape != (len(batch), size):
                raise ValueError(f"the embedding function must give vectors of {size}")
            yield batch.assign(**{out: list(found.astype(np.float32))})

    return docs.mapInPandas(run, f"{fields}, `{out}` array<float>")


def drift_magnitude(live: Column, kept: Column) -> Column:
    """1 - cosine within [0, 1]; null where a vector is zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine(live, kept)))


def fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score) from (query_id, id, rank, weight) rows of several lists by reciprocal rank."""
    return ranked.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def unit_hits(hits: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, parent, score, units): unit hits grouped to their parent by the best score."""
    return hits.join(units, "id").groupBy("query_id", "parent").agg(F.max("similarity").alias("score"), F.count("*").alias("units"))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centre): the mean vector of each group, summed by component before anything is gathered."""
    parts = rows.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centre"))  # as long as a vector


def retrieval_failed(hits: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, failed): whether a query's best hit is below ``least``."""
    return hits.groupBy("query_id").agg((F.max("similarity") < least).alias("failed"))


def expand_anchors(anchors: DataFrame, facts: DataFrame, weights: dict[str, float], depth: int, most: int) -> DataFrame:
    """(query_id, fact_id, predicate_weight, hop): facts within ``depth`` steps of a query's anchors (query_id, entity_id).

    The best ``most`` of a query by the weight of their predicate, then by hop. A fact is one step from both its ends.
    Worked out once a vertex, not once a query: a fact that is not among the best ``most`` of the vertex through which it
    is nearest is beaten there by ``most`` others, which are no farther from the query.
    """
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    f = facts.filter("object_id is not null").select("fact_id", F.coalesce(F.element_at(table, F.col("predicate")), F.lit(0.4)).alias("predicate_weight"), "subject_id", "object_id")
    arcs = stash(f.select(F.col("subject_id").alias("_at"), F.col("object_id").alias("_to"), "fact_id", "predicate_weight").union(f.select("object_id", "subject_id", "fact_id", "predicate_weight")))

    def best(found: DataFrame, key: str) -> DataFrame:
        least = found.groupBy(key, "fact_id", "predicate_weight").agg(F.min("hop").alias("hop"))
        r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("predicate_weight"), "hop", "fact_id"))
        return least.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")

    asked = anchors.select("query_id", F.col("entity_id").alias("_at")).distinct()
    around = [asked.select("_at").distinct()]  # the vertices within 0, 1, ... steps of any anchor
    for _ in range(depth - 1):
        next_ = around[-1].join(arcs, "_at").select(F.col("_to").alias("_at"))
        around.append(stash(around[-1].union(next_).distinct()))
    near = None
    for wanted in reversed(around):  # each vertex needs the best of its own facts and of its neighbours' best only
        mine = arcs.join(wanted, "_at", "left_semi")
        found = mine.select("_at", "fact_id", "predicate_weight", F.lit(1).alias("hop"))
        if near is not None:
            steps = mine.select("_at", "_to").distinct().join(near.withColumnRenamed("_at", "_to"), "_to")
            found = found.union(steps.select("_at", "fact_id", "predicate_weight", (F.col("hop") + 1).alias("hop")))
        near = stash(best(found, "_at"))
    return best(asked.join(near, "_at"), "query_id")


def rerank(evidence: DataFrame) -> DataFrame:
    """Add ``score`` to (similarity, predicate_weight, hop) rows: 0.7, 0.2 and 0.1 / hop."""
    return evidence.withColumn("score", 0.7 * F.coalesce("similarity", F.lit(0.0)) + 0.2 * F.col("predicate_weight") + 0.1 / F.col("hop"))


def drift_events(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """Add what a drift of (entity, target, magnitude) asks for."""
    return rows.withColumn("action", F.when(F.col("magnitude") >= least, "reconcile").otherwise("none"))


def pending_drift(events: DataFrame, most: int = 3) -> DataFrame:
    """Events without a run that were tried fewer than ``most`` times."""
    return events.filter((F.col("attempts") < most) & F.col("run_id").isNull())


def drift_outcomes(tried: DataFrame, most: int = 3) -> DataFrame:
    """Add ``state`` by the answer's code: done, failed for good (400, 404), exhausted at the last attempt, or retry."""
    state = F.when(F.col("code") == 200, "done").when(F.col("code").isin(400, 404), "failed")
    return tried.withColumn("state", state.when(F.col("attempts") + 1 >= most, "exhausted").otherwise("retry"))


def newest(events: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest events of every entity."""
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("at"), "event_id"))
    return events.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a hash of key and seed: the same ones in every run."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def similarity_spread(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """(pairs, mean, p10, p90) of cosines between two samples of a stated size, a row with itself left out."""
    a, b = left.select(F.col(key).alias("a"), F.col(vector).alias("va")), right.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    s = a.join(F.broadcast(b), F.col("a") != F.col("b")).select(cosine(F.col("va"), F.col("vb")).alias("s"))
    return s.agg(F.count("*").alias("pairs"), F.round(F.avg("s"), 6).alias("mean"), *[F.round(F.percentile("s", p), 6).alias(n) for p, n in ((0.1, "p10"), (0.9, "p90"))])


class Adwin:
    """Adaptive windowing over bounded values: cuts the window's old part when its mean differs from the new part's.

    Buckets hold counts in powers of two, at most ``most`` of each size, so memory is logarithmic in the window.
    """

    def __init__(self, delta: float = 0.002, most: int = 5):
        self.delta, self.most = delta, most
        self.rows: list[list[tuple[int, float, float]]] = [[]]

    def dump(self) -> str:
        return json.dumps(self.rows)

    @classmethod
    def load(cls, text: str, delta: float) -> Adwin | None:
        """The window that ``dump`` wrote, or none where the text is not one."""
        try:
            rows = [[(int(n), float(s), float(v)) for n, s, v in row] for row in json.loads(text)]
        except (TypeError, ValueError):
            return None
        window = cls(delta)
        window.rows = rows or [[]]
        return window

    def add(self, x: float) -> bool:
        """Take a value; whether a change was found."""
        self.rows[0].append((1, x, 0.0))
        level = 0
        while len(self.rows[level]) > self.most:
            (n1, s1, v1), (n2, s2, v2) = self.rows[level][:2]
            del self.rows[level][:2]
            gap = s1 / n1 - s2 / n2
            if level + 1 == len(self.rows):
                self.rows.append([])
            self.rows[level + 1].append((n1 + n2, s1 + s2, v1 + v2 + gap * gap * n1 * n2 / (n1 + n2)))
            level += 1
        return self._cut()

    def _cut(self) -> bool:
        found = False
        while True:
            buckets = [b for row in reversed(self.rows) for b in row]  # oldest first
            n, s = sum(b[0] for b in buckets), sum(b[1] for b in buckets)
            if n < 10:
                return found
            mean = s / n
            spread = sum(b[2] + b[0] * (b[1] / b[0] - mean) ** 2 for b in buckets) / n
            bound = np.log(2 * np.log(n) / self.delta)
            n0 = s0 = 0.0
            for b in buckets[:-1]:
                n0, s0 = n0 + b[0], s0 + b[1]
                n1, s1 = n - n0, s - s0
                if n0 < 5 or n1 < 5:
                    continue
                m = 1 / (1 / n0 + 1 / n1)
                if abs(s0 / n0 - s1 / n1) > np.sqrt(2 / m * spread * bound) + 2 / (3 * m) * bound:
                    break
            else:
                return found
            found = True
            top = max(i for i, row in enumerate(self.rows) if row)
            del self.rows[top][0]


def drift_changes(observations: DataFrame, delta: float = 0.002) -> DataFrame:
    """(entity, at) of changes in each entity's series of (entity, at, value), taken in order of ``at``.

    One entity's series is a group; it holds one row for each sweep, not for each fact.
    """

    def run(series: pd.DataFrame) -> pd.DataFrame:
        window, series = Adwin(delta), series.sort_values("at")
        hits = [a for a, x in zip(series["at"], series["value"]) if window.add(float(x))]
        return pd.DataFrame({"entity": pd.Series([series["entity"].iloc[0]] * len(hits), dtype=object), "at": pd.Series(hits, dtype=object)})

    kinds = dict(observations.dtypes)
    return observations.select("entity", "at", "value").groupBy("entity").applyInPandas(run, f"entity {kinds['entity']}, at {kinds['at']}")
