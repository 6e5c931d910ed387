"""Pairs of entities that may bridge components: who takes part, the best pairs of two components, drift-driven pairs.

Entities of a cluster are packed in cells of similar vectors. Cells, not entities, are joined; a pair of cells is left out
where no cosine across it can reach the least one, the others are multiplied whole and give their best pairs only, so that
nothing is lost and the rows follow the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.stash import stash

CELL_ROWS, SPREAD = 256, 16


def bridge_entities(topology: DataFrame, clusters: DataFrame, speakers: DataFrame, least_core: int = 1) -> DataFrame:
    """(entity_id, component, component_size, cluster) of the entities that may take part.

    ``topology`` has (entity_id, component, component_size, k_core), ``clusters`` (entity_id, cluster), ``speakers``
    (entity_id). Speakers of streams, entities without a component and those of a core number below ``least_core`` (null:
    0) take no part. If the size is missing of any that would, the topology is stale and nobody does. Repeated rows count once.
    """
    rows = topology.select("entity_id", "component", "component_size", "k_core").filter("component is not null and entity_id is not null")
    rows = rows.filter(F.coalesce("k_core", F.lit(0)) >= least_core).join(speakers.select("entity_id").distinct(), "entity_id", "left_anti")
    rows = rows.groupBy("entity_id").agg(F.min(F.struct("component", "component_size")).alias("t")).select("entity_id", "t.*")
    missing = rows.agg(F.count_if(F.col("component_size").isNull()).alias("_missing"))
    fresh = rows.crossJoin(F.broadcast(missing)).filter("_missing = 0")  # one row
    one = clusters.groupBy("entity_id").agg(F.min("cluster").alias("cluster"))
    return fresh.join(one, "entity_id", "left").select("entity_id", "component", "component_size", "cluster")


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, cell_rows: int) -> DataFrame:
    """(cluster, dim, cell, ids, components, vectors, middle, spread) from (entity_id, component, cluster, centre).

    A cell holds vectors with the same largest component (and its sign), about ``cell_rows`` of them by the hash of the id;
    in a cluster of fewer cells than there are such components, those of several.
    ``vectors`` are the unit vectors, ``middle`` is the direction of their sum and ``spread`` the widest angle to it.
    """
    v = rows.filter("cluster is not null and component is not null").filter(_usable(F.col("centre")))
    v = v.withColumn("centre", F.transform("centre", lambda x: x.cast("double"))).withColumn("dim", F.size("centre"))
    largest = F.array_max(F.transform("centre", lambda x, i: F.struct(F.abs(x).alias("x"), i.alias("i"), (x > 0).alias("s"))))
    v = v.withColumn("code", F.when(largest["s"], largest["i"] + 1).otherwise(-largest["i"] - 1))
    counts = v.groupBy("cluster", "dim", "code").agg(F.count("*").alias("n"))  # at most two rows a component of the vectors
    enough = F.ceil(F.sum("n").over(Window.partitionBy("cluster", "dim")) / cell_rows)
    counts = counts.withColumn("slot", F.pmod("code", enough))
    parts = F.ceil(F.sum("n").over(Window.partitionBy("cluster", "dim", "slot")) / cell_rows)
    v = v.join(counts.select("cluster", "dim", "code", "slot", parts.alias("parts")), ["cluster", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")))
    kinds = dict(v.dtypes)

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(cell["centre"].to_numpy())
        x = x / np.abs(x).max(axis=1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        middle = x.sum(axis=0)
        middle = middle / max(np.linalg.norm(middle), 1e-300)
        spread = float(np.arccos(np.clip(x @ middle, -1, 1)).max())
        first = cell.iloc[0]
        told = [first["cluster"], first["dim"], f"{first['slot']}:{first['part']}", list(cell["entity_id"]), list(cell["component"]), x.tobytes(), list(middle), spread]
        return pd.DataFrame([told], columns=["cluster", "dim", "cell", "ids", "components", "vectors", "middle", "spread"])

    kind = f"cluster {kinds['cluster']}, dim int, cell string, ids array<{kinds['entity_id']}>, components array<{kinds['component']}>, vectors binary, middle array<double>, spread double"
    return v.groupBy("cluster", "dim", "slot", "part").applyInPandas(pack, kind)


def _best(x: pd.DataFrame, keys: list[str], most: int) -> pd.DataFrame:
    x = x.sort_values([*keys, "score", "a", "b"], ascending=[True] * len(keys) + [False, True, True])
    return x[x.groupby(keys, sort=False).cumcount() < most]


def _met(left: DataFrame, right: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of packed cells of one cluster that ``near`` leaves, with what both hold.

    Only heads of cells meet on the cluster, dealt by ``SPREAD`` so that a cluster that holds most cells is many tasks.
    """
    place, held = ["cluster", "dim"], ["ids", "components", "vectors"]
    one = left.select(*place, "cell", "middle", "spread", F.pmod(F.xxhash64("cell"), F.lit(SPREAD)).cast("int").alias("_at"))
    two = right.select(*place, *[F.col(c).alias(f"{c}_b") for c in ("cell", "middle", "spread")], F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_at"))
    pairs = near(one.join(two, [*place, "_at"])).select(*place, "cell", "cell_b")
    met = pairs.join(left.select(*place, "cell", *held), [*place, "cell"])
    return met.join(right.select(*place, *[F.col(c).alias(f"{c}_b") for c in ("cell", *held)]), [*place, "cell_b"])


def _multiplied(met: DataFrame, choose: Callable[[dict, np.ndarray], pd.DataFrame], kind: str) -> DataFrame:
    """The rows that ``choose`` takes from the rounded cosines of each pair of packed cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y = (np.frombuffer(row[c]).reshape(-1, row["dim"]) for c in ("vectors", "vectors_b"))
                yield choose(row, np.round(x @ y.T, 9))

    return met.mapInPandas(run, kind)


def cross_component_best(entities: DataFrame, centres: DataFrame, least: float = 0.3, most: int = 5, least_size: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b, ca, cb, score): the ``most`` best pairs of every two components with entities of one cluster, ca < cb.

    ``entities`` as ``bridge_entities`` gives them, ``centres`` (entity_id, centre). Components of fewer than ``least_size``
    members on the whole are left out, as are entities without a cluster or a usable centre. The score is the cosine to nine
    digits and at least ``least``; ties go to the smaller a, then b.
    """
    rows = entities.filter(F.col("component_size") >= least_size).join(centres.select("entity_id", "centre"), "entity_id")
    cells = stash(_packed(rows.select("entity_id", "component", "cluster", "centre"), cell_rows))
    kinds = dict(rows.dtypes)

    def near(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("middle", "middle_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        gap = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) - F.col("spread") - F.col("spread_b")
        return pairs.filter("cell <= cell_b").filter((gap <= 0) | (F.cos(gap) >= least - 1e-7))

    met = _met(cells, cells, near)

    def choose(row: dict, s: np.ndarray) -> pd.DataFrame:
        ca, cb = np.asarray(row["components"]), np.asarray(row["components_b"])
        keep = (s >= least) & (ca[:, None] != cb[None, :])
        if row["cell"] == row["cell_b"]:
            keep &= np.triu(np.ones(s.shape, bool), 1)
        i, j = np.nonzero(keep)
        a, b, ca, cb = np.asarray(row["ids"])[i], np.asarray(row["ids_b"])[j], ca[i], cb[j]
        turned = cb < ca
        told = {"a": np.where(turned, b, a), "b": np.where(turned, a, b), "ca": np.where(turned, cb, ca), "cb": np.where(turned, ca, cb), "score": s[i, j]}
        return _best(pd.DataFrame(told), ["ca", "cb"], most)

    kind, of = kinds["entity_id"], kinds["component"]
    found = _multiplied(met, choose, f"a {kind}, b {kind}, ca {of}, cb {of}, score double")
    rank = F.row_number().over(Window.partitionBy("ca", "cb").orderBy(F.desc("score"), "a", "b"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def drift_best(drifts: DataFrame, entities: DataFrame, centres: DataFrame, most: int = 10, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b, ca, cb, target, score): for each drift (entity_id, target cluster) the ``most`` nearest members of the target.

    Only members in other components than the drifted entity's count, at any score; ties go to the smaller id. A drifted
    entity must be one of ``entities`` itself. Repeated drifts count once, drifts without a target not at all.
    """
    held = entities.join(centres.select("entity_id", "centre"), "entity_id").select("entity_id", "component", "cluster", "centre")
    targets = drifts.select("entity_id", F.col("target").alias("cluster")).filter("cluster is not null").distinct()
    asked = stash(_packed(targets.join(held.drop("cluster"), "entity_id"), cell_rows))
    cells = stash(_packed(held, cell_rows))
    kinds = dict(held.dtypes)
    met = _met(asked, cells, lambda pairs: pairs)

    def choose(row: dict, s: np.ndarray) -> pd.DataFrame:
        ca, cb = np.asarray(row["components"]), np.asarray(row["components_b"])
        i, j = np.nonzero(ca[:, None] != cb[None, :])
        told = pd.DataFrame({"a": np.asarray(row["ids"])[i], "b": np.asarray(row["ids_b"])[j], "ca": ca[i], "cb": cb[j], "target": row["cluster"], "score": s[i, j]})
        return _best(told, ["a"], most)

    kind, of = kinds["entity_id"], kinds["component"]
    found = _multiplied(met, choose, f"a {kind}, b {kind}, ca {of}, cb {of}, target {kinds['cluster']}, score double")
    rank = F.row_number().over(Window.partitionBy("a", "target").orderBy(F.desc("score"), "b"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def bridge_pairs(sweep: DataFrame, drift: DataFrame) -> DataFrame:
    """(a, b, score, drift_driven): the pairs of both ways once each, a < b; a pair that a drift drives is marked so."""
    both = sweep.select("a", "b", "score", F.lit(False).alias("d")).unionByName(drift.select("a", "b", "score", F.lit(True).alias("d")))
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"), F.max("d").alias("drift_driven"))
