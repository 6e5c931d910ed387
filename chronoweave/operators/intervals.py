"""Joins of half-open intervals whose work follows the number of overlapping pairs, not the size of a key's group.

Two intervals overlap when one begins inside the other. The beginnings of one side are numbered in one global order by
key and time, so those inside an interval are a range of numbers. The numbering is a range-partitioned sort with the
counts of the partitions before it, hence a key of any size is spread over many tasks. Ranges are matched in blocks of
neighbouring numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.stash import stash

#: Beginnings in a block: a pair is looked at if its beginning lies in a block that the other interval reaches.
BLOCK = 32
#: What a missing bound stands for, in microseconds.
LOW, FAR = -(1 << 62), 1 << 62


def micros(moment: Column, missing: int) -> Column:
    """A timestamp as a number; null is an open bound."""
    return F.coalesce(F.unix_micros(moment.cast("timestamp")), F.lit(missing).cast("long"))


def numbered(rows: DataFrame, order: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Stashed ``rows`` with the sum of each of ``counts`` over the rows before each in the global, unique ``order``."""
    dealt = stash(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in counts.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_base_{name}") for name in counts])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.join(F.broadcast(base), "_part").select("*", *[(F.col(f"_base_{name}") + F.sum(c).over(within) - c).alias(name) for name, c in counts.items()])
    return told.drop("_part", *[f"_base_{name}" for name in counts])


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(left_id, right_id) of the (keys, id, from, to) rows of equal keys with ``a.from < b.to and a.to > b.from``.

    Bounds are numbers (see ``micros``); ids are unique on each side. An interval that is empty or runs backwards
    overlaps what it begins inside of, if both conditions hold. Rows with a null key or id meet nothing. Each pair is
    returned once: a right one begins inside the left one or with it, or else the left one begins inside the right one.
    """
    sides = [side.select(*keys, "id", "from", "to").dropna(subset=[*keys, "id"]) for side in (left, right)]
    events = None
    for at, side in enumerate(sides):
        for bound, rows in (("to", side.filter("`from` < `to`")), ("from", side)):
            # at one instant: ends, then beginnings of the left, then of the right
            kind = 0 if bound == "to" else 1 + at
            some = rows.select(*keys, F.col(bound).alias("_at"), F.lit(kind).alias("_kind"), F.lit(at).alias("_side"), F.col("id").alias("_id"))
            events = some if events is None else events.unionByName(some)
    begins = [F.when(F.col("_kind") == 1 + at, 1).otherwise(0) for at in (0, 1)]
    told = numbered(events, [*keys, "_at", "_kind", "_side", "_id"], {"_n0": begins[0], "_n1": begins[1]})
    other = F.when(F.col("_side") == 0, F.col("_n1")).otherwise(F.col("_n0"))
    own = F.when(F.col("_side") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    begun = F.col("_kind") > 0
    reach = told.groupBy("_side", "_id").agg(F.max(F.when(begun, other)).alias("lo"), F.max(F.when(~begun, other)).alias("hi")).filter("lo < hi")
    block = F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}")))
    wide = reach.select((1 - F.col("_side")).alias("_side"), F.col("_id").alias("_mine"), "lo", "hi", block.alias("_block"))
    held = told.filter(begun).select("_side", F.col("_id").alias("_theirs"), own.alias("_n")).withColumn("_block", F.expr(f"_n div {BLOCK}"))
    met = wide.join(held, ["_side", "_block"]).filter("_n >= lo and _n < hi")
    found = met.select(F.when(F.col("_side") == 1, F.col("_mine")).otherwise(F.col("_theirs")).alias("left_id"), F.when(F.col("_side") == 1, F.col("_theirs")).otherwise(F.col("_mine")).alias("right_id"))
    return _really(found, sides)


def _really(found: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """Both conditions on the pairs of intervals that are empty or run backwards; the others have passed them."""
    odd = [side.filter("`from` >= `to`").select("id", "from", "to") for side in sides]
    if all(side.isEmpty() for side in odd):
        return found
    met = found
    for name, side, kept in (("left_id", odd[0], sides[1]), ("right_id", odd[1], sides[0])):
        other = "right_id" if name == "left_id" else "left_id"
        mine = met.join(side.toDF(name, "_f", "_t"), name).join(kept.select(F.col("id").alias(other), F.col("from").alias("_of"), F.col("to").alias("_ot")), other)
        bad = mine.filter("not (_f < _ot and _t > _of)").select("left_id", "right_id")
        met = met.join(bad, ["left_id", "right_id"], "left_anti")
    return met
