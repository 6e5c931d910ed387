"""Running sums and ranks in groups of any size, without sending a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_start(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, out: str, buckets: int = 1024
) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its ``keys`` group.

    The order is by a hash bucket of ``order`` and then by ``order``. Each group is cut into ``buckets`` parts: the
    sums of parts (at most ``buckets`` rows a group) give each part its start, and a window inside the part gives the
    rest. Null keys form a group of their own; ``size`` must not be null.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("_part", part).withColumn("_size", size)
    mine = [f"_k{i}" for i in range(len(keys))]
    sums = (
        rows.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, mine)], F.col("_part").alias("_p"))
        .agg(F.sum("_size").alias("_sum"))
        .withColumn(
            "_base",
            F.sum("_sum").over(Window.partitionBy(*mine).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_sum"),
        )
    )
    on = F.col("_part") == F.col("_p")
    for k, m in zip(keys, mine):
        on = on & F.col(k).eqNullSafe(F.col(m))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(sums, on, "inner")
    return joined.withColumn(out, F.col("_base") + F.sum("_size").over(inside) - F.col("_size")).drop(
        "_part", "_size", "_p", "_sum", "_base", *mine
    )
