"""Operator 8: mixing sources to target weights, with DataFrame functions only.

The words of each source are packed into fixed-length blocks. Each output shard draws how many blocks it takes of each
source from a multinomial, given that the counts of all shards add up to the sources' targets: the slots of all shards
are dealt a pseudorandom permutation of the target's blocks. The draws of a source are numbered through all shards; draw
k takes the block at place k mod blocks of a pseudorandom permutation of the source's block indexes, another one for
each epoch k div blocks. Blocks and documents meet on the block's index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.running import running_start
from chronoweave.plans.stash import drop_stash, stash

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the permutation; each swaps about half of the index pairs.
ROUNDS = 16
#: Rows of one bucket of a running sum.
BUCKET_ROWS = 50_000


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """The image of ``place`` under a permutation of 0..n-1 that ``key`` names.

    Each round pairs x with (c - x) mod n, c of the round, and swaps the pair or not by a hash of its larger member:
    a bijection for every n, without sorting and without trying again.
    """

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)) < 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), place, turn)


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size): water-filling of the total by weight under ``cap`` x size.

    Sources are ordered by code point, null last, and take ``weights`` in turn. A source's target is
    ``min(cap * size, level * weight)`` with one level for all, so that the targets sum to the total.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row a source from here on
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)) + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    all_rows = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source, by ratio, that its cap does not stop sets the level
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    per = per.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "level"))).over(all_rows)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def shard_counts(per: DataFrame, shard_blocks: int, seed: int, parts: int) -> DataFrame:
    """(shard, source, drawn): the counts of every output shard.

    ``per`` has (source, share) in blocks. A source owns as many consecutive numbers as its share, rounded. Every slot
    of a shard draws a number without replacement, and one sort inside the shard tells the source of every slot.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    upto = F.round(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    bounds = per.select("source", upto.alias("high"))
    bounds = stash(bounds.withColumn("u", F.coalesce(F.lag("high").over(order), F.lit(0)).cast("long")).filter("high > u"))
    wide = F.lit(shard_blocks).cast("long")
    shards = bounds.groupBy().agg(F.max("high").alias("slots")).filter("slots > 0")
    shards = shards.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / wide).cast("long")))).repartition(parts, "shard")
    first, room = F.col("shard") * wide, F.least(wide, F.col("slots") - F.col("shard") * wide)
    drawn = shards.select("shard", "slots", F.explode(F.sequence(first, first + room - 1)).alias("slot"))
    none = F.lit(None).cast("struct<name:string>")
    drawn = drawn.select("shard", permuted(F.col("slot"), F.col("slots"), F.lit(seed)).alias("u"), F.lit(1).alias("drawn"), none.alias("source"))
    # one row a source, for every shard
    starts = shards.select("shard").join(F.broadcast(bounds), F.lit(True)).select("shard", "u", F.lit(0).alias("drawn"), F.struct(F.col("source").alias("name")).alias("source"))
    owner = F.last("source", ignorenulls=True).over(Window.partitionBy("shard").orderBy("u", "drawn"))
    told = drawn.unionByName(starts).repartition(parts, "shard").withColumn("source", owner).filter("drawn = 1")
    return told.groupBy("shard", F.col("source.name").alias("source")).agg(F.count("*").alias("drawn"))


def drawn_blocks(per: DataFrame, counts: DataFrame, cap: int, seed: int, parts: int) -> DataFrame:
    """(source, shard, k, block) of every draw: the k-th of its source takes ``block``; at most ``cap`` epochs."""
    run = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    of = per.select(F.col("source").alias("_of"), "blocks")
    first = counts.withColumn("first", F.sum("drawn").over(run) - F.col("drawn")).join(of, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    k = first.repartition(parts, "source", "shard").select("source", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)).alias("k"))
    k = k.filter(F.col("k") < F.col("blocks") * cap)
    epoch = F.floor(F.col("k") / F.col("blocks")).cast("long")
    return k.select("source", "shard", "k", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), epoch).alias("block"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 32,
    shard_blocks: int = 65536,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Args: ``weights`` of the sources in turn; ``cap`` the most uses of a word; ``block_words`` the length of a block;
    ``shard_blocks`` the blocks of an output shard; ``seed`` of the draws.
    Returns one row per input row: doc_id, size (words), source_size, target (of the source), taken (words, repeats
    counted). Texts that are null or have no words have size 0 and nothing taken. A null source is a source of its
    own, last in order. Repeated rows are separate documents. An empty table gives an empty table. Reruns agree.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")))
    targets = stash(source_targets(sized, weights, cap))

    placed = stash(running_start(sized, ["source"], ["doc_id", "size"], F.col("size"), "start", max(1024, sized.count() // BUCKET_ROWS)))
    drop_stash(sized)
    block = F.lit(block_words)
    per = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    per = per.withColumn("share", F.col("target") * F.col("blocks") / F.col("source_size")).filter("share > 0")
    counts = stash(shard_counts(per, shard_blocks, seed, parts))
    uses = (
        drawn_blocks(per, counts, cap, seed, parts)
        .groupBy("source", "block")
        .agg(F.count("*").alias("uses"))
        .select(F.col("source").alias("_source"), F.col("block").alias("_block"), "uses")
    )

    end = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((end - 1) / block).cast("long")))
    )
    inside = F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    # both sides grow with the input; the plan's estimate of the draws does not, so the join's kind is named
    met = pieces.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    taken = met.groupBy(F.col("source").alias("_source"), F.col("start").alias("_start")).agg(F.sum(inside * F.col("uses")).alias("_taken"))
    # start is unique among a source's documents that have words
    found = placed.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    goal = targets.select(F.col("source").alias("_of"), "source_size", "target")
    found = found.drop("_source", "_start").join(goal, F.col("source").eqNullSafe(F.col("_of")), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
