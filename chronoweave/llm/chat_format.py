"""Operator 9: chat formatting by cumulative-snapshot collapse, with DataFrame functions only.

Logs often hold a conversation several times, each snapshot longer than the one before. A rolling hash of the turns up
to each position identifies every prefix; a conversation whose whole hash is a proper prefix of another is removed by
an anti-join, equal conversations leave the smallest id, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.stash import drop_stash, stash

#: Turns in one rendered part; a longer conversation gives several parts.
PART_TURNS = 256


def _with_chunk(turns: DataFrame) -> DataFrame:
    """Add the hashes of a turn and its chunk of turn numbers; turns without a number are in the last chunk."""
    body = F.struct("role", "text")
    chunk = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit((1 << 62))).cast("long")
    return turns.withColumns({"h1": F.xxhash64(body), "h2": F.xxhash64(F.lit(1), body), "chunk": chunk})


def _positions(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``pos``, from 1, by the counts of the chunks before and the order inside the chunk."""
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_last(), "h1", "h2")
    other = counts.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "base")
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))
    return rows.join(other, here).withColumn("pos", F.col("base") + F.row_number().over(inside)).drop("_c", "_k", "base")


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) of the conversations that no other one extends, of equal ones the smallest id; and the
    numbers of turns before every chunk.

    ``turns`` has conv_id, turn, role, text. Positions run over the counts of chunks of turn numbers and then inside
    chunks, hashes over chunks of positions, which have ``PART_TURNS`` turns whatever the numbers are. Two 64-bit
    hashes stand for a prefix.
    """
    hashed = stash(_with_chunk(turns).select("conv_id", "turn", "h1", "h2", "chunk"))
    counts = hashed.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    run = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    counts = stash(counts.withColumn("base", F.sum("n").over(run) - F.col("n")))
    part = F.floor((F.col("pos") - 1) / PART_TURNS).cast("long").alias("part")
    keyed = stash(_positions(hashed, counts).select("conv_id", part, "pos", F.xxhash64("pos", "h1", F.lit(2)).alias("x1"), F.xxhash64("pos", "h2", F.lit(3)).alias("x2")))

    sums = keyed.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    run = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    for s in ("s1", "s2"):  # of the parts before this one
        sums = sums.withColumn(s, F.bit_xor(s).over(run).bitwiseXOR(F.col(s)))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("part").alias("_k"), "s1", "s2")
    upto = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_k"))
    prefix = keyed.join(sums, here).select(
        "conv_id",
        "pos",
        F.bit_xor("x1").over(upto).bitwiseXOR(F.col("s1")).alias("p1"),
        F.bit_xor("x2").over(upto).bitwiseXOR(F.col("s2")).alias("p2"),
    )
    prefix = stash(prefix)
    whole = prefix.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("w")).select("conv_id", "w.*")
    lengths = whole.select(F.col("conv_id").alias("_c"), F.col("pos").alias("n_turns"))
    proper = prefix.join(lengths, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") < F.col("n_turns"))).select("pos", "p1", "p2").distinct()
    one = whole.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    kept = stash(one.join(proper, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns")))
    for held in (hashed, keyed, prefix):
        drop_stash(held)
    return kept, counts


def chat_format(conversations: DataFrame) -> DataFrame:
    """Render every maximal conversation of a log with (conv_id, turn, role, text) and any further columns.

    Turns are ordered by number, null last; turns of one number by a hash of role and text. A turn becomes
    ``<|role|>\\ntext<|end|>\\n``; a null role is ``unknown``, a null text empty, and ``<|`` inside either is written
    ``< |``. Rows with a null conv_id form one conversation. Repeated rows are turns of their own.
    Returns conv_id, part, n_turns (of the part), rendered: part p holds the turns 256 p to 256 p + 255 of that order. An
    empty table gives an empty table.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    kept, counts = maximal_conversations(turns)
    mine = _with_chunk(turns).join(kept.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    safe = {c: F.replace(F.coalesce(c, F.lit(default)), F.lit("<|"), F.lit("< |")) for c, default in (("role", "unknown"), ("text", ""))}
    drawn = F.concat(F.lit("<|"), safe["role"], F.lit("|>\n"), safe["text"], F.lit("<|end|>\n"))
    part = F.floor((F.col("pos") - 1) / PART_TURNS).cast("int")
    rows = _positions(mine, counts).select("conv_id", part.alias("part"), F.struct("pos", drawn.alias("drawn")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # PART_TURNS at most
    return parts.select("conv_id", "part", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["drawn"]), "").alias("rendered"))
