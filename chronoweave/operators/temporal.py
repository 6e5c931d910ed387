"""Bi-temporal facts: reads at an instant, supersession, and changes as (new state, history) pairs.

A fact is valid in ``[valid_at, invalid_at)`` and known in ``[created_at, expired_at)``; a null bound is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.intervals import FAR, LOW, micros, overlapping
from chronoweave.plans.stash import stash


def at(instant: str) -> Column:
    return F.lit(instant).cast("timestamp")


def active(facts: DataFrame) -> DataFrame:
    """Facts not expired."""
    return facts.filter("expired_at is null")


def facts_at_time(facts: DataFrame, instant: Column) -> DataFrame:
    """Facts known and valid at the instant."""
    known = (F.col("created_at") <= instant) & (F.col("expired_at").isNull() | (F.col("expired_at") > instant))
    valid = (F.col("valid_at").isNull() | (F.col("valid_at") <= instant)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > instant))
    return facts.filter(known & valid)


def facts_at_times(facts: DataFrame, times: DataFrame) -> DataFrame:
    """The same for every row of ``times`` (at): a broadcast range join; ``times`` is a short list of instants."""
    at_ = F.col("at")
    known = (F.col("created_at") <= at_) & (F.col("expired_at").isNull() | (F.col("expired_at") > at_))
    valid = (F.col("valid_at").isNull() | (F.col("valid_at") <= at_)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at_))
    return facts.join(F.broadcast(times), known & valid)


def current_facts(facts: DataFrame, now: Column) -> DataFrame:
    """Facts neither expired nor invalid at ``now``."""
    return facts.filter(F.col("expired_at").isNull() & (F.col("invalid_at").isNull() | (F.col("invalid_at") > now)))


def superseded_by(facts: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, fact_id): active facts of the same subject and predicate whose validity overlaps a new fact's.

    An old fact without a start overlaps every new one that begins before it ends; half-open neighbours do not overlap.
    """
    keys = ["subject_id", "predicate"]
    span = [micros(F.col("valid_at"), LOW).alias("from"), micros(F.col("invalid_at"), FAR).alias("to")]
    n = new.select(*keys, F.col("fact_id").alias("id"), *span)
    o = active(facts).select(*keys, F.col("fact_id").alias("id"), *span)
    return overlapping(n, o, keys).toDF("new_id", "fact_id").filter("fact_id <> new_id")


def validity_chain(facts: DataFrame) -> DataFrame:
    """Each fact of a subject and predicate ends where the next one begins."""
    order = Window.partitionBy("subject_id", "predicate").orderBy("valid_at", "created_at", "fact_id")
    return facts.withColumn("next_valid_at", F.lead("valid_at").over(order))


def fold_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Create facts in batch: equal active triples corroborate one another, an exclusive predicate forms a chain.

    Returns one row per triple and start: confidence (the largest), observations, ends_at (exclusive predicates only).
    """
    triple = ["subject_id", "predicate", "object_id", "object_value", "valid_at"]
    one = requests.groupBy(*triple).agg(F.max("confidence").alias("confidence"), F.count("*").alias("observations"), F.min("fact_id").alias("fact_id"))
    one = one.join(F.broadcast(registry), "predicate", "left")
    order = Window.partitionBy("subject_id", "predicate").orderBy("valid_at", "fact_id")
    return one.withColumn("ends_at", F.when(F.col("is_exclusive"), F.lead("valid_at").over(order)))


def create_facts(facts: DataFrame, requests: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, history) after facts are asked for in their order of ``created_at`` and ``fact_id``.

    A request whose triple is active raises that fact's confidence to the larger one; others are inserted. Under an
    exclusive predicate a request expires every active fact of its subject and predicate, older in order, that has
    another object and a validity overlapping its own, at its ``created_at``. ``facts`` and ``requests`` have the same
    columns; ``registry`` (predicate, is_exclusive) is the vocabulary.
    """
    columns = facts.columns
    triple = ["subject_id", "predicate", "object_id", "object_value"]
    key = F.xxhash64(*triple)
    order = F.struct("created_at", "fact_id")
    asked = requests.withColumn("_key", key).groupBy("_key", *triple).agg(F.min_by(F.struct(*[c for c in columns if c not in triple]), order).alias("r"), F.max("confidence").alias("_most"), F.count("*").alias("_n"))
    asked = asked.select("_key", *triple, "r.*", "_most", "_n")
    open_ = active(facts).withColumn("_key", key)
    same = F.expr(" and ".join(f"o.{c} <=> q.{c}" for c in triple))
    held = open_.select("fact_id", "_key", *triple, F.col("confidence").alias("_was")).alias("o").join(asked.select("_key", *triple, "_most", "_n").alias("q"), (F.col("o._key") == F.col("q._key")) & same)
    held = held.groupBy("o.fact_id").agg(F.max("q._most").alias("_most"), F.max("o._was").alias("_was"))
    known = open_.select("_key", *triple).alias("o")
    new = asked.alias("q").join(known, (F.col("o._key") == F.col("q._key")) & same, "left_anti").withColumn("confidence", F.col("_most"))
    rows = facts.join(held.select("fact_id", "_most"), "fact_id", "left").withColumn("confidence", F.when(F.col("expired_at").isNull(), F.greatest("confidence", "_most")).otherwise(F.col("confidence")))
    state = rows.select(columns).unionByName(new.select(columns))
    # what a later request of an exclusive predicate overlaps goes
    exclusive = F.broadcast(registry.filter("is_exclusive").select("predicate"))  # the vocabulary
    span = [micros(F.col("valid_at"), LOW).alias("from"), micros(F.col("invalid_at"), FAR).alias("to")]
    value, by = F.coalesce("object_id", "object_value"), order
    q = stash(requests.join(exclusive, "predicate", "left_semi").select("subject_id", "predicate", F.col("fact_id").alias("id"), *span, value.alias("_qo"), by.alias("_by")))
    o = stash(active(state).join(exclusive, "predicate", "left_semi").select("subject_id", "predicate", F.col("fact_id").alias("id"), *span, value.alias("_o"), by.alias("_own")))
    met = overlapping(q, o, ["subject_id", "predicate"]).join(q.select(F.col("id").alias("left_id"), "_qo", "_by"), "left_id").join(o.select(F.col("id").alias("right_id"), "_o", "_own"), "right_id")
    gone = met.filter("_by > _own and _o <> _qo").groupBy(F.col("right_id").alias("fact_id")).agg(F.min("_by").alias("_by")).select("fact_id", F.col("_by.created_at").alias("_gone"))
    state = state.join(gone, "fact_id", "left").withColumn("expired_at", F.coalesce("expired_at", "_gone")).select(columns)
    event = lambda frame, kind: frame.select("fact_id", kind.alias("event_type"))
    history = event(held, F.when(F.col("_most") > F.col("_was"), "confidence_raised").otherwise("revised"))
    history = history.unionByName(event(new, F.lit("created"))).unionByName(event(gone, F.lit("superseded")))
    return state, history


def source_observations(table: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert (fact_id, source_id, observed_at): counts add up, first_at is kept and last_at is the newest."""
    new = seen.groupBy("fact_id", "source_id").agg(F.count("*").alias("_n"), F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last"))
    met = table.join(new, ["fact_id", "source_id"], "full_outer")
    return met.select("fact_id", "source_id", (F.coalesce("observed", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("observed"), F.coalesce("first_at", "_first").alias("first_at"), F.greatest("last_at", "_last").alias("last_at"))


def bridge_warnings(expired: DataFrame, bridges: DataFrame) -> DataFrame:
    """(fact_id, is_bridge) of facts about to expire: whether losing it splits the graph, by the (edge_id) bridges."""
    b = bridges.select(F.col("edge_id").alias("fact_id"), F.lit(True).alias("_b")).distinct()
    return expired.select("fact_id").join(b, "fact_id", "left").select("fact_id", F.coalesce("_b", F.lit(False)).alias("is_bridge"))


def transition_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fact_id, transition_type, delta_confidence) of every fact whose state changed; what expired loses all of it."""
    b = before.select("fact_id", F.col("confidence").alias("_c"), F.col("expired_at").alias("_e"), F.col("invalid_at").alias("_i"), F.lit(True).alias("_b"))
    met = after.join(b, "fact_id", "left")
    gone, back = F.col("_e").isNull() & F.col("expired_at").isNotNull(), F.col("_e").isNotNull() & F.col("expired_at").isNull()
    kind = (
        F.when(F.col("_b").isNull(), "created")
        .when(gone, "expired")
        .when(back, "restored")
        .when(F.col("_i").isNull() & F.col("invalid_at").isNotNull(), "invalidated")
        .when(F.col("confidence") > F.col("_c"), "strengthened")
        .when(F.col("confidence") < F.col("_c"), "weakened")
    )
    delta = F.when(F.col("_b").isNull() | back, F.col("confidence")).when(gone | (kind == "invalidated"), -F.col("_c")).otherwise(F.col("confidence") - F.col("_c"))
    return met.select("fact_id", kind.alias("transition_type"), delta.alias("delta_confidence")).filter("transition_type is not null")


def corroboration_event(raised: Column, new_source: Column) -> Column:
    """What a repeated observation writes in the history."""
    return F.when(raised, "confidence_raised").when(new_source, "revised").otherwise("none")


def expire(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft-delete by (fact_id, at, reason); a fact already expired stays as it is and leaves no history."""
    return _change(facts, requests, "expired_at", F.col("expired_at").isNull(), "expired")


def invalidate(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """End the event time of facts by (fact_id, at, reason); a fact already ended stays."""
    return _change(facts, requests, "invalid_at", F.col("invalid_at").isNull(), "invalidated")


def _change(facts: DataFrame, requests: DataFrame, column: str, open_: Column, event: str) -> tuple[DataFrame, DataFrame]:
    first = requests.groupBy("fact_id").agg(F.min(F.struct("at", "reason")).alias("q"))
    met = facts.join(first, "fact_id", "left").withColumn("_do", F.col("q").isNotNull() & open_)
    state = met.withColumn(column, F.when(F.col("_do"), F.col("q.at")).otherwise(F.col(column))).drop("q", "_do")
    history = met.filter("_do").select("fact_id", F.lit(event).alias("event_type"), F.col("q.reason").alias("reasoning"), F.col("q.at").alias("occurred_at"))
    return state, history


def change_confidence(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set confidence by (fact_id, confidence); out-of-range and equal values are no change."""
    asked = requests.select("fact_id", F.col("confidence").alias("_new")).filter("_new between 0 and 1").groupBy("fact_id").agg(F.max("_new").alias("_new"))
    met = facts.join(asked, "fact_id", "left").withColumn("_do", F.coalesce(F.col("_new") != F.col("confidence"), F.lit(False)))
    event = F.when(F.col("_new") > F.col("confidence"), "confidence_raised").otherwise("confidence_lowered")
    history = met.filter("_do").select("fact_id", event.alias("event_type"), F.col("confidence").alias("previous"), F.col("_new").alias("new"))
    return met.withColumn("confidence", F.when(F.col("_do"), F.col("_new")).otherwise(F.col("confidence"))).drop("_new", "_do"), history


def restore(facts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear the expiry and end of facts; those that have neither are left alone."""
    met = facts.join(ids.select("fact_id", F.lit(True).alias("_ask")).distinct(), "fact_id", "left")
    do = F.col("_ask").isNotNull() & (F.col("expired_at").isNotNull() | F.col("invalid_at").isNotNull())
    met = met.withColumn("_do", do)
    state = met.withColumns({c: F.when(~F.col("_do"), F.col(c)) for c in ("expired_at", "invalid_at")}).drop("_ask", "_do")
    return state, met.filter("_do").select("fact_id", F.lit("restored").alias("event_type"))


def transition(rows: DataFrame, requests: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move (key, status) rows by (key, to) where (status, to) is allowed; the rest are returned as rejects."""
    met = rows.join(requests, "key").join(F.broadcast(allowed.withColumn("_ok", F.lit(True))), ["status", "to"], "left")
    return met.filter("_ok").select("key", F.col("to").alias("status")), met.filter("_ok is null").select("key", "status", "to")


def optimistic_write(rows: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Outcome of (key, expected, text, at) writes: stale_write, too_long, accepted (the first of a key) or superseded."""
    met = requests.join(rows.select("key", F.col("updated_at").alias("_now")), "key")
    fit = met.withColumn("outcome", F.when(F.length("text") > limit, "too_long").when(~F.col("expected").eqNullSafe(F.col("_now")), "stale_write"))
    first = Window.partitionBy("key", F.col("outcome").isNull()).orderBy("at", "request_id")
    return fit.withColumn("_r", F.row_number().over(first)).withColumn("outcome", F.coalesce("outcome", F.when(F.col("_r") == 1, "accepted").otherwise("superseded"))).select("request_id", "key", "outcome")


def sync_vocabulary(held: DataFrame, seed: DataFrame) -> DataFrame:
    """Predicates (predicate, usage) after a seed (predicate, alias, multi): new ones are added, known ones get its terms."""
    met = held.join(seed, "predicate", "full_outer")
    outcome = F.when(F.col("usage").isNull(), "inserted").when(F.col("alias").isNull(), "kept").otherwise("refreshed")
    return met.withColumn("outcome", outcome).withColumn("usage", F.coalesce("usage", F.lit(0)))
