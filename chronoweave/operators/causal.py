"""Causal graph: edge checks, corroboration, decay, bounded traces, chain patterns, contradictions and blast radius."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators.intervals import numbered
from chronoweave.plans.stash import stash


def check_edges(edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): no self loop, strength in [0, 1], both events known."""
    ids = events.select(F.col("event_id").alias("_id"), F.lit(True).alias("_known"))
    met = edges.join(ids.withColumnsRenamed({"_id": "cause_event_id", "_known": "_c"}), "cause_event_id", "left")
    met = met.join(ids.withColumnsRenamed({"_id": "effect_event_id", "_known": "_e"}), "effect_event_id", "left")
    reason = (
        F.when(F.col("cause_event_id") == F.col("effect_event_id"), "self_loop")
        .when(~F.col("strength").between(0, 1), "strength")
        .when(F.col("_c").isNull() | F.col("_e").isNull(), "unknown_event")
    )
    met = met.withColumn("reason", reason)
    return met.filter("reason is null").select(edges.columns), met.filter("reason is not null").select(*edges.columns, "reason")


def corroborate(edges: DataFrame, new: DataFrame, step: float = 0.05) -> DataFrame:
    """Edges after ``new`` (cause_event_id, effect_event_id) observations: each adds ``step`` up to 1 and one count."""
    seen = new.groupBy("cause_event_id", "effect_event_id").agg(F.count("*").alias("_n"))
    met = edges.join(seen, ["cause_event_id", "effect_event_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    strength = F.least(F.lit(1.0), F.col("strength") + F.col("_n") * step)
    return met.withColumn("strength", F.when(F.col("_n") > 0, strength).otherwise(F.col("strength"))).withColumn("corroboration_count", F.col("corroboration_count") + F.col("_n")).drop("_n")


def corroborate_or_insert(edges: DataFrame, new: DataFrame, events: DataFrame, step: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(edges after ``new`` observations, edges to insert) of (edge_id, cause_event_id, effect_event_id, strength) rows.

    An observation goes to the open edge of its two events; else to the strongest, then oldest, open edge whose ends have
    the same entities and predicates; else those of one meaning make one new edge, of the first observation, with a count.
    Each adds ``step`` up to 1 and one count.
    """
    kind = events.select("event_id", F.concat_ws("|", "subject_id", "predicate").alias("_k"))

    def meant(rows: DataFrame) -> DataFrame:
        met = rows.join(kind.toDF("cause_event_id", "_kc"), "cause_event_id", "left").join(kind.toDF("effect_event_id", "_ke"), "effect_event_id", "left")
        return met.withColumn("_meaning", F.concat_ws(">", "_kc", "_ke")).drop("_kc", "_ke")

    open_ = meant(edges.filter("expired_at is null").select("edge_id", "cause_event_id", "effect_event_id", "strength"))
    asked = meant(new.select(F.col("edge_id").alias("_new"), "cause_event_id", "effect_event_id", F.col("strength").alias("_s")))
    exact = open_.groupBy("cause_event_id", "effect_event_id").agg(F.min("edge_id").alias("_exact"))
    alike = open_.groupBy("_meaning").agg(F.min(F.struct(-F.col("strength"), F.col("edge_id"))).alias("m")).select("_meaning", F.col("m.edge_id").alias("_alike"))
    met = asked.join(exact, ["cause_event_id", "effect_event_id"], "left").join(alike, "_meaning", "left").withColumn("_to", F.coalesce("_exact", "_alike"))
    seen = met.filter("_to is not null").groupBy(F.col("_to").alias("edge_id")).agg(F.count("*").alias("_n"))
    raised = edges.join(seen, "edge_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    strength = F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.col("strength") + F.col("_n") * step)).otherwise(F.col("strength"))
    raised = raised.withColumn("strength", strength).withColumn("corroboration_count", F.col("corroboration_count") + F.col("_n")).drop("_n")
    fresh = met.filter("_to is null").groupBy("_meaning").agg(F.min_by(F.struct("cause_event_id", "effect_event_id", "_s"), "_new").alias("f"), F.min("_new").alias("edge_id"), F.count("*").alias("corroboration_count"))
    strength = F.least(F.lit(1.0), F.col("f._s") + (F.col("corroboration_count") - 1) * step)
    return raised, fresh.select("edge_id", "f.cause_event_id", "f.effect_event_id", strength.alias("strength"), "corroboration_count")


def expire_edges(edges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, history) after (edge_id, at, reason): an edge expires once, with a reason."""
    first = requests.filter(F.length(F.trim("reason")) > 0).groupBy("edge_id").agg(F.min(F.struct("at", "reason")).alias("q"))
    met = edges.join(first, "edge_id", "left").withColumn("_do", F.col("q").isNotNull() & F.col("expired_at").isNull())
    history = met.filter("_do").select("edge_id", F.lit("expired").alias("event_type"), F.col("strength").alias("previous"), F.col("q.reason").alias("reasoning"))
    return met.withColumn("expired_at", F.when(F.col("_do"), F.col("q.at")).otherwise(F.col("expired_at"))).drop("q", "_do"), history


def cascade(edges: DataFrame, refs: DataFrame, expired: DataFrame, factor: float = 0.8, floor: float = 0.1) -> DataFrame:
    """(edge_id, outcome, strength): edges that cite expired facts are weakened, or expired when nothing else holds them."""
    gone = refs.join(expired.select("fact_id").distinct(), "fact_id").groupBy("edge_id").agg(F.count_distinct("fact_id").alias("n"))
    met = edges.filter("expired_at is null").join(gone, "edge_id")
    weak = F.greatest(F.lit(floor), F.col("strength") * F.pow(F.lit(factor), F.col("n")))
    held = F.col("corroboration_count") > 1
    return met.select("edge_id", F.when(held, "weakened").otherwise("expired").alias("outcome"), F.when(held, weak).alias("strength"))


def decay(edges: DataFrame, now: Column, days: int = 30, rate: float = 0.95, floor: float = 0.1, source: str | None = None) -> DataFrame:
    """(edge_id, outcome, strength) of old edges seen once: decayed by ``rate``, or expired below ``floor``.

    With ``source`` only edges that this source inferred decay.
    """
    edges = edges if source is None else edges.filter(F.col("inferred_by") == source)
    old = edges.filter(F.col("expired_at").isNull() & (F.col("corroboration_count") <= 1) & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))
    less = F.col("strength") * rate
    return old.select("edge_id", F.when(less < floor, "expired").otherwise("decayed").alias("outcome"), F.greatest(F.lit(floor), less).alias("strength"))


def trace(edges: DataFrame, seeds: DataFrame, depth: int, least: float, backward: bool) -> DataFrame:
    """(seed, event_id, depth, strength): all paths from each seed event, without an event twice in a path.

    A loop of equi-joins on the frontier, ``depth`` long; ``strength`` is that of the last edge.
    """
    here, there = ("effect_event_id", "cause_event_id") if backward else ("cause_event_id", "effect_event_id")
    steps = edges.filter(F.col("expired_at").isNull() & (F.col("strength") >= least)).select(F.col(here).alias("_at"), F.col(there).alias("_to"), "strength")
    front = seeds.select(F.col("event_id").alias("seed"), F.col("event_id"), F.array("event_id").alias("_path"))
    found = []
    for d in range(1, depth + 1):
        met = front.select("seed", F.col("event_id").alias("_last"), "_path").join(steps, F.col("_last") == F.col("_at")).filter(~F.array_contains("_path", F.col("_to")))
        front = met.select("seed", F.col("_to").alias("event_id"), F.array_append("_path", F.col("_to")).alias("_path"), F.lit(d).alias("depth"), "strength")
        found.append(front.select("seed", "event_id", "depth", "strength"))
    return reduce(DataFrame.unionByName, found)


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, edge_id, depth): edges of both directions within ``depth`` steps, each at its shortest.

    An edge is extended effect to cause or cause to effect, never to a sibling; visited edges leave the frontier.
    """
    e = edges.filter("expired_at is null").select("edge_id", "cause_event_id", "effect_event_id")
    down = e.join(roots.select("root", F.col("event_id").alias("cause_event_id")), "cause_event_id").select("root", "edge_id", "cause_event_id", "effect_event_id")
    up = e.join(roots.select("root", F.col("event_id").alias("effect_event_id")), "effect_event_id").select("root", "edge_id", "cause_event_id", "effect_event_id")
    front = stash(down.union(up).dropDuplicates(["root", "edge_id"]))
    seen = front.select("root", "edge_id", F.lit(1).alias("depth"))
    for d in range(2, depth + 1):
        f = front.select("root", F.col("cause_event_id").alias("_c"), F.col("effect_event_id").alias("_e"))
        after = e.join(f, e["cause_event_id"] == f["_e"]).select("root", "edge_id", "cause_event_id", "effect_event_id")
        before = e.join(f, e["effect_event_id"] == f["_c"]).select("root", "edge_id", "cause_event_id", "effect_event_id")
        front = stash(after.union(before).dropDuplicates(["root", "edge_id"]).join(seen, ["root", "edge_id"], "left_anti"))
        seen = seen.union(front.select("root", "edge_id", F.lit(d).alias("depth")))
    return seen


def chains(edges: DataFrame, since: Column, low: int = 2, high: int = 6) -> DataFrame:
    """(edges, events): forward chains of ``low`` to ``high`` edges whose first edge is not older than ``since``."""
    e = edges.filter("expired_at is null").select("edge_id", "cause_event_id", "effect_event_id", "created_at")
    now = e.filter(F.col("created_at") >= since).select(F.array("edge_id").alias("edges"), F.array("cause_event_id", "effect_event_id").alias("events"), F.col("effect_event_id").alias("_end"))
    step = e.select("edge_id", F.col("cause_event_id").alias("_end"), "effect_event_id")
    found = []
    for n in range(2, high + 1):
        met = now.join(step, "_end").filter(~F.array_contains("edges", F.col("edge_id")))
        now = met.select(F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("events", F.col("effect_event_id")).alias("events"), F.col("effect_event_id").alias("_end"))
        if n >= low:
            found.append(now.select("edges", "events"))
    return reduce(DataFrame.unionByName, found)


def event_nodes(events: DataFrame, kinds: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(event_id, node): an event as ``type:category``, or its predicate where that has no category.

    ``kinds`` has (subject_id, entity_type).
    """
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    met = events.join(kinds, "subject_id", "left")
    return met.select("event_id", F.concat(F.coalesce("entity_type", F.lit("other")), F.lit(":"), F.coalesce(F.element_at(table, F.col("predicate")), F.col("predicate"))).alias("node"))


def templates(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edges, template): each chain's events as the path of their (event_id, node)."""
    rows = found.select("edges", F.posexplode("events").alias("i", "event_id")).join(nodes, "event_id")
    path = F.transform(F.sort_array(F.collect_list(F.struct("i", "node"))), lambda s: s["node"])  # a chain's length at most
    return rows.groupBy("edges").agg(F.array_join(path, ">").alias("template"))


def named_chains(edges: DataFrame, nodes: DataFrame, since: Column, low: int = 2, high: int = 6) -> DataFrame:
    """(edges, template): ``chains`` with the path of their (event_id, node), which grows with the chain.

    An event has one node at most; one without a node is left out of the path.
    """
    named = nodes.groupBy("event_id").agg(F.min("node").alias("node"))
    e = edges.filter("expired_at is null").select("edge_id", "cause_event_id", "effect_event_id", "created_at")
    e = e.join(named.toDF("effect_event_id", "_to"), "effect_event_id", "left")
    first = e.filter(F.col("created_at") >= since).join(named.toDF("cause_event_id", "_from"), "cause_event_id", "left")
    now = first.select(F.array("edge_id").alias("edges"), F.concat_ws(">", "_from", "_to").alias("template"), F.col("effect_event_id").alias("_end"))
    step = e.select("edge_id", F.col("cause_event_id").alias("_end"), "effect_event_id", "_to")
    found = []
    for n in range(2, high + 1):
        met = now.join(step, "_end").filter(~F.array_contains("edges", F.col("edge_id")))
        path = F.when(F.col("template") == "", F.coalesce("_to", F.lit(""))).otherwise(F.concat_ws(">", "template", "_to"))
        now = met.select(F.array_append("edges", F.col("edge_id")).alias("edges"), path.alias("template"), F.col("effect_event_id").alias("_end"))
        if n >= low:
            found.append(now.filter("template <> ''").select("edges", "template"))
    return reduce(DataFrame.unionByName, found)


def patterns(named: DataFrame, least: int = 3) -> DataFrame:
    """(template, instances) of templates with at least ``least`` chains."""
    return named.groupBy("template").agg(F.count("*").alias("instances")).filter(F.col("instances") >= least)


def upsert_patterns(held: DataFrame, named: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(template, instances, avg_strength, status) after new chains: known patterns get the new counts and averages."""
    new = patterns(named, least)
    rows = named.join(new.select("template"), "template", "left_semi").select("template", F.explode("edges").alias("edge_id"))
    mean = rows.join(edges.select("edge_id", "strength"), "edge_id").groupBy("template").agg(F.avg("strength").alias("avg_strength"))
    met = held.select("template", "status", F.col("instances").alias("_old")).join(new.join(mean, "template"), "template", "full_outer")
    return met.select("template", F.coalesce("instances", "_old").alias("instances"), "avg_strength", F.coalesce("status", F.lit("staging")).alias("status"))


def stamp_edges(named: DataFrame, kept: DataFrame) -> DataFrame:
    """(edge_id, template, position): the first pattern, by name, that an edge stands in and its first place there."""
    codes = stash(numbered(kept.select("template"), ["template"], {"code": F.lit(1)}).select("template", F.col("code").cast("long")))
    rows = named.join(codes, "template").select("code", F.posexplode("edges").alias("position", "edge_id"))
    # a number for name and place: places are fewer than 1024
    first = rows.groupBy("edge_id").agg(F.min(F.col("code") * 1024 + F.col("position")).alias("m"))
    return first.select("edge_id", F.expr("m div 1024").alias("code"), F.expr("cast(m % 1024 as int)").alias("position")).join(codes, "code").select("edge_id", "template", "position")


def match_edges(edges: DataFrame, nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """(edge_id, template, position) of open edges that fit two neighbouring nodes of a pattern: the first by name and place."""
    parts = F.split("template", ">")
    windows = kept.select("template", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.element_at(parts, i), F.lit(">"), F.element_at(parts, i + 1)))).alias("position", "pair"))
    first = windows.groupBy("pair").agg(F.min(F.struct("template", "position")).alias("m"))
    met = edges.filter("expired_at is null").join(nodes.toDF("cause_event_id", "_a"), "cause_event_id").join(nodes.toDF("effect_event_id", "_b"), "effect_event_id")
    return met.withColumn("pair", F.concat("_a", F.lit(">"), "_b")).join(first, "pair").select("edge_id", "m.template", "m.position")


def ghost_links(stamped: DataFrame, edges: DataFrame, events: DataFrame, kept: DataFrame, most: int = 10) -> DataFrame:
    """(entity, template, missing, confidence): entities that cover all places of a pattern but one, the best of each.

    Confidence is the mean strength of the covering edges times the share of places covered.
    """
    size = kept.select("template", (F.size(F.split("template", ">")) - 1).alias("n"))
    e = edges.filter("expired_at is null").select("edge_id", "cause_event_id", "strength")
    met = stamped.join(e, "edge_id").join(events.select(F.col("event_id").alias("cause_event_id"), F.col("subject_id").alias("entity")), "cause_event_id")
    g = met.groupBy("entity", "template").agg(F.collect_set("position").alias("_p"), F.avg("strength").alias("_s")).join(size, "template")  # a pattern's length at most
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "_p")
    g = g.filter((F.size(left) == 1) & (F.col("n") > 1)).select("entity", "template", F.element_at(left, 1).alias("missing"), (F.col("_s") * (F.col("n") - 1) / F.col("n")).alias("confidence"))
    r = F.row_number().over(Window.partitionBy("entity").orderBy(F.round("confidence", 9).desc(), "template"))
    return g.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def pattern_impact(stamped: DataFrame, edges: DataFrame, roots: DataFrame, kept: DataFrame) -> DataFrame:
    """(root, template, touching, outside, need): patterns with an edge at a root's events, and their edges elsewhere."""
    total = stamped.groupBy("template").agg(F.count("*").alias("_all"))
    e = edges.select("edge_id", "cause_event_id", "effect_event_id")
    ends = e.select("edge_id", F.col("cause_event_id").alias("event_id")).union(e.select("edge_id", "effect_event_id"))
    touch = ends.join(roots, "event_id").join(stamped.select("edge_id", "template"), "edge_id").groupBy("root", "template").agg(F.count_distinct("edge_id").alias("touching"))
    met = touch.join(total, "template").join(kept.select("template"), "template", "left_semi")
    return met.select("root", "template", "touching", (F.col("_all") - F.col("touching")).alias("outside"), (F.size(F.split("template", ">")) - 1).alias("need"))


def impact_severity(expiring: bool = True) -> Column:
    """The severity of impact nodes by the first rule that fits.

    Columns: relationship (citation, transitive, direct, pattern_member), node_type, depth, strength, corroboration_count,
    other_sources, other_causes, outside, need; what does not apply to a node is null.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = F.col("relationship")
    sole = (kind == "citation") & F.lit(expiring) & (n("other_sources") == 0)
    step = F.when(n("other_causes") == 0, "high").when(n("other_causes") <= 2, "medium").otherwise("low")
    member = F.when(n("outside") == 0, "high").when(n("outside") < n("need"), "medium").otherwise("low")
    return (
        F.when(sole & (n("corroboration_count") >= 3), "critical")
        .when(sole, "high")
        .when((kind == "transitive") & (F.col("depth") == 1), step)
        .when((kind == "citation") & (n("strength") >= 0.7), "high")
        .when(kind == "citation", "medium")
        .when((kind == "direct") & (F.col("node_type") == "fact"), "medium")
        .when((kind == "direct") & (F.col("node_type") == "causal_edge"), "high")
        .when((kind == "transitive") & (F.col("depth") == 2), "medium")
        .when(kind == "transitive", "low")
        .when(kind == "pattern_member", member)
        .otherwise("medium")
    )


def promote(rows: DataFrame) -> DataFrame:
    """The next status of patterns from one snapshot: (instances, activations, age_days, idle_days, dwell_days, status)."""
    up = (
        F.when((F.col("status") == "staging") & (F.col("instances") >= 5) & (F.col("age_days") >= 14), "candidate")
        .when((F.col("status") == "candidate") & (F.col("instances") >= 10) & (F.col("activations") >= 3), "provisional")
        .when((F.col("status") == "provisional") & (F.col("dwell_days") >= 14) & (F.col("activations") >= 5), "canonical")
    )
    down = (
        F.when((F.col("status") == "staging") & (F.col("idle_days") >= 14), "rejected")
        .when((F.col("status") == "canonical") & (F.col("idle_days") >= 30), "provisional")
        .when((F.col("status") == "provisional") & (F.col("idle_days") >= 30), "candidate")
    )
    return rows.withColumn("next", F.coalesce(down, up, F.col("status")))


def opposing_objects(facts: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Pairs of open facts of one subject and a predicate that is not exclusive, with different values."""
    f = facts.filter("expired_at is null and invalid_at is null").join(F.broadcast(exclusive), "predicate", "left_anti")
    f = f.withColumn("_v", F.coalesce("object_id", "object_value"))
    a = f.select("subject_id", "predicate", F.col("fact_id").alias("a"), F.col("_v").alias("va"), F.col("confidence").alias("ca"))
    b = f.select("subject_id", "predicate", F.col("fact_id").alias("b"), F.col("_v").alias("vb"), F.col("confidence").alias("cb"))
    pairs = a.join(b, ["subject_id", "predicate"]).filter("a < b and va <> vb")
    return pairs.select("a", "b", F.when(F.greatest("ca", "cb") >= 0.8, "high").otherwise("medium").alias("severity"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of open edges that are each other's reverse."""
    e = edges.filter("expired_at is null")
    a = e.select(F.col("edge_id").alias("a"), "cause_event_id", "effect_event_id")
    b = e.select(F.col("edge_id").alias("b"), F.col("effect_event_id").alias("cause_event_id"), F.col("cause_event_id").alias("effect_event_id"))
    return a.join(b, ["cause_event_id", "effect_event_id"]).filter("a < b").select("a", "b")


def impossible_order(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(edge_id, inversion_s): open edges whose cause lies after the effect."""
    at = events.select("event_id", (F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1e6).alias("s"))
    c = at.select(F.col("event_id").alias("cause_event_id"), F.col("s").alias("_c"))
    e = at.select(F.col("event_id").alias("effect_event_id"), F.col("s").alias("_e"))
    return edges.filter("expired_at is null").join(c, "cause_event_id").join(e, "effect_event_id").filter("_c > _e").select("edge_id", F.round(F.col("_c") - F.col("_e"), 3).alias("inversion_s"))


def classify_pair(multi: list[str], functional: list[str]) -> Column:
    """Rules over (pa, pb, oa, ob, overlaps) of two facts of one subject, in order; what none decides needs review.

    Predicates and objects are compared by their normal forms. Equal facts are the same; predicates that deny each other
    contradict while both hold; a predicate of many values is compatible with itself; one of a single value contradicts
    while both hold; two values of one slot (``slot: value``) contradict at any time; single values in turn succeed.
    """
    pa, pb = S.predicate_name(F.col("pa")), S.predicate_name(F.col("pb"))
    same = pa == pb
    one, two = S.slot_value(F.col("oa")), S.slot_value(F.col("ob"))
    return (
        F.when(same & (S.object_name(F.col("oa")) == S.object_name(F.col("ob"))), "same")
        .when(S.antonyms(F.col("pa"), F.col("pb")) & F.col("overlaps"), "contradiction")
        .when(same & pa.isin(multi), "compatible")
        .when(same & pa.isin(functional) & F.col("overlaps"), "contradiction")
        .when(same & (one["slot"] == two["slot"]) & (one["value"] != two["value"]), "contradiction")
        .when(same & pa.isin(functional), "succession")
        .otherwise("needs_review")
    )


def all_findings(rules: dict[str, DataFrame], open_rows: DataFrame) -> DataFrame:
    """(kind, a, b) of every rule's (a, b), each pair once and none that is open already."""
    frames = [f.select(F.lit(kind).alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")) for kind, f in rules.items()]
    return reduce(DataFrame.unionByName, frames).distinct().join(open_rows.select("kind", "a", "b"), ["kind", "a", "b"], "left_anti")


#: What a resolution asks for, as (side, change).
RESOLUTIONS = {
    "expire_a": [("a", "expire")], "expire_b": [("b", "expire")], "expire_both": [("a", "expire"), ("b", "expire")],
    "invalidate_a": [("a", "invalidate")], "invalidate_b": [("b", "invalidate")],
    "expire_edge_a": [("a", "expire_edge")], "expire_edge_b": [("b", "expire_edge")], "expire_both_edges": [("a", "expire_edge"), ("b", "expire_edge")],
    "reconcile": [], "both_valid": [], "dismissed": [],
}


def resolve_contradictions(rows: DataFrame, decisions: DataFrame, least_reason: int = 20) -> tuple[DataFrame, DataFrame]:
    """(outcomes, requests) of decisions (contradiction_id, resolution, reason, tag, at) on (contradiction_id, fact_a, fact_b, resolved_at).

    The first decision of a row counts. It is rejected when the resolution is unknown, the reason is short, a dismissal
    has no tag, or the row is closed; else it closes the row and asks for changes (target, change).
    """
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.struct(F.lit(s).alias("side"), F.lit(c).alias("change")) for s, c in x]) if x else F.array().cast("array<struct<side:string,change:string>>") for kv in RESOLUTIONS.items() for x in kv])
    one = decisions.groupBy("contradiction_id").agg(F.min_by(F.struct("resolution", "reason", "tag"), F.struct("at", "resolution")).alias("d"))
    met = rows.select("contradiction_id", "fact_a", "fact_b", "resolved_at").join(one, "contradiction_id").select("*", "d.*")
    outcome = (
        F.when(F.element_at(table, F.col("resolution")).isNull(), "unknown_resolution")
        .when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < least_reason, "short_reason")
        .when((F.col("resolution") == "dismissed") & (F.trim(F.coalesce("tag", F.lit(""))) == ""), "no_tag")
        .when(F.col("resolved_at").isNotNull(), "already_resolved")
        .otherwise("resolved")
    )
    met = met.withColumn("outcome", outcome)
    asked = met.filter("outcome = 'resolved'").select("contradiction_id", "fact_a", "fact_b", F.explode(F.element_at(table, F.col("resolution"))).alias("q"))
    return met.select("contradiction_id", "resolution", "outcome"), asked.select("contradiction_id", F.when(F.col("q.side") == "a", F.col("fact_a")).otherwise(F.col("fact_b")).alias("target"), F.col("q.change").alias("change"))


def record_contradictions(held: DataFrame, found: DataFrame) -> DataFrame:
    """(found_id, contradiction_id, is_new) of found (found_id, kind, a, b): the open row of the same pair, or itself."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    known = held.filter("resolved_at is null").select("kind", *pair, "contradiction_id").groupBy("kind", "a", "b").agg(F.min("contradiction_id").alias("_open"))
    mine = found.select("found_id", "kind", *pair)
    first = mine.groupBy("kind", "a", "b").agg(F.min("found_id").alias("_first"))
    met = mine.join(first, ["kind", "a", "b"]).join(known, ["kind", "a", "b"], "left")
    return met.select("found_id", F.coalesce("_open", "_first").alias("contradiction_id"), (F.col("_open").isNull() & (F.col("found_id") == F.col("_first"))).alias("is_new"))
