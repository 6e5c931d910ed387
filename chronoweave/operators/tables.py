"""Table changes as transforms: upserts, patches, inserts of what is absent, side indexes, and reads in pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys, in key order."""
    return table.join(keys.select(key).distinct(), key, "left_semi").orderBy(key)


def latest(versions: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order: an upsert is a union and then this."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Overwrite columns with the non-null values of ``changes``, at most one row a key."""
    columns = [c for c in changes.columns if c != key]
    met = table.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def insert_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose keys it lacks, one of each key."""
    return table.unionByName(new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def upsert_counts(table: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """Add counts by key and tell whether the key was there."""
    told = new.groupBy(key).agg(F.sum(count).alias("_n"))
    both = table.join(told, key, "full_outer")
    flag = F.when(F.col(count).isNull(), "inserted").when(F.col("_n").isNull(), "kept").otherwise("refreshed")
    return both.select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(count), flag.alias("outcome"))


def history_gaps(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """'created' events for rows whose history lacks one."""
    return rows.join(history.filter("event_type = 'created'").select(key), key, "left_anti").select(key, F.lit("created").alias("event_type"))


def checked_history(history: DataFrame) -> DataFrame:
    """History rows that may be appended: those with a reason."""
    return history.filter(F.length(F.trim("reasoning")) > 0)


REFS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())]))


def explode_refs(edges: DataFrame, key: str, refs: str, kinds: Sequence[str]) -> DataFrame:
    """(key, ref_type, ref_id) of a JSON array column, which may be a string that holds JSON once more; no repeats."""
    text = F.col(refs)
    plain = F.when(text.startswith('"'), F.from_json(F.concat(F.lit('{"s":'), text, F.lit("}")), "s string")["s"]).otherwise(text)
    rows = edges.select(key, F.explode(F.from_json(plain, REFS)).alias("r"))
    return rows.select(key, F.col("r.type").alias("ref_type"), F.col("r.id").alias("ref_id")).filter(F.col("ref_type").isin(*kinds)).distinct()


def unified_export(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((kind, id), (kind, src, dst)) of all kinds of nodes (id) and edges (src, dst); an edge without both ends is dropped."""
    all_nodes = reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id")) for k, f in nodes.items()]).distinct()
    all_edges = reduce(DataFrame.unionByName, [f.select(F.lit(k).alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")) for k, f in edges.items()])
    ids = all_nodes.select("id").distinct()
    return all_nodes, all_edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def input_order(rows: DataFrame, out: str) -> DataFrame:
    """Add ``out``, from 1: the place of a row in the order of its files; only the counts of partitions are gathered."""
    held = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    counts = held.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_lo"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))  # a row a partition
    return held.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.col("_i") - F.col("_lo") + 1).drop("_p", "_i", "_n", "_lo", "_before")


def missing_refs(edges: DataFrame, index: DataFrame, key: str, refs: str, kinds: Sequence[str]) -> DataFrame:
    """(key, ref_type, ref_id) of references in the JSON column that the side index lacks."""
    found = explode_refs(edges, key, refs, kinds).filter("ref_id is not null")
    return found.join(index.select(key, "ref_type", "ref_id"), [key, "ref_type", "ref_id"], "left_anti")


def report_counts(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same_as, merges, facts, summaries, islands): bullets under the third-level headings of a report."""
    lines = reports.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("_i", "_l"))
    name = F.when(F.col("_l").rlike(r"^###\s+.+"), F.lower(F.trim(F.regexp_extract("_l", r"^###\s+(.+?)\s*$", 1))))
    under = F.last(name, ignorenulls=True).over(Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    bullet = F.col("_l").rlike(r"^\s*[-*]\s+\S")
    held = lines.withColumn("_s", under)
    n = lambda c: F.count(F.when(bullet & c, 1))
    merged, same = F.col("_l").rlike(r"(?i)\bmerged\s+into\b"), F.col("_l").rlike(r"(?i)\bSAME_AS\b")
    at = lambda s: F.coalesce(F.col("_s") == s, F.lit(False))
    return held.groupBy(key).agg(n(at("consolidations") & same).alias("same_as"), n(at("consolidations") & ~same & merged).alias("merges"), n(at("facts created")).alias("facts"), n(at("summaries updated")).alias("summaries"), n(at("islands investigated")).alias("islands"))


def stats_anomaly(rows: DataFrame, order: str) -> DataFrame:
    """Add ``tag`` and ``signals`` to stats rows (orphan_rate, clusters, predicates): what moved against the row before.

    The orphan rate by more than 0.3, a number of clusters or predicates by more than half. The first row is normal.
    """
    w = Window.orderBy(order)  # one row a snapshot
    before = lambda c: F.lag(c).over(w)
    moved = [F.when(F.abs(F.col("orphan_rate") - before("orphan_rate")) > 0.3, "orphan_rate")]
    moved += [F.when((before(c) > 0) & (F.abs(F.col(c) - before(c)) > 0.5 * before(c)), c) for c in ("clusters", "predicates")]
    met = rows.withColumn("signals", F.filter(F.array(*moved), lambda x: x.isNotNull()))
    return met.withColumn("tag", F.when(F.size("signals") > 0, "anomaly").otherwise("normal"))


def profile_texts(entities: DataFrame, aliases: DataFrame, facts: DataFrame, near: DataFrame, memories: DataFrame, categories: dict[str, str], limit: int = 4000) -> DataFrame:
    """(entity_id, profile): name, type, aliases, facts by category, neighbours and newest memories as one text.

    ``facts`` (entity_id, predicate, value, fact_id), ``near`` (entity_id, name, entity_type), ``memories`` (entity_id,
    memory_id, content). At most 5 facts a category, 8 neighbours and 3 memories of 80 characters are shown: each list
    is cut by rank before it is gathered.
    """

    def top(rows: DataFrame, keys: list[str], order: list[Column], most: int, text: Column, out: str, glue: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        few = rows.withColumn("_r", r).filter(F.col("_r") <= most)
        parts = F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"])
        return few.groupBy(*keys).agg(F.array_join(parts, glue).alias(out))

    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    f = facts.withColumn("category", F.coalesce(F.element_at(table, F.col("predicate")), F.lit("Other")))
    counts = f.groupBy("entity_id", "category").agg(F.count("*").alias("n"))
    lines = top(f, ["entity_id", "category"], [F.col("fact_id")], 5, F.concat(F.lit("\u2022 "), "predicate", F.lit(": "), F.coalesce("value", F.lit("?"))), "lines", "\n").join(counts, ["entity_id", "category"])
    block = F.concat(F.lit("\n**"), "category", F.lit(":**\n"), "lines", F.when(F.col("n") > 5, F.concat(F.lit("\n  _...and "), (F.col("n") - 5).cast("string"), F.lit(" more_"))).otherwise(""))
    shown = top(lines.withColumn("block", block), ["entity_id"], [F.col("category")], len(set(categories.values())) + 1, F.col("block"), "facts", "\n")
    # more aliases than characters cannot be shown
    names = top(aliases, ["entity_id"], [F.col("alias")], limit, F.col("alias"), "aka", ", ")
    others = top(near, ["entity_id"], [F.col("name"), F.col("entity_type")], 8, F.concat("name", F.lit(" ("), "entity_type", F.lit(")")), "near", ", ")
    said = F.when(F.length("content") > 80, F.concat(F.substring("content", 1, 80), F.lit("..."))).otherwise(F.col("content"))
    recent = top(memories, ["entity_id"], [F.desc("memory_id")], 3, F.concat(F.lit("\u2022 "), said), "recent", "\n")
    met = entities.select("entity_id", "canonical_name", "entity_type")
    for part in (names, shown, others, recent):
        met = met.join(part, "entity_id", "left")
    head = F.concat(F.lit("**"), "canonical_name", F.lit("** ("), "entity_type", F.lit(")"), F.coalesce(F.concat(F.lit("\n_aka: "), "aka", F.lit("_")), F.lit("")))
    text = F.concat_ws("\n", head, "facts", F.concat(F.lit("\n**Connected:** "), "near"), F.concat(F.lit("\n**Recent mentions:**\n"), "recent"))
    return met.select("entity_id", F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 20), F.lit("\n\n_...truncated_"))).otherwise(text).alias("profile"))


def aged_orphans(mentions: DataFrame, facts: DataFrame, now: Column, minutes: int) -> DataFrame:
    """(entity_id, age_minutes) of mentioned entities without facts whose first mention is older than ``minutes``.

    ``mentions`` has (entity_id, at); oldest first.
    """
    ends = facts.select(F.col("subject_id").alias("entity_id")).union(facts.filter("object_id is not null").select("object_id"))
    first = mentions.groupBy("entity_id").agg(F.min("at").alias("at")).join(ends, "entity_id", "left_anti")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("at")) / 60)
    return first.select("entity_id", age.alias("age_minutes")).filter(F.col("age_minutes") > minutes)


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a stated total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def optional_filters(rows: DataFrame, equal: dict[str, object], at: str | None = None, since: str | None = None) -> DataFrame:
    """Rows with the given values; a value or an instant that is None is no filter."""
    for name, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows if at is None or since is None else rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))


def read_question_sets(spark, path: str) -> DataFrame:
    """(question_id, question_type, session, date, turn, role, content, has_answer) from nested benchmark JSON."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("question_id", "question_type", "question", "answer")]
        + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("haystack_session_ids", "haystack_dates")]
        + [T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(turn)))]
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    sessions = raw.select("question_id", "question_type", "question", "answer", F.explode(zipped).alias("s"))
    turns = sessions.select("question_id", "question_type", F.col("s.haystack_session_ids").alias("session"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return turns.select("question_id", "question_type", "session", "date", "turn", "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def read_transcripts(spark, path: str) -> DataFrame:
    """(session, user_text, assistant_text) of the last exchange in each JSONL transcript; broken lines are dropped."""
    schema = "type string, sessionId string, isMeta boolean, uuid string, timestamp string, message struct<role:string,content:string>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.filter("_bad is null and coalesce(isMeta, false) = false and message.content is not null")
    good = good.filter(~F.col("message.content").rlike(r"^\s*(<command|\[\{\"tool)")).select("sessionId", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"))
    last = good.filter("role = 'user'").groupBy("sessionId").agg(F.max(F.struct("timestamp", "content")).alias("u"))
    after = good.filter("role = 'assistant'").join(last, "sessionId").filter("timestamp >= u.timestamp")
    return after.groupBy("sessionId").agg(F.first("u.content").alias("user_text"), F.max_by("content", "timestamp").alias("assistant_text")).withColumnRenamed("sessionId", "session")
