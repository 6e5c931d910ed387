"""Operator 6: exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is the set of its word shingles. Sizes fall into bands so narrow that partners lie in the same band or the
next. For each band the universe of shingles is hashed into groups; two sets that differ in at most H shingles spend H
differences on the groups, so with enough groups one of them carries at most the difference that its signatures
forgive. Three kinds of group are weighed by cost for each band from the counts of all documents:

* exact: the whole group must agree (H + 1 groups, one signature each);
* segment subsets: one difference is forgiven by leaving out one of q segments (half as many groups, q signatures);
* one-deletion neighbourhood: one difference is forgiven by leaving out any one shingle.

Each band has some groups more than the pigeonholes need, so that a linked pair agrees in several. A set may then leave
out as many of its signatures as make up for: first those without content, then those that most sets share, such as
the ones of a passage that stands in many documents.

Equal sets are collapsed to classes first. Documents that share a signature are candidates. A parity bitmap, whose
distance never exceeds the sets' difference, drops most false ones, and the rest are verified on whole sets. Star
rounds compare the members of a signature with one pivot, at first any, then the one with the most links. The last
round takes all sets that still share a signature with another component and compares those that the prefix filter lets
meet, so components are those of all links, and a group of near copies does not make all its pairs: shingles are put in
order from the rarest on, and a linked pair shares one within so few of the first that a set with more differences of
its own meets nobody.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.textbytes import mix, text_chunks, words
from chronoweave.operators.components import connected_components
from chronoweave.plans.stash import drop_stash, stash

#: Most ids that are broadcast as a filter (16 MB); beyond it the filter is a shuffle join.
BROADCAST_IDS = 2_000_000
PARITY_WORDS = 8
#: Sizes in one class of the prefix filter differ by at most a part in so many.
SIZE_CLASS = 32
#: Groups, as a share of those that the pigeonholes need, whose shared signatures each set may leave out.
HOT_SHARE = 0.04
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, each text's sorted; bounds). Fewer than n words are one shingle."""
    _, _, bounds, hashes, _ = words(data, offsets)
    count = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(n):
        rolled *= _STEP
        rolled[: max(len(hashes) - j, 0)] += hashes[j:]
    text = np.repeat(np.arange(len(count)), count)
    keep = np.arange(len(hashes)) + n <= bounds[1:][text]
    for d in np.flatnonzero((count > 0) & (count < n)):
        a, b = bounds[d], bounds[d + 1]
        whole = int(b - a)
        for h in hashes[a:b].tolist():
            whole = (whole * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF
        rolled[a], keep[a] = np.uint64(whole), True
    shingles, text = mix(rolled[keep]), text[keep]
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    shingles, text = shingles[first], text[first]
    return shingles, np.searchsorted(text, np.arange(len(count) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def profile(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints and the parity bitmap of each set."""
    f1 = _sums(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    f2 = _sums(mix(shingles ^ np.uint64(0x14057B7EF767814F)), bounds)
    texts = len(bounds) - 1
    bit = (shingles >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    odd = np.bincount(text * 64 * PARITY_WORDS + bit, minlength=texts * 64 * PARITY_WORDS) & 1
    parity = np.packbits(odd.astype(np.uint8).reshape(texts, -1), axis=1).view(np.int64).reshape(texts, PARITY_WORDS)
    return f1.view(np.int64), f2.view(np.int64), parity


def band_edges(most: int, num: int, den: int) -> list[int]:
    """Lower edges of the bands: a partner of a set lies in the set's band, the one below or the one above."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * den // num + 1)
    return edges + [edges[-1] * den // num + 1]


def allocate(edges: list[int], counts: dict[int, int], num: int, den: int) -> list[tuple[int, int, int, int]]:
    """For each band the cheapest (groups, segments, spare, hot): 1 segment exact, 0 one-deletion, 3 or 4 subsets.

    The cost is the rows of signatures plus the pairs expected to agree by chance, from the counts of all documents.
    Two unlike sets agree mostly where both have nothing, or the same passage. Each set may therefore leave out
    signatures without content in up to ``spare`` groups and ``hot`` signatures that many sets share. Twice as many
    groups more than the pigeonholes need make up for those of a pair.
    """
    plans = []
    for band in range(len(edges) - 1):
        top, low = edges[band + 1] - 1, edges[band]
        most = (den - num) * (top + top * den // num) // (den + num)  # differences of a linked pair
        docs = counts.get(band, 0) + counts.get(band + 1, 0)
        if most == 0 or docs < 2 or not counts.get(band):
            plans.append((0, 0, 0, 0))
            continue
        tries = []
        for segments in (1, 3, 4, 0):
            least = most + 1 if segments == 1 else (most + 2) // 2
            hot = int(HOT_SHARE * least)
            least += 2 * hot
            groups, spare = least, 0
            for _ in range(4):  # the spare groups thin the others out a little
                load = low / groups
                told = load if segments == 1 else max(load - 1, 0.1) if segments == 0 else load * (segments - 1) / segments
                bare = min(1.0, max(segments, 1) * math.exp(-told))
                spare = math.ceil(1.3 * groups * bare + 2) if groups * bare < 0.15 * groups else 0
                groups = least + 2 * spare
            rows = groups + low if segments == 0 else groups * segments
            chance = docs * math.exp(-told) * (0.05 if spare else 1.0)
            tries.append((rows * docs + rows * chance * chance / 2, groups, segments, spare, hot))
        plans.append(min(tries)[1:])
    return plans


def signatures(shingles: np.ndarray, bounds: np.ndarray, scheme: np.ndarray, plans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, bounds) of each set under its scheme, a row of ``plans``; scheme -1 gives none."""
    texts = len(bounds) - 1
    groups = np.where(scheme >= 0, plans[scheme, 0], 0)
    segments = np.where(scheme >= 0, plans[scheme, 1], 0)
    size = np.diff(bounds)
    text = np.repeat(np.arange(texts), size)
    use = groups[text] > 0
    text, mine = text[use], shingles[use]
    value = mix(mine ^ np.uint64(0xD6E8FEB86659FD93))
    spread = (mine >> np.uint64(8)).astype(np.int64)
    group = spread % np.maximum(groups[text], 1)
    cells = np.maximum(segments, 1)
    cell = (value >> np.uint64(33)).astype(np.int64) % cells[text]
    base = np.concatenate([[0], np.cumsum(groups * cells)])
    slot = base[text] + group * cells[text] + cell
    order = np.argsort(slot, kind="stable")
    slot, value = slot[order], value[order]
    cell_bounds = np.searchsorted(slot, np.arange(base[-1] + 1))
    sums = _sums(value, cell_bounds)  # of each cell
    held = np.diff(cell_bounds)
    owner = np.repeat(np.arange(texts), groups * cells)
    inside = np.arange(base[-1]) - base[owner]
    name = mix((scheme[owner].astype(np.uint64) << np.uint64(40)) + inside.astype(np.uint64))
    first = np.arange(base[-1]) - inside % cells[owner]
    whole = np.zeros(base[-1], np.uint64)
    np.add.at(whole, first, sums)
    many = np.bincount(first, held, minlength=base[-1]).astype(np.int64)
    parts = []  # (text, group, content, signature)
    for mask, content, told in (
        (segments[owner] == 1, sums, held),
        (segments[owner] > 1, whole[first] - sums, many[first] - held),
        (segments[owner] == 0, sums, held),
    ):
        parts.append((owner[mask], first[mask], told[mask], mix(content[mask] + name[mask])))
    each = segments[text[order]] == 0
    parts.append((text[order][each], slot[each], held[slot[each]] - 1, mix(sums[slot[each]] - value[each] + name[slot[each]])))
    out_text, group, told, out = (np.concatenate(x) for x in zip(*parts))
    # signatures without content, in the first ``spare`` groups of the text that have one, are left out
    bare = np.flatnonzero(told == 0)
    found, which = np.unique(group[bare], return_inverse=True)
    whose = owner[found] if len(found) else found
    rank = np.arange(len(found)) - np.searchsorted(whose, whose)
    spare = np.where(scheme >= 0, plans[scheme, 2], 0)
    keep = np.ones(len(out), bool)
    keep[bare[rank[which] < spare[out_text[bare]]]] = False
    out_text, out = out_text[keep], out[keep]
    order = np.argsort(out_text, kind="stable")
    return out[order].view(np.int64), np.searchsorted(out_text[order], np.arange(texts + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _map_sets(docs: DataFrame, n: int, schema: str, make) -> DataFrame:
    """Run ``make(ids, shingles, bounds) -> arrays`` over the sets of (doc_id, text)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(make(batch.column(0).slice(a, b - a), *shingle_sets(data, offsets, n)), names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id; ``ids`` (stashed) is broadcast while it is known to be small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _described(frame: DataFrame, described: DataFrame, col: str, letter: str) -> DataFrame:
    """Add the size and the parity bitmap of the set in column ``col`` as ``n{letter}`` and ``{letter}p*``."""
    bits = [F.col(f"p{i}").alias(f"{letter}p{i}") for i in range(PARITY_WORDS)]
    return frame.join(described.select(F.col("cid").alias(col), F.col("n").alias(f"n{letter}"), *bits), col)


def _few_differences(num: int, den: int) -> Column:
    """Whether the pair's sizes and parity bitmaps allow a link."""
    distance = sum((F.bit_count(F.col(f"ap{i}").bitwiseXOR(F.col(f"bp{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (distance * (num + den) <= (F.col("na") + F.col("nb")) * (den - num))


def verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The linked ones of the stashed candidate pairs (a, b), by the intersection of whole sets; stashed."""
    ids = stash(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = stash(_map_sets(_only(docs, ids, "left_semi"), n, "id long, shingles array<long>", lambda i, s, b: [i, _lists(s.view(np.int64), b)]))
    # joins that Spark may split where one document has many candidates
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    linked = stash(both.filter(inter * (num + den) >= num * (F.size("sa") + F.size("sb"))).select("a", "b"))
    drop_stash(ids)
    drop_stash(sets)
    return linked


def shared_signatures(signed: DataFrame, sizes: DataFrame, edges: list[int], plans: list[tuple[int, int, int, int]]) -> DataFrame:
    """(sig, cid, low) of the signatures that several sets share, less the ``hot`` most shared ones of each set.

    ``signed`` has (cid, keys): a key's lowest bit tells the set's own band from the one below, the rest is the
    signature. ``sizes`` has (cid, n).
    """
    rows = signed.select("cid", F.explode("keys").alias("key"))
    rows = rows.select("cid", F.col("key").bitwiseAND(F.lit(-2)).alias("sig"), (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("low"))
    shared = Window.partitionBy("sig")
    rows = rows.withColumn("m", F.count("*").over(shared)).withColumn("lows", F.max("low").over(shared)).filter("m > 1 and lows")
    band = F.array_position(F.transform(F.lit(edges), lambda e: e > F.col("n")), True) - 2
    hot = F.array(*[F.lit(p[3]) for p in plans])
    band = F.when(F.col("low"), band).otherwise(band - 1)
    most = F.when(band < 0, 0).otherwise(F.get(hot, band.cast("int")))
    rank = F.row_number().over(Window.partitionBy("cid", "low").orderBy(F.col("m").desc(), "sig"))
    rows = rows.join(sizes, "cid").withColumn("r", F.when(F.col("m") > 2, rank).otherwise(1 << 30))
    return rows.filter(F.col("r") > F.coalesce(most, F.lit(0))).select("sig", "cid", "low")


def size_classes(most: int) -> list[int]:
    """Lower edges of the prefix filter's classes of set sizes."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] + max(1, edges[-1] // SIZE_CLASS))
    return edges


def prefix_pairs(comp: DataFrame, docs: DataFrame, n: int, num: int, den: int, most: int) -> DataFrame:
    """Pairs (a, b), a < b, of the sets of stashed (cid, comp) in different components that may be linked.

    Shingles are ordered by the number of these sets that hold them, rarest first. If two sets of sizes x and y share s
    shingles, the first shared one has at least s - 1 others behind it in both: it is among the first x - s + 1 of the
    one and y - s + 1 of the other. Rows meet by shingle and by the classes of both sizes, which bound s from below; in
    each meeting the members of the largest component are not compared with each other.
    """
    edge = np.array(size_classes(most * den // num + 1))

    def describe(ids, shingles, bounds):
        size = np.diff(bounds)
        return [ids, pa.array(size), pa.array(np.searchsorted(edge, size, side="right") - 1), _lists(shingles.view(np.int64), bounds)]

    sets = _map_sets(_only(docs, comp.select(F.col("cid").alias("doc_id")), "left_semi"), n, "cid long, n long, k long, shingles array<long>", describe)
    rows = sets.filter("n > 0").withColumn("rid", F.xxhash64("shingles")).dropDuplicates(["cid", "rid"]).select("cid", "rid", "n", "k", F.explode("shingles").alias("s"))
    rows = rows.withColumn("held", F.count("*").over(Window.partitionBy("s")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("cid", "rid").orderBy("held", "s"))).filter("held > 1")
    smallest = F.ceil(F.col("n") * num / den)  # of a partner
    within = lambda size: F.col("pos") <= F.col("n") - F.ceil((F.col("n") + F.greatest(size, smallest)) * num / (num + den)) + 1
    rows = rows.filter(within(smallest))
    # the classes of partners, with the least and greatest size in each
    classes = F.array(*[F.struct(*[F.lit(int(x)).cast("long").alias(c) for c, x in (("c", i), ("low", edge[i]), ("top", edge[i + 1] - 1))]) for i in range(len(edge) - 1)])
    reach = int((np.searchsorted(edge, edge * den // num + 1, side="right") - np.arange(len(edge))).max())
    near = F.explode(F.slice(classes, F.greatest(F.col("k") - reach, F.lit(0)).cast("int") + 1, 2 * reach + 1)).alias("p")
    told = rows.select("cid", "n", "k", "s", "pos", near).filter((F.col("p.low") * num <= F.col("n") * den) & (F.col("p.top") >= smallest) & within(F.col("p.low")))
    told = told.select("cid", "n", "k", "pos", "s", F.least("k", "p.c").alias("k1"), F.greatest("k", "p.c").alias("k2"))
    weight = comp.groupBy("comp").agg(F.count("*").alias("held"))
    keys = ["s", "k1", "k2"]
    met = Window.partitionBy(*keys)
    told = told.join(comp.join(weight, "comp"), "cid").withColumns({"home": F.max(F.struct("held", "comp")).over(met)["comp"], "least": F.min("comp").over(met), "greatest": F.max("comp").over(met)})
    told = stash(told.filter("least <> greatest").select(*keys, "cid", "n", "k", "pos", "comp", "home"))
    mine = told.filter("comp <> home").select(*keys, F.col("cid").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    theirs = told.select(*keys, F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    shared = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    fits = (F.col("ca") != F.col("cb")) & ((F.col("k1") == F.col("k2")) | (F.col("ka") != F.col("kb"))) & (shared * (num + den) >= (F.col("na") + F.col("nb")) * num)
    pairs = stash(mine.join(theirs, keys).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_stash(told)
    return pairs


def jaccard_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, star_rounds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of the links ``den * |A & B| >= num * |A | B|`` between the documents' sets of n-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles are told apart by 64-bit hashes. A text
    of fewer words is one shingle; a null, empty or blank text has none and is linked with nothing.
    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included).
    Repeated rows keep their rows; rows of one doc_id with different texts count as one node. A null doc_id is linked
    with nothing and has a null component. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def describe(ids, shingles, bounds):
        f1, f2, parity = profile(shingles, bounds)
        return [ids, pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2), *(pa.array(parity[:, i]) for i in range(PARITY_WORDS))]

    words_of = [f"p{i}" for i in range(PARITY_WORDS)]
    sets = stash(_map_sets(docs, n, "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{p} long" for p in words_of), describe))
    known = sets.filter("n > 0 and doc_id is not null")
    classes = stash(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("cid")))
    members = sets.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left")
    members = members.withColumn("cid", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("cid", "doc_id")))
    members = stash(members.select("doc_id", "n", "cid"))

    most = classes.agg(F.max("n")).first()[0]
    if most is None:
        return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("component_id"))
    edges = band_edges(most, num, den)
    # the count of each band: as many rows as the logarithm of the longest text
    bands = classes.groupBy(F.array_position(F.transform(F.lit(edges), lambda e: e > F.col("n")), True).alias("k")).count().collect()
    plans = allocate(edges, {r["k"] - 2: r["count"] for r in bands}, num, den)
    edge, plan = np.array(edges), np.array(plans + [(0, 0, 0, 0)])

    def sign(ids, shingles, bounds):
        size = np.diff(bounds)
        band = np.where(size > 0, np.searchsorted(edge, size, side="right") - 1, -1)
        own, own_bounds = signatures(shingles, bounds, band, plan)
        below, below_bounds = signatures(shingles, bounds, np.maximum(band - 1, -1), plan)
        keys = np.concatenate([own | 1, below & ~1])
        text = np.concatenate([np.repeat(np.arange(len(size)), np.diff(b)) for b in (own_bounds, below_bounds)])
        return [ids, _lists(keys[np.argsort(text, kind="stable")], own_bounds + below_bounds)]

    copies = stash(members.filter("doc_id <> cid").select("doc_id").distinct())
    signed = _map_sets(_only(docs.filter("doc_id is not null"), copies, "left_anti"), n, "cid long, keys array<long>", sign)
    # one row a node: of rows that share an id the largest set's
    sizes = classes.groupBy("cid").agg(F.max("n").alias("n"))
    rows = stash(shared_signatures(signed, sizes, edges, plans))
    described = stash(sets.filter("doc_id is not null").groupBy(F.col("doc_id").alias("cid")).agg(F.max(F.struct("n", *words_of)).alias("s")).select("cid", "s.*").join(rows.select("cid").distinct(), "cid", "left_semi"))
    for held in (sets, classes, copies):
        drop_stash(held)

    close = _few_differences(num, den)
    links, tried = [], None
    comp = described.withColumns({"comp": F.col("cid"), "degree": F.lit(0)})
    for turn in range(star_rounds + 1):
        last = turn == star_rounds
        now = rows.join(comp, "cid")
        first = F.struct(-F.col("degree"), F.xxhash64(F.lit(turn), "cid"), "cid", "comp", "n", *words_of)
        told = [F.min("comp").alias("least"), F.max("comp").alias("greatest"), F.count("*").alias("m"), F.min(F.when(F.col("low"), first)).alias("p")]
        # signatures whose members are all in one component are done
        groups = now.groupBy("sig").agg(*told).filter("least <> greatest")
        if not last:
            # most that share a signature by chance differ too much from its pivot: told here, before they make pairs
            facts = [F.col(f"p.{p}").alias(f"a{p}") for p in words_of]
            groups = groups.filter("p is not null").select("sig", "m", F.col("p.cid").alias("pivot"), F.col("p.comp").alias("home"), F.col("p.n").alias("na"), *facts)
            mine = now.select("sig", "cid", "low", "comp", F.col("n").alias("nb"), *[F.col(p).alias(f"b{p}") for p in words_of]).join(groups, "sig")
            mine = stash(mine.select("sig", "cid", "low", "m", "pivot", ((F.col("comp") != F.col("home")) & close).alias("near")))
            drop_stash(rows)
            rows = mine.filter("m > 2").select("sig", "cid", "low")  # a pair alone is done with its pivot
            rows._stash_path = mine._stash_path
            pairs = mine.filter("near").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).distinct()
        else:
            apart = stash(now.join(groups.select("sig"), "sig", "left_semi").select("cid", "comp").distinct())
            pairs = prefix_pairs(apart, docs.filter("doc_id is not null"), n, num, den, most)
            drop_stash(apart)
            pairs = _described(_described(pairs, described, "a", "a"), described, "b", "b").filter(close).select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash(pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        links.append(verify(pairs, docs, n, num, den))
        if links[-1].isEmpty():
            continue
        linked = links[0]
        for more in links[1:]:
            linked = linked.union(more)
        found = connected_components(linked, "a", "b")
        ends = linked.select(F.col("a").alias("cid")).union(linked.select("b")).groupBy("cid").agg(F.count("*").cast("int").alias("degree"))
        told = described.join(found.withColumnRenamed("node", "cid"), "cid", "left").join(ends, "cid", "left")
        comp = stash(told.select("cid", F.coalesce("component", "cid").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree"), "n", *words_of))
    out = stash(members.join(comp.select("cid", "comp"), "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "cid").alias("component_id")))
    for held in (rows, described, members, *links):
        drop_stash(held)
    return out
