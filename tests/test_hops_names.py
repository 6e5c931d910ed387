import random

from pyspark.sql import functions as F

from chronoweave.operators import graph as G
from chronoweave.operators import resolution as R


def shuffled(spark):
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_hops_against_search(spark):
    rng = random.Random(4)
    arcs = [(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}") for _ in range(22)]
    arcs += [(f"leaf{i}", f"v{i % 3}") for i in range(12)] + [("x", "y"), ("z", "z")]  # leaves, a pair alone, a loop
    names = sorted({v for a in arcs for v in a} | {"lone"})
    near = {v: {b for a, b in arcs + [(b, a) for a, b in arcs] if a == v} - {v} for v in names}
    edges, seeds = spark.createDataFrame(arcs, "src string, dst string"), spark.createDataFrame([(v,) for v in names], "seed string")
    for depth in (1, 2, 3):
        want = set()
        for s in names:
            seen, front = {s}, {s}
            for h in range(1, depth + 1):
                front = {w for v in front for w in near[v]} - seen
                seen |= front
                want |= {(s, v, h) for v in front}
        found = list(map(tuple, G.hops(edges, seeds, depth).select("seed", "v", "hop").collect()))
        assert len(found) == len(set(found)) and set(found) == want


def test_hops_of_a_star_are_not_shuffled_in_pairs(spark):
    """All 2,000 leaves are seeds: 4 million pairs."""
    leaves = spark.range(2000).select(F.concat(F.lit("leaf"), "id").alias("src"), F.lit("hub").alias("dst"))
    before = shuffled(spark)
    found = G.hops(leaves, leaves.select(F.col("src").alias("seed")), 2)
    assert found.count() == 2000 * 2000
    assert shuffled(spark) - before < 5_000_000


def test_names_against_all_pairs(spark):
    rng = random.Random(6)
    names = [f"Customer#{rng.randrange(3000):09d}" for _ in range(150)] + [f"{rng.choice('abc')}{rng.choice('ab')}" for _ in range(20)]
    names += ["the quick brown fox jumps over the lazy dogs of the old town " + str(i) for i in range(8)] + ["", "##", "ab", "abc def"]
    rows = spark.createDataFrame([(f"e{i:03d}", n) for i, n in enumerate(names)], "id string, name string")
    first = {}
    for i, n in enumerate(names):
        first.setdefault(n.lower(), f"e{i:03d}")
    grams = {}
    for n, i in first.items():
        words = "".join(c if c.isalnum() else " " for c in n).split()
        grams[i] = {("  " + w + " ")[j : j + 3] for w in words for j in range(len(w) + 1)}
    for least in (0.3, 0.8):
        want = {(a, b) for a, x in grams.items() for b, y in grams.items() if x and y and len(x & y) >= least * len(x | y)}
        found = [(r["a"], r["b"]) for r in R.similar_names(rows, rows, least).collect()]
        assert len(found) == len(set(found)) and set(found) == want
