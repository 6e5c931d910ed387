"""The interval join against brute force, and on one key of many rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import causal as C
from chronoweave.operators import temporal as BT
from chronoweave.operators.intervals import overlapping

SIDE = "k string, id long, from long, to long, lo long, n int"


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)

    def side(n):
        out = []
        for i in range(n):
            begin = rng.randint(0, 60)
            out.append((rng.choice(["a", "a", "a", "b", None]), i if i else None, begin, begin + rng.randint(-3, 25), 0, 0))
        return out

    a, b = side(90), side(70)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] is not None and y[1] is not None and x[2] < y[3] and x[3] > y[2])
    got = overlapping(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE), ["k"])
    assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], SIDE)
    assert overlapping(none, none, ["k"]).collect() == []


def test_one_subject_of_many_facts(spark):
    """100,000 facts of one subject, each overlapped by two requests at most: the answer is small, and so is the work."""
    n = 100_000
    shape = dict(subject_id=F.lit("s"), predicate=F.lit("p"), object_id=F.lit(None).cast("string"), object_value=F.col("id").cast("string"), created_at=F.timestamp_seconds("id"), expired_at=F.lit(None).cast("timestamp"), confidence=F.lit(1.0))
    old = spark.range(n).withColumns(shape | dict(fact_id=F.concat(F.lit("f"), "id"), valid_at=F.timestamp_seconds(F.col("id") * 10), invalid_at=F.timestamp_seconds(F.col("id") * 10 + 10)))
    new = spark.range(0, n, 5).withColumns(shape | dict(fact_id=F.concat(F.lit("n"), "id"), valid_at=F.timestamp_seconds(F.col("id") * 10 + 5), invalid_at=F.timestamp_seconds(F.col("id") * 10 + 15)))
    found = BT.superseded_by(old, new)
    assert found.count() == 2 * (n // 5)
    assert found.filter("cast(substring(fact_id, 2) as int) - cast(substring(new_id, 2) as int) not between 0 and 1").count() == 0


def test_pair_rules(spark):
    rows = [
        ("is", "Budget: 5", "is", "budget is 6", True, "contradiction"),
        ("is", "Budget: 5", "is", "size: 6", True, "needs_review"),
        ("is", "Budget: 5", "is", "budget: 6", False, "contradiction"),
        ("is", "Budget = 5", "is", "budget-5", True, "needs_review"),
        ("active", "x", "inactive", "y", True, "contradiction"),
        ("active", "x", "inactive", "y", False, "needs_review"),
        ("Owns", "a", "owns", "b", True, "compatible"),
        ("lives in", "a", "lives_in", "b", True, "contradiction"),
        ("lives-in", "a", "lives_in", "b", False, "succession"),
        ("says", "A  b", "says", "a b", False, "same"),
    ]
    df = spark.createDataFrame(rows, "pa string, oa string, pb string, ob string, overlaps boolean, want string")
    for r in df.withColumn("got", C.classify_pair(["owns"], ["lives_in"])).collect():
        assert r.got == r.want, r


def test_merges_in_chains(spark):
    from chronoweave.operators.resolution import closed_mapping

    rows = [(str(i), str(i + 1)) for i in range(40)] + [("x", "5"), ("y", "y"), ("5", "6")]
    got = {r.source: r.survivor for r in closed_mapping(spark.createDataFrame(rows, "source string, survivor string")).collect()}
    assert got == {str(i): "40" for i in range(40)} | {"x": "40"}
    with pytest.raises(ValueError, match="ring"):
        closed_mapping(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, survivor string"))
