"""Scalar functions with known answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name", ["abc", "memory:3", "ü", ""])
def test_uuid5(spark, name):
    space = uuid.NAMESPACE_URL
    assert value(spark, S.uuid5(space.hex, F.lit(name))) == str(uuid.uuid5(space, name))


@pytest.mark.parametrize("text, want", [("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400), ("x", None), ("5 m", None)])
def test_interval(spark, text, want):
    assert value(spark, S.interval_seconds(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("5m", "*/5 * * * *"), ("2h", "0 */2 * * *"), ("1d", "0 0 */1 * *"), ("90s", None)])
def test_cron(spark, text, want):
    assert value(spark, S.cron(F.lit(text))) == want


@pytest.mark.parametrize("verb, want", [("was", "be"), ("carries", "carry"), ("carried", "carry"), ("watches", "watch"), ("stopped", "stop"), ("created", "create"), ("works", "work"), ("worked", "work"), ("sing", "sing"), ("pass", "pass")])
def test_lemma(spark, verb, want):
    assert value(spark, S.lemma(F.lit(verb))) == want


@pytest.mark.parametrize("text, want", [("Do it tomorrow", "2024-05-16 09:00:00"), ("call tonight", "2024-05-15 17:00:00"), ("by Friday please", "2024-05-17 09:00:00"), ("in 3 days", "2024-05-18 10:30:00"), ("in 2 hours", "2024-05-15 12:30:00"), ("on 2024-06-01", "2024-06-01 09:00:00"), ("some day", None)])
def test_due(spark, text, want):
    now = F.lit("2024-05-15 10:30:00").cast("timestamp")
    found = value(spark, S.due_at(S.due_phrase(F.lit(text)), now))
    assert (None if found is None else str(found)) == want


def test_small_ones(spark):
    assert value(spark, S.priority(F.lit("ASAP"))) == "high" and value(spark, S.priority(F.lit("?"))) == "medium"
    assert value(spark, S.predicate_name(F.lit(" Works  at"))) == "works_at"
    assert value(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert value(spark, S.sanitise(F.lit("a\r\nb\x01\n\n\n\nc"))) == "a\nb\n\nc"
    assert value(spark, S.assistant_turn(F.lit("x\n  AI: hi"))) is True
    assert "middle" in value(spark, S.mention_context(F.lit("a" * 300 + " middle " + "b" * 300), F.lit("middle")))
    assert value(spark, F.size(S.trigrams(F.lit("cat")))) == 4
