"""Operator 6: what its last round compares."""

import itertools
import random

from chronoweave.llm import jaccard_join


def test_near_copies_do_not_meet_those_that_are_not_linked(spark, monkeypatch):
    """Sixty copies of a text, linked with each other, and forty that differ too much from them: few pairs are compared."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]

    def edited(row, changes):
        text = list(base)
        for i in range(changes):
            text[i * len(base) // changes + rng.randrange(len(base) // changes)] = f"x{row}.{i}"
        return " ".join(text)

    docs = [(i, edited(i, 2)) for i in range(60)] + [(100 + i, edited(100 + i, 9)) for i in range(40)]
    docs += [(100, docs[60][1]), (200, edited(200, 5)), (201, "w1 w2 w3")]
    sets = {}
    for i, text in docs:
        words = text.split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    seen = []
    verify = jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *rest: (seen.append(pairs.count()), verify(pairs, *rest))[1])
    found = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), star_rounds=1)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == sorted((i, root[i]) for i, _ in docs)
    assert sum(root[i] == i for i in root) > 20  # most of the forty stand alone
    assert sum(seen[1:]) < 300, seen


def test_sets_that_share_a_signature_by_chance_make_no_pairs(spark, monkeypatch):
    """Forms of one letter that differ in a quarter of their words, and a few copies: few rows are looked up as pairs."""
    rng = random.Random(3)
    letter = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(250):
        text = list(letter)
        for j in range(6):
            text[j * 10 + rng.randrange(10)] = f"x{i}.{j}"
        docs.append((i, " ".join(text)))
    docs += [(1000 + i, docs[i][1] + " end") for i in range(5)]
    seen = []
    described = jaccard_join._described
    monkeypatch.setattr(jaccard_join, "_described", lambda frame, *rest: (seen.append(frame.count()), described(frame, *rest))[1])
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert found == root and len(set(root.values())) < 255
    assert sum(seen) < 400, seen
