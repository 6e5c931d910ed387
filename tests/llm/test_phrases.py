"""Operators 11 to 13 against brute force, on small tables with every awkward case."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import collocations as phrases
from chronoweave.llm import lexical_search as lexical
from chronoweave.llm.collocations import collocations
from chronoweave.llm.lexical_search import lexical_search
from chronoweave.llm.passage_dedup import estimated_repeats, least_within, passage_dedup, rolled

DOCS = "doc_id long, text string, lang string, key long, n long, cls long, w1 string, score double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x", 0.5) for i, t, lang in rows], DOCS)


def texts(seed, n=60, words=40, vocabulary=25):
    rng = random.Random(seed)
    stock = [f"w{i}" for i in range(vocabulary)] + ["É", "Zoë", "X1"]
    return [" ".join(rng.choice(stock[: rng.randint(3, len(stock))]) + rng.choice(["", "", "", ".", "\n", "\t", ","]) for _ in range(rng.randint(0, words))) for _ in range(n)]


# ---- 11


def brute_search(rows, items, k=10):
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, term(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(x for _, b in bags for x in set(b))
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            tf, score = Counter(b), 0
            m = 25 + (75 * len(b) * n_docs) // max(n_terms, 1)
            for x in term(text):
                if tf[x]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("cells", [lexical.CELLS, 64])
def test_search_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rows = [(i, t) for i, t in enumerate(texts(1))]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(i, "w1 w2 same length") for i in (7, 7, 50)]  # copies and repeated ids
    rows += [(200, None), (201, ""), (202, "   ..."), (None, "w1 w2 w3"), (203, "w1 " * 30_000 + "rare")]
    items = [(0, rows[3][1]), (1, "w1 W1 w2, rare"), (2, None), (3, ""), (4, "absent"), (5, "É zoë X1")]
    held = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, term long")
    got = lexical_search(docs_of(spark, [(i, t, None) for i, t in rows]), held)
    assert sorted(map(tuple, got.collect())) == brute_search(rows, items)


def test_search_in_blocks_and_halves(spark, monkeypatch):
    rows, items = [(i, t) for i, t in enumerate(texts(2))], [(i, t) for i, t in enumerate(texts(3, 30, 8))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    assert sorted(map(tuple, lexical_search(docs_of(spark, [(*r, "x") for r in rows]), frame, k=3).collect())) == brute_search(rows, items, 3)
    long = [(0, "w1 " * 700_000 + "w2")]  # sums beyond what a double holds
    found = lexical_search(docs_of(spark, [(*r, "x") for r in rows]), spark.createDataFrame(long, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute_search(rows, long)


def test_search_of_nothing(spark):
    none = docs_of(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search(none, items).collect() == []
    assert lexical_search(docs_of(spark, [(1, "a", "x")]), items.limit(0)).collect() == []


# ---- 12


def brute_collocations(rows, least=30, first=2000, cover=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] = f.get((lang, tuple(words[i : i + m])), 0) + 1
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, _, left, right = min(((2_000_000 * a) // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            inside = any(lo == lang and len(q) > len(p) and b >= least and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lo, q), b in f.items())
            if not inside:
                out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang in {x[0] for x in out}:
        for r, (_, s, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:first]):
            ranked.append((lang, r + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(ranked)


def phrase_rows(seed):
    rows = [(["en", "de", None, "und", ""][i % 5], t) for i, t in enumerate(texts(seed, 200, 60, 6))]
    rows += [("en", "the the the the the, The\tTHE of the\n" * 12), ("en", None), ("en", ""), ("fr", " . ,\n"), ("es", "en es " * 20), ("en", "es en " * 20), ("de", "long word " * 40_000)]
    return rows + rows[:20]  # repeated rows


@pytest.mark.parametrize("numbered", [phrases.NUMBERED, 3])
def test_collocations_equal_brute_force(spark, monkeypatch, numbered):
    monkeypatch.setattr(phrases, "NUMBERED", numbered)
    monkeypatch.setattr(phrases, "CHUNK", 5000)
    rows = phrase_rows(4)
    got = collocations(docs_of(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), turns=3)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_collocations(rows)


def test_collocations_keep_the_first(spark):
    rows = phrase_rows(5)
    got = collocations(docs_of(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), least=10, first=7, cover=50, turns=1)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_collocations(rows, 10, 7, 50)
    assert collocations(docs_of(spark, [])).collect() == []
    assert collocations(docs_of(spark, [(1, None, "en"), (2, "once", "en")])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
@pytest.mark.parametrize("hot", [0, 2])
def test_sums_do_not_depend_on_batches(size, hot):
    rng = np.random.default_rng(6)
    key = rng.integers(1, 4, (400, 4))
    key[rng.random(400) < 0.3, 3] = 0
    key[rng.random(400) < 0.2, 2:] = 0
    key = key[np.lexsort(key.T[::-1])]
    c = rng.integers(1, 4, 400)
    sums, got = phrases._Sums(12, hot), Counter()
    parts = [sums.add(key[i : i + size], c[i : i + size]) for i in range(0, 400, size)] + [sums.add(key[:0], c[:0], last=True)]
    for k, n in parts:
        for row, x in zip(map(tuple, k.tolist()), n.tolist()):
            for m in (2, 3, 4):
                if row[m - 1]:
                    got[row[:m]] += x
    want = Counter()
    for row, x in zip(map(tuple, key.tolist()), c.tolist()):
        for m in (2, 3, 4):
            if row[m - 1]:
                want[row[:m]] += x
    assert {k: v for k, v in got.items() if v >= 12} == {k: v for k, v in want.items() if v >= 12}


# ---- 13


def brute_dedup(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for s in range(len(w) - width + 1 if i is not None else 0):
            p = tuple(w[s : s + width])
            least[p] = min(least.get(p, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def passages(seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "É", "<x>", "w w", *map(str, range(300))])
    stock = [[word() for _ in range(rng.randint(width - 1, 3 * width))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.4 else [word() for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(0, 80), rng.choice([" ", "\n", "\x0b "]).join(" ".join(p) for p in parts)))
    rows += rows[:5] + [(i, rows[0][1]) for i in (500, 3, 501, None)]
    rows += [(600, None), (601, ""), (602, "\t \n"), (None, rows[1][1]), (603, "same " * 4000), (604, "same " * 4000 + "end"), (605, "a b " * width), (605, rows[2][1])]
    return rows


@pytest.mark.parametrize("width", [1, 5, 9, 50])
def test_passages_equal_brute_force(spark, width):
    rows = passages(width, width)
    got = passage_dedup(docs_of(spark, [(i, t, "x") for i, t in rows]), width)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_dedup(rows, width)


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(8)
    rows = [(int(d), int(d) + 7, int(g)) for d in range(50) for g in rng.integers(0, 900, 20)]
    grams = spark.createDataFrame(sorted(set(rows)), "doc_id long, key long, gram long")
    often = Counter(g for _, _, g in set(rows))
    for width in (4, 256, 1 << 16):
        kept = {(r.doc_id, r.gram) for r in estimated_repeats(grams, width).collect()}
        assert kept >= {(d, g) for d, _, g in rows if often[g] > 1}
    assert len(kept) < len(set(rows))


def test_windows_of_numbers():
    x = np.random.default_rng(9).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 3, 43, 200, 201):
        assert least_within(x, width).tolist() == [min(x[i : i + width]) for i in range(200 - width + 1)]
    same = rolled(np.concatenate([x, x]), 7)
    assert (same[:194] == same[200:]).all() and len(set(same[:194].tolist())) > 180


def test_passages_of_nothing(spark):
    assert passage_dedup(docs_of(spark, [])).collect() == []
