"""The ten corpus operators and the pipeline against brute force, on small tables with every awkward case."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann_graph, ball_tree, jaccard_join, packing, toxicity
from chronoweave.llm.chat_format import chat_format
from chronoweave.llm.language_id import fit_language, predict_language
from chronoweave.llm.mixing import mix_sources, permuted, source_targets
from chronoweave.llm.pretoken import load_vocabulary
from chronoweave.llm.quality import fit_quality, score_quality
from chronoweave.llm.token_counts import token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, start string"
#: Null, empty, blank, repeated and long texts, special strings, and extra columns whose names the operators use too.
ODD = [None, "", "  \n", "a", "a b", "It's we'll  x\n\n'sun", "<|endoftext|> mid <|endoftext|>", "日本 ½ ²x ×", "same same same", "same same same", "word " * 3000]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, ["en", "de", None][i % 3], ["s0", "s1", None][i % 3], 0 if t is None else len(t), 0.5, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def vectors(spark, n=240, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(60)]  # copies of one vector
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * (dim - 2)), (1040, [float("nan")] * dim), (1060, [0.0] * dim), (1080, [float("inf")] * dim), (None, [1.0] * dim), (1100, [1.0, 2.0])]
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, shard int")


def brute(rows, k, measure):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            near = sorted(((-measure(v, w), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_exact_top_k_equals_brute_force(spark):
    df = vectors(spark)
    rows = [(r.vec_id, [np.floor(np.float64(np.float32(x)) * 64) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = brute(rows, 20, lambda a, b: int(np.dot(a, b)))
    got = {}
    for r in ball_tree.exact_top_k(df, shard_rows=64, leaf=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in want.items() if v}
    assert ball_tree.exact_top_k(df.limit(0)).count() == 0


def test_ball_tree_prunes():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (200, 4)) for c in (-5, 0, 5)])
    tree, order = ball_tree.ball_tree(points, 16)
    points = points[order]
    same = ball_tree.numbered_tree(points, 16)
    assert all(np.allclose(x, y) for x, y in zip(tree[:3], same[:3]))
    place, score, bounded = ball_tree.search_tree(points, np.arange(600), tree, points[:20], np.full(20, -np.inf), 5)
    assert bounded < 20 * len(tree.radii) / 2
    assert np.allclose(score, -np.sort(-points[:20] @ points.T, axis=1)[:, :5])


def test_vector_searches_of_repeated_ids_and_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(99)]
    rows[40] = (40, [1e7, -3.0, 1e17, 2.0])
    rows[41] = (41, [1e30, -1e30, 1.0, 1e9])
    df = spark.createDataFrame(rows + [rows[20]] * 25 + [(60, [-9.0] * 4)], "vec_id long, embedding array<double>")
    held = dict(rows)
    held[60] = min(held[60], [-9.0] * 4)
    cells = {i: [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(x * 64)))) for x in v] for i, v in held.items()}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for shard_rows in (1000, 30):
        got = {}
        for r in ball_tree.exact_top_k(df, shard_rows=shard_rows, leaf=8).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in range(0, 99, 20):
            want = sorted((-clip(sum(a * b for a, b in zip(cells[q], w))), i) for i, w in cells.items() if i != q)[:20]
            assert got[q] == [(i, -s) for s, i in want], q
    found = {}
    for r in ann_graph.nearest_neighbours(df.filter("vec_id not in (40, 41)"), shard_rows=30).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert all(len(v) == 20 and q not in v for q, v in found.items())
    assert all(s == pytest.approx(float(np.dot(held[q], held[i])), rel=1e-12) for q, v in found.items() for i, s in v.items())


def test_graph_recall(spark):
    df = vectors(spark, n=600, dim=8)
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    want = brute(rows, 20, lambda a, b: float(np.dot(a, b)))
    got, score = {}, {}
    for r in ann_graph.nearest_neighbours(df, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        score[r.query_id, r.vec_id] = r.score
    hit = [len({i for i, _ in v} & set(got[q])) / len(v) for q, v in want.items() if v]
    assert np.mean(hit) >= 0.9 and all(1000 > i or i == 1100 for v in got.values() for i in v)
    held = dict(rows)
    assert all(s == pytest.approx(float(np.dot(held[q], held[i]))) for (q, i), s in score.items())
    assert ann_graph.nearest_neighbours(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(400)]
    toxic = [i % 4 == 0 for i in range(400)]
    texts = [t + " vileword awfulword vileword" if x else t for t, x in zip(texts, toxic)]
    df = docs_of(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, labels, count_turns=2, score_turns=2).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert {r.score for r in toxicity.score_toxicity(df, labels.limit(0), count_turns=1, score_turns=1).collect()} == {0.5}
    assert toxicity.score_toxicity(df.limit(0), labels, count_turns=1, score_turns=1).count() == 0


def test_toxicity_tells_an_expression_from_its_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    toxic = [i % 3 == 0 for i in range(600)]
    texts = []
    for x in toxic:
        t = rng.choices(words, k=24)
        t[4:4] = ["stone", "bread"] if x else ["bread", "stone"]
        texts.append(" ".join(t))
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    df = docs_of(spark, texts)
    rows = toxicity.score_toxicity(df.unionAll(df.filter("doc_id < 50")), labels, count_turns=3, score_turns=2).collect()
    assert len(rows) == 650 and all(len({r.score for r in rows if r.doc_id == i}) == 1 for i in range(50))
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_toxicity_equals_plain_kneser_ney(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(40)) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "...", "one " * 5000]
    toxic = [rng.random() < 0.4 for _ in texts]
    asked = texts[::3] + ["never seen", "1 never 2", None]
    pairs = lambda t: list(zip(["<s>", *t.split()], [*t.split(), "</s>"])) if t and t.strip(".") else []
    c = {k: Counter(p for t, x in zip(texts, toxic) if x == k for p in pairs(t)) for k in (True, False)}
    w = {k: Counter() for k in c}
    uses, kinds = {k: Counter() for k in c}, {k: Counter() for k in c}
    for k in c:
        for (h, x), n in c[k].items():
            w[k][x] += n
            uses[k][h] += n
            kinds[k][h] += 1
    types = set(c[True]) | set(c[False])
    contexts = Counter(x for _, x in types)
    d = lambda held: min(max((ones := sum(n == 1 for n in held.values())) / max(ones + 2 * sum(n == 2 for n in held.values()), 1), 0.1), 0.95)
    one = lambda k, x: (max(w[k][x] - d(w[k]), 0) + d(w[k]) * len(w[k]) * (contexts[x] + 1) / (len(types) + len(contexts) + 1)) / sum(w[k].values())
    two = lambda k, h, x: (max(c[k][h, x] - d(c[k]), 0) + d(c[k]) * kinds[k][h] * one(k, x)) / uses[k][h] if uses[k][h] else one(k, x)
    want = {}
    for i, t in enumerate(asked):
        ratio = [np.log(one(True, x) / one(False, x)) for _, x in pairs(t)]
        both = [np.log(two(True, h, x) / two(False, h, x)) for h, x in pairs(t)]
        if ratio:
            want[i] = [len(ratio), sum(ratio), *(sum(max(r - m, 0) for r in ratio) for m in toxicity.MARGINS), sum(both)]
    train = spark.createDataFrame([(int(x), t) for x, t in zip(toxic, texts)], "toxic int, text string")
    monkeypatch.setattr(toxicity, "PART_KEYS", 100)
    tables, model, parts = toxicity.counted(train, 3, 2)
    assert parts > 5
    docs = spark.createDataFrame(list(enumerate(asked)), "text_key long, text string")
    got = {r.text_key: [r.n, *(r[s] for s in toxicity.SUMS)] for r in toxicity.text_sums(docs, toxicity._union(tables), model, parts).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-4, abs=1e-4), asked[i]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(2)
    parts = ["a", "s", "t", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "!", "é", "×", " ", "日", "😀", "<|", "<|endoftext|>", "Ω", "\x1c"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(600)]
    want = [len(library().encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = token_counts(docs_of(spark, texts), VOCABULARY).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [n > 1024 for n in want]
    assert token_counts(docs_of(spark, texts).limit(0), VOCABULARY).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["stone", "river", "cloud", "tree", "wind"], k=40)) for _ in range(120)]
    fair = [" ".join(rng.choices(["stone", "river", "meh", "so", "so"], k=40)) for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in rng.choices(["buy", "now", "win"], k=40)) for _ in range(120)]
    df = docs_of(spark, good + fair + bad + ODD)
    ratings = spark.createDataFrame([(i, 2 - i // 120) for i in range(360)] + [(None, 1), (3, None)], "doc_id long, grade int")
    train = ratings.filter("doc_id % 3 <> 0")
    model = fit_quality(df, train)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = score_quality(df, model).collect()
    held = [r for r in rows if r.doc_id < 360 and r.doc_id % 3 == 0]
    assert np.mean([(r.tail >= 0.5) == (r.doc_id < 240) for r in held]) > 0.95
    assert np.mean([round(r.expected_grade) == 2 - r.doc_id // 120 for r in held]) > 0.9
    assert len(rows) == 360 + len(ODD) and all(0 <= r.tail <= 1 for r in rows)
    assert score_quality(df.limit(0), model).count() == 0
    assert fit_quality(df, ratings.limit(0)).weights.max() == 0


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for size in (8, 30, 60, 150, 400):
        for _ in range(3):
            base = rng.choices(words, k=size)
            texts.append(" ".join(base))
            for changes in (1, 1, 2, 3, 6, 12):
                copy = list(base)
                for _ in range(min(changes, size // 8 + 1)):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


@pytest.mark.parametrize("n, num, kind", [(3, 90, None), (5, 80, None), (3, 90, 0), (3, 90, 3), (5, 80, 0), (5, 80, 4)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, n, num, kind):
    """``kind`` forces one-deletion neighbourhoods (0) or segment subsets (3, 4) where the costs choose freely."""
    if kind is not None:
        def forced(edges, counts, num, den):
            out = []
            for band in range(len(edges) - 1):
                top = edges[band + 1] - 1
                most = (den - num) * (top + top * den // num) // (den + num)
                out.append(((most + 2) // 2 + 4, kind, 1, 1) if most else (0, 0, 0, 0))
            return out

        monkeypatch.setattr(jaccard_join, "allocate", forced)
    texts = near_texts()
    sets = sets_of(texts, n)
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    df = docs_of(spark, texts)
    rows = jaccard_join.jaccard_components(df, n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}
    assert len(rows) == len(texts)


def test_jaccard_of_awkward_tables(spark):
    df = docs_of(spark, ["one two three four", "one two three four", "x"])
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    again = df.union(df.filter("doc_id = 0")).union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in jaccard_join.jaccard_components(again).collect())
    assert rows == [(-1, None), (0, 0), (0, 0), (1, 0), (2, 2)]
    assert jaccard_join.jaccard_components(docs_of(spark, [None, "", " "])).count() == 3


def check_pieces(rows, texts):
    ids = {i: library().encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        mine = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.start == at[r.doc_id] and len(mine) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(mine.tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    return len(sequences)


def test_packing(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(1, 700))) for _ in range(200)]
    made = check_pieces(packing.pack(docs_of(spark, texts), VOCABULARY).collect(), texts)
    total = sum(len(library().encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert made <= total / 1024 * 1.03 + 2
    assert packing.pack(docs_of(spark, texts).limit(0), VOCABULARY).count() == 0
    assert packing.pack(docs_of(spark, ["x"] * 5).withColumn("doc_id", F.lit(1)), VOCABULARY).count() == 5


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 1024), 60, replace=False))
    demand = rng.integers(1, 50, 60)
    patterns, uses = packing.cutting_stock(sizes, demand, 1024)
    assert ((patterns.T @ uses) == demand).all() and ((patterns @ sizes) <= 1024).all()
    least = 0  # a lower bound on any packing: lengths over half stand apart, the shorter ones fill what these leave
    for k in range(513):
        middle, small = (sizes > 512) & (sizes <= 1024 - k), (sizes >= k) & (sizes <= 512)
        free = 1024 * demand[middle].sum() - (sizes * demand)[middle].sum()
        more = max(0, -(-((sizes * demand)[small].sum() - free) // 1024))
        least = max(least, demand[sizes > 1024 - k].sum() + demand[middle].sum() + more)
    assert least <= uses.sum() <= least * 1.02 + 3


def test_mixing(spark):
    rng = random.Random(7)
    texts = [" ".join(["w"] * rng.randrange(1, 400)) for _ in range(600)]
    df = docs_of(spark, texts + ODD).unionByName(docs_of(spark, ["only one"]).withColumn("source", F.lit("tiny")))
    rows = mix_sources(df).collect()
    assert len(rows) == len(texts) + len(ODD) + 1
    again = {(r.doc_id, r.size): r.taken for r in mix_sources(df.repartition(7)).collect()}
    assert {(r.doc_id, r.size): r.taken for r in rows} == again
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    sums = {}
    for r in rows:
        sums.setdefault((r.source_size, r.target), [0, 0])
        sums[r.source_size, r.target][0] += r.taken
        sums[r.source_size, r.target][1] += r.size
    for (size, target), (taken, own) in sums.items():
        assert own == size and abs(taken - target) <= 0.02 * target + 40
    total = sum(own for _, own in sums.values())
    order = sorted(((s, t) for s, t in sums), key=lambda x: x[1])
    assert sum(t for _, t in order) == pytest.approx(total) and order[0][1] == 3 * order[0][0]
    assert mix_sources(df.limit(0)).count() == 0 and mix_sources(docs_of(spark, [None, ""])).count() == 2


def test_chat_format(spark):
    a = [("user", "hi"), ("assistant", "yo <|x|>"), ("user", None)]
    rows = [(1, i, *x) for i, x in enumerate(a)] + [(2, i, *x) for i, x in enumerate(a[:2])] + [(3, i + 5, *x) for i, x in enumerate(a[:2])]
    rows += [(4, 0, "user", "hi")] * 2 + [(5, 0, None, "hi"), (None, 0, "user", "lost"), (6, None, "user", "a")]
    rows += [(7, i, "user", str(i)) for i in range(600)] + [(8, i, "user", str(i)) for i in range(300)] + [(9, i, *x) for i, x in enumerate(a)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = {(r.conv_id, r.part): r for r in chat_format(df).collect()}
    assert {c for c, _ in got} == {1, 4, 5, None, 6, 7}
    assert got[1, 0].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo < |x|><|end|>\n<|user|>\n<|end|>\n"
    assert got[5, 0].rendered == "<|unknown|>\nhi<|end|>\n"
    assert [got[7, p].n_turns for p in range(3)] == [256, 256, 88]
    assert chat_format(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(8)
    pools = {"en": ["the", "thing", "with", "house"], "de": ["über", "schön", "nicht", "straße"]}
    rows = [(i, " ".join(rng.choices(pools[lang], k=30)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    df = spark.createDataFrame([(i, t, lang, 0.1) for i, t, lang in rows] + [(900 + i, t, None, 0.1) for i, t in enumerate([*ODD, "123 !!"])], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in predict_language(df, fit_language(df)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[900 + i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    assert predict_language(df.limit(0), fit_language(df.limit(0))).count() == 0


def test_special_strings_come_from_the_vocabulary():
    assert load_vocabulary(VOCABULARY)[1] == {"<|endoftext|>": 50256}


def test_words_and_sets_by_bytes():
    texts = near_texts()
    from chronoweave.llm.textbytes import text_chunks

    for _, _, data, offsets in text_chunks(pa.array(texts)):
        _, bounds = jaccard_join.shingle_sets(data, offsets, 3)
        assert np.diff(bounds).tolist() == [len(s) for s in sets_of(texts, 3)]


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, folder)
        if name == "packing":
            break
        assert kept.columns == docs.columns
        kept = kept.cache()
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        had = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= had and ids
        if name in ("quality", "language"):
            assert len(clean & ids) >= 0.97 * len(clean & had)
        if name == "near_duplicates":
            texts = [r.text for r in kept.select("text").collect()]
            sets = sets_of(texts, 5)
            assert not any(sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i))
    pieces = kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert pieces <= 1024


def test_long_spans_hash_like_short_ones(monkeypatch):
    """Windows and pieces of any size give the hash that one pass gives."""
    from chronoweave.llm import textbytes

    rng = np.random.default_rng(0)
    data = np.frombuffer(b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (3, 1, 400, 3, 90, 7)) + b" abc abc", np.uint8)
    starts, ends, _ = textbytes.word_spans(data, np.array([0, len(data)]))
    want = textbytes.span_hashes(data, starts, ends)
    assert want[-1] == want[-2] and len(set(want.tolist())) == len(want) - 1
    for window in (2, 5, 64, 399, 400, 401):
        monkeypatch.setattr(textbytes, "WINDOW", window)
        assert (textbytes.span_hashes(data, starts, ends) == want).all()


def test_permutations_are_whole(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("x")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_targets_by_raising_the_level(spark):
    """Water-filling against a level that is raised in small steps."""
    sizes = {"a": 500, "b": 40, "c": 900, None: 60}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in source_targets(df, (5, 2, 1), 3).collect()}
    weight = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n, level * weight[s]) for s, n in sizes.items()) < 1500 else (low, level)
    assert found == pytest.approx({s: min(3 * n, level * weight[s]) for s, n in sizes.items()})


def test_a_text_beyond_a_chunk(spark):
    """A text of over 3 MB is one document: its words, shingles and mix are those of the whole."""
    long = " ".join(f"w{i % 5000}x{i}" for i in range(300_000))
    df = docs_of(spark, [long, long + " end", "short one"])
    assert len(long) > 3 << 20
    rows = {r.doc_id: r for r in jaccard_join.jaccard_components(df, 5, 80, 100).collect()}
    assert rows[0].n_shingles == 299_996 and rows[1].component_id == 0 and rows[2].component_id == 2
    assert {r.doc_id: r.size for r in mix_sources(df).collect()} == {0: 300_000, 1: 300_001, 2: 2}


def test_every_node_is_reached():
    rng = np.random.default_rng(11)
    for seed in range(300):
        n, dim = int(rng.integers(2, 150)), int(rng.integers(2, 9))
        x = rng.normal(size=(n, dim)) * np.exp(rng.normal(0, 1.5, (n, 1))) + (rng.integers(0, 3, (n, 1)) * 4 if seed % 2 else 0)
        points = ann_graph.lifted(x)
        edges, medoid = ann_graph.build_graph(points, degree=int(rng.integers(3, 33)))
        assert ann_graph.reached(edges, medoid).all()


@pytest.mark.parametrize("n", [2, 15, 20, 21])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=2) * np.exp(rng.normal(0, 2))]) for i in range(n)]
    got = ann_graph.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows, 20, lambda a, b: float(np.dot(a, b)))
    for q, near in want.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in near]


def test_language_keeps_reserved_names_and_samples_an_id_once(spark):
    texts = ["the cat and the dog", "der Hund und die Katze"] * 30
    rows = [(i, t, ["en", "de"][i % 2], "p") for i, t in enumerate(texts)] + [(0, "the cat and the dog", "en", "p")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _pred string")
    out = predict_language(df, fit_language(df)).collect()
    assert len(out) == len(rows) and {r._pred for r in out} == {"p"} and np.mean([r.lang_pred == r.lang for r in out]) > 0.9
