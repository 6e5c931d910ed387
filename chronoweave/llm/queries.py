"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.ann_graph import nearest_neighbours
from chronoweave.llm.ball_tree import exact_top_k
from chronoweave.llm.chat_format import chat_format
from chronoweave.llm.collocations import collocations
from chronoweave.llm.jaccard_join import jaccard_components
from chronoweave.llm.language_id import FOLDS, fit_language, predict_language
from chronoweave.llm.lexical_search import lexical_search
from chronoweave.llm.mixing import mix_sources
from chronoweave.llm.packing import pack
from chronoweave.llm.passage_dedup import passage_dedup
from chronoweave.llm.quality import fit_quality, score_quality
from chronoweave.llm.token_counts import token_counts
from chronoweave.llm.toxicity import score_toxicity

VOCABULARY = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def ratings(labels: DataFrame) -> DataFrame:
    """Three grades from the two marks: 0 poor, 1 good but toxic, 2 good. A null mark gives no grade."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, ratings(_read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", "expected_grade", "tail", (F.col("tail") >= 0.5).alias("selected"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_read(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return predict_language(rows, fit_language(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_exact_top_k, op3_toxicity, op4_token_counts, op5_quality,
        op6_ngram_jaccard, op7_packing, op8_mixing, op9_chat_format, op10_language_id,
        op11_lexical_search, op12_collocations, op13_passage_dedup,
    )
}

ORACLE_SQL = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w
), e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), i AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT x, y FROM i WHERE 100 * k >= 90 * (nx + ny - k)
), r AS (
  SELECT doc_id AS root, doc_id AS node FROM s
  UNION SELECT r.root, l.y FROM r JOIN l ON r.node = l.x
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = s.doc_id
""",
    "op9_chat_format": """
WITH o AS (
  SELECT conv_id, list([role, text] ORDER BY turn) AS ts FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT ts[1:i] AS ts FROM o, LATERAL (SELECT unnest(range(1, len(ts))) AS i) u
), k AS (
  SELECT min(conv_id) AS conv_id FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = o.ts) GROUP BY ts
)
SELECT conv_id, CAST(r // 256 AS INTEGER) AS part, count(*) AS n_turns,
  string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id, r // 256
""",
    "op11_lexical_search": """
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0
), i AS MATERIALIZED (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), e AS (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d
), t AS MATERIALIZED (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM e WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term, n_docs
), s AS (
  SELECT i.item_id, t.doc_id, t.row, CAST(sum(i.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * g.n_docs) // g.n_terms)))) AS BIGINT) AS score
  FROM t JOIN w USING (term) JOIN i USING (term), g GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op12_collocations": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), o AS (SELECT lang, m, unnest(list_transform(range(1, CAST(len(ws) + 2 - m AS BIGINT)), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m
), f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS BIGINT) AS f FROM o GROUP BY ALL HAVING count(*) >= 30
), c AS MATERIALIZED (SELECT lang, m, phrase, ws, f AS a FROM f WHERE m > 1
), k AS (SELECT lang, m, phrase, ws, a, unnest(range(1, m)) AS k FROM c
), x AS (
  SELECT k.lang, k.m, k.phrase, k.ws, k.a, k.k, l.f AS l, r.f AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')
), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM x) WHERE q = 1
), u AS (
  SELECT lang, a AS longer, array_to_string(ws[s:s + z - 1], ' ') AS phrase
  FROM c, (SELECT unnest([2, 2, 2, 3, 3]) AS z, unnest([1, 2, 3, 1, 2]) AS s) WHERE z < m AND s + z - 1 <= m
), h AS (SELECT lang, phrase, max(longer) AS longer FROM u GROUP BY ALL
), v AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h USING (lang, phrase) WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM v JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_passage_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), o AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, CAST(len(ws) - 48 AS BIGINT))) AS place, unnest(list_transform(range(1, CAST(len(ws) - 48 AS BIGINT)), lambda i: sha256(array_to_string(ws[i:i + 49], ' ')))) AS h FROM d WHERE len(ws) >= 50
), m AS (SELECT h, min(doc_id) AS least FROM o GROUP BY h HAVING min(doc_id) < max(doc_id)
), g AS (SELECT o.doc_id, list(DISTINCT o.place) AS ps FROM o JOIN m USING (h) WHERE m.least < o.doc_id GROUP BY o.doc_id
), c AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS gone FROM g
), k AS (SELECT d.doc_id, d.ws, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)
), y AS (SELECT doc_id, len(ws) AS n_words, list_where(ws, list_transform(range(1, CAST(len(ws) + 1 AS BIGINT)), lambda i: NOT list_contains(gone, i))) AS kept FROM k)
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y
""",
}
