"""A corpus pipeline: quality, language, near duplicates, source mix and packing, each stage an operator of ``llm``.

Every stage but the last returns the columns of documents. ``run`` applies all of them to the documents of ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.jaccard_join import BROADCAST_IDS, jaccard_components
from chronoweave.llm.language_id import fit_language, predict_language
from chronoweave.llm.mixing import mix_sources
from chronoweave.llm.packing import pack
from chronoweave.llm.quality import fit_quality, score_quality
from chronoweave.llm.queries import VOCABULARY, ratings
from chronoweave.plans.ship import ship
from chronoweave.plans.stash import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes when the chance that it is not poor is below this.
LEAST_QUALITY = 0.5
#: A document goes when its best language is less likely than this over its windows: no language it could be.
LEAST_LANGUAGE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the ordinal classifier, fitted on the rated ones, takes for poor.

    A null or empty text is scored like any other; without ratings every document scores the same. Repeated rows stay
    or go together, null ids do no harm, an empty table stays empty, and columns beyond those of documents are dropped.
    """
    ship(spark)
    model = fit_quality(docs, ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs.select(*COLUMNS), model).filter(F.col("tail") >= LEAST_QUALITY).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, null texts among them, and those that no learnt language fits.

    Without a labelled text nothing is kept but what the model scores high enough. Repeated rows stay or go together;
    an empty table stays empty, and columns beyond those of documents are dropped.
    """
    ship(spark)
    scored = predict_language(docs.select(*COLUMNS), fit_language(docs))
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group: sets of five-word shingles, similarity 0.8 or more.

    Of rows that share a doc_id one stays; rows without an id all stay.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = jaccard_components(docs, n=5, num=80, den=100)
    gone = stash(found.filter("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    again = stash(kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources have their target shares.

    A document stands floor(taken / size + u) times, u in [0, 1) by its id: as often as the mix takes its words on
    average. Documents without words go; documents without an id stay as they are. Rows that share an id are counted
    together and stand as often as each other. An empty table stays empty.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    taken = mix_sources(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("z"))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") / F.lit(float(1 << 53))
    times = stash(taken.filter("z > 0").select("doc_id", F.floor(F.col("t") / F.col("z") + chance).cast("int").alias("times")).filter("times > 0"))
    met = docs.join(F.broadcast(times) if times.count() <= BROADCAST_IDS else times, "doc_id")
    mixed = met.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)
    return mixed.unionByName(docs.filter("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 ids.

    A null or empty text is packed as its end mark alone; repeated rows are documents of their own, and an empty table
    gives no sequences.
    """
    ship(spark)
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fitted models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
