"""A training corpus from raw documents: toxic and poor documents go, then copies, then
near copies, and what remains is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. Classifiers learn only from labelled rows outside their held-out folds.
Null, empty and repeated rows pass through the stages as their operators define."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringscope.llm import exact_dedup, minhash, packing, quality_classifier, toxicity
from ringscope.llm.bpe import vocabulary_file
from ringscope.llm.common import read, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5."""
    model = toxicity.fit_from(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, score_col="_score")
    return scored.where("_score < 0.5").drop("_score")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5 for quality."""
    model = quality_classifier.fit_from(docs, read(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, model, score_col="_score")
    return scored.where("_score >= 0.5").drop("_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one that the operator keeps."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: its smallest id. Shingles of two
    words, as in op4_minhash."""
    return minhash.keep_smallest(docs, shingle=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_file(None, "byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("quality", quality), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]

#: The classifiers and the packing search can't be said in SQL. tests/llm hold the operators
#: of all stages against brute force, the library or held-out labels, and the stages together
#: against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
