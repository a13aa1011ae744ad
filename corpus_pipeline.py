"""Corpus pipeline: language, exact copies, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Defined results: documents with a null text or without a letter go in the first stage, so no later
one sees them; null ids are larger than any id and stay where a choice allows it; of rows that
repeat one id and text one is kept; an empty table gives an empty result, as does each stage
for one; further columns of documents, whatever their names, pass through all stages but the
last, which returns parts and bins; texts of any length are worked on whole. A stage that
fails leaves the last written table behind; run() starts anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import exact_dedup, lang_id, ngram_join, packing, suffix_dedup
from rasterlake.llm.common import drop_folder, ensure_checkpoints, training_half
from rasterlake.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null texts and texts without a letter."""
    ship(spark)
    return lang_id.predict(docs, lang_id.learn(docs.where(training_half()))).where(F.col("lang_pred") != lang_id.UNKNOWN).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    ship(spark)
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more the smallest id stays."""
    ship(spark)
    return ngram_join.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and byte strings of 400, that start at several places are cut out of the texts."""
    ship(spark)
    return suffix_dedup.strip(docs, words=51)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every part of every document goes."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: Packing and suffix arrays are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; what a stage has read goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{ensure_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i:
            drop_folder(spark, f"{place}/{i - 1}")
    return docs
