"""The corpus pipeline: quality, language, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of its input; the last returns the pieces of packed sequences.

Cases, in all stages: null and empty texts, very long texts (read whole), ties,
repeated rows and empty tables have the results that the operators state; columns
besides doc_id, text and lang are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import decontamination, language_id, minhash_dedup, packing, quality_pu
from loamgrid.llm.common import materialise, without


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts as good.

    Cases: a null or empty text is scored as one without words; without a positive label all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_pu.classify(docs, labels, keep=tuple(docs.columns)).where("predicted = 1").select("kept_row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of a learned language.

    Cases: a null text, or one without a letter, has no language and goes; so do all rows where no language can be learned.
    """
    return language_id.identify(docs, keep=tuple(docs.columns)).where(~F.col("rejected")).select("kept_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words.

    Cases: the least doc_id of a group stays, with all rows that have it; texts without words and rows without doc_id stay.
    """
    return without(docs, minhash_dedup.near_duplicates(docs).where(~F.col("kept")))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Cases: texts without words stay; of rows that share a doc_id all go if one is hit; rows without doc_id stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.decontaminate(docs, items, slop=None).where("n_hit > 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    Cases: a null or empty text is one end token; each row is packed by itself, be its doc_id null or shared.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: The learned stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
