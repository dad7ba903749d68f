"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before has written and works on all of it. An empty table gives an
empty result in every stage, and columns that no stage knows are carried along, whatever their names,
but for ``n_chars``, ``n_lines``, ``n_dropped``, ``copy`` and ``shuffle_key``, which are set.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import lines, mixing, neardup, packing, quality
from eventide.llm.store import discard, find_package, scratch, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    A null or empty text has too few words and goes; a null language or source is one of its own.
    Repeated rows stay or go together.
    """
    return quality.sound_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many repeat; n_chars counts what is left.

    One row per row. A null text stays null, with a null n_chars. Of documents that share a line the
    one with the largest doc_id keeps it; rows of one doc_id, or without one, are parts of one document.
    """
    find_package(spark)
    cleaned = lines.drop_repeated_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates.

    Rows without a doc_id stay; of rows that repeat a doc_id one stays. Null and empty texts are like
    no other text.
    """
    find_package(spark)
    return neardup.first_of_each_class(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have an equal share of the text, in random order.

    A null source is one of its own, one of empty texts alone keeps each document once. Rows that
    agree in doc_id and text are repeated equally often.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A null or empty text is one piece of one token. Copies of a document are packed apart.
    """
    find_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Robust estimates, similarity classes and token ids are beyond SQL; the tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for i, (_, stage) in enumerate(first):
        # What a stage has written for itself goes once its result is written.
        with scratch(spark) as keep:
            done = keep(settle(stage(spark, docs, sf_dir)))
        if i:
            discard(docs)
        docs = done
    return last(spark, docs, sf_dir)
