"""A training corpus from ``documents``: language, near copies, secrets, mixture and tokens, one stage after the other.

Every stage takes any table with the columns of documents, and more of any name, which all but the last pass on. Texts
are read whole at any length; a table without rows gives one. What each does with nulls, empty texts, ties and rows that
repeat is said at its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skeinql.llm import bpe, jaccard, language_id, mixing, secret_scan
from skeinql.llm.shared import written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject.

    Null and empty texts, and those without a letter, are rejected. A null doc_id or lang is no reason. Rows that repeat
    stay or go together; of equally near languages any keeps the document.
    """
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near copies.

    Documents without words, and rows without a doc_id, are nobody's copies and stay. Of rows with one doc_id one stays.
    """
    return jaccard.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced in their texts.

    Null and empty texts stay as they are; rows that repeat are rows of their own; spans that overlap or touch become one.
    """
    return secret_scan.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix begins to read them; those that it never reaches go.

    A document of which the mix takes no more than one size is there once, no more than two sizes twice, else thrice.
    Rows without a doc_id, and texts without a word, have nothing to mix and stay once. A null source is a source. Rows
    with one doc_id share what is taken of all of them; ties of the shuffle go by doc_id, then size.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix.

    A null text is an empty one, of no tokens. Rows that repeat, or have a null doc_id, are rows of their own.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", languages), ("ngram_jaccard_join", near_duplicates), ("secret_scan", secrets), ("source_mixing", mixture), ("byte_bpe", tokens)]

#: The stages train a classifier and run an encoder, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
