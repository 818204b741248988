"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skeinql.llm import ann, bpe, host_rules, jaccard, language_id, mixing, quality_model, secret_scan, toxicity, url_filter
from skeinql.llm.shared import documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.scored(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(documents(spark, sf_dir))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(documents(spark, sf_dir))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.RULES))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_mixing, op4_quality, op5_host_rules, op6_ann, op7_secrets, op8_jaccard, op9_toxicity, op10_url_filter)}
ORACLE_SQL = {"op3_mixing": mixing.SQL, "op5_host_rules": host_rules.SQL, "op8_jaccard": jaccard.SQL, "op10_url_filter": url_filter.SQL}
