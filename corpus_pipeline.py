"""From raw documents to sampled pieces: five stages, each on all that its predecessor kept.

Rejected texts go, boilerplate lines go, one text of each group of near duplicates
stays, domains are brought to target weights, and the rest is cut into pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.storage import materialize
from panelweave.llm import bbit_minhash, line_spread, piece_sampling, rule_cascade, soft_mixing
from panelweave.llm.queries import CHECKS as OPERATOR_CHECKS
from panelweave.llm.queries import QUERIES as OPERATOR_QUERIES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_cascade.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bbit_minhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_sampling.encode_sampled(docs, model)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

# The classifier and the sampled pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}
CHECKS = dict(OPERATOR_CHECKS)
