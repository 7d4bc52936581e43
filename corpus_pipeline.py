"""The corpus pipeline: each stage works on all that the stage before it has written.

language_id drops documents without a recognisable language; simhash_near_dedup leaves the document with the least doc_id of each class
of near duplicates; substring_dedup removes the words of 20-word windows that have begun earlier and keeps every document, even if
nothing is left of it; decontamination drops documents that hold a benchmark item; bpe turns what is left into tokens and back, and
returns their number and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import decontaminate, langid, simhash, substring
from vertexloom.llm.queries import token_digests
from vertexloom.llm.scratch import Scratch, bounded, ship


def _ready(spark: SparkSession) -> None:
    """The workers of all stages are the same processes, so what each holds at once is bounded."""
    ship(spark)
    bounded(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return langid.identified(docs, langid.fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return substring.stripped(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: A learnt model and a tokenizer's merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
