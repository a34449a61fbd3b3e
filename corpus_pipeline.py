"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of ``documents``, whatever their names, and further ones as they are.

Defined results of the stages. quality: null, empty and very short texts go, a null language has bands of its own, repeated rows share a verdict. near_dedup:
one row of each group of near copies stays, the one with the least doc_id (without any id: with the least hash of its text), repeated rows once. secrets: texts without spans, and null
ones, stay as they are; n_chars follows the text. mixing: rows with equal doc_id share a decision, nulls in a margin are a value of their own. packing: an
empty text is its end id. Very long texts pass every stage whole, and an empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.llm import mixing, near_dedup, packing, quality, secrets
from gaugeframe.llm.common import discard, documents, materialize


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", reject_by_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenization can't be said in SQL; tests/llm/test_brute_force.py holds run() against plain-Python versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            discard(before)
    return docs
