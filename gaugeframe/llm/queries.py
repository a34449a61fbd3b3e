"""The queries of the training-data operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import fingerprints, mixing, mixing_model, near_dedup, packing, quality, repair, resampling, runs, secrets, sharding, simhash, substring_dedup
from gaugeframe.llm.common import documents, shared_dir


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_model.scores(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir), sharding.shard_names(256)).select("doc_id", "slot", "shard")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir), length=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    repair.write_tokens(documents(spark, sf_dir), path)
    return repair.read_tokens(spark, path, with_ids=False)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir)).select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(secrets.KINDS))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.named(base), 256).alias("base_sha256"), secrets.named(F.col("found")).alias("spans"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c.split()[0] for c in quality.METRICS.split(", ")]
    return quality.judged(documents(spark, sf_dir)).select("doc_id", *names, "kept", "perplexity", "lower", "upper")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=4, reach=4)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir), with_tails=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.oracle(), "op5_mixing": mixing.oracle(), "op7_near_dedup": near_dedup.oracle(), "op8_secrets": secrets.oracle(), "op12_resampling": resampling.oracle(), "op13_periodic_runs": runs.oracle()}
