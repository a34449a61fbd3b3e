"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: an offset and a step taken from hashes of
its name. In turns, each claims the next free slot of its order, so shards own nearly equal
numbers of slots, and adding or losing a shard moves few others. The table has ``slots`` rows whatever the data, so it
is broadcast, and placing a document is one lookup by its hashed key.

Defined results: the key is doc_id, so a hot source spreads over all shards; a null doc_id falls back to the text's hash (a null text's too). Repeated rows share a
shard. Empty and very long texts are placed like others, and an empty table stays empty. All columns stay but ``slot`` and ``shard``, which are replaced.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the owning shard for each slot."""
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("names must be distinct, at least one and at most one a slot")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    at = [xxhash.xxh3_64_intdigest(n, seed=1) % slots for n in names]
    step = [xxhash.xxh3_64_intdigest(n, seed=2) % (slots - 1) + 1 for n in names]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(names)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot int, shard int")


def place(docs: DataFrame, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    rows = docs.drop("slot", "shard").withColumn("slot", F.pmod(key, F.lit(slots)).cast("int"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, names, slots)), "slot")


def write_sharded(docs: DataFrame, names: list[str], path: str, parts: int = 1) -> None:
    """One folder for each shard, each in ``parts`` files."""
    rows = place(docs, names).withColumn("_part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    rows.repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
