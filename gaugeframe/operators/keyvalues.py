"""Key-values: tables kv(run, data_name, grp, key, value) from wide rows, side by side, searched and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One wide row a run as key-values: ``names`` maps columns to keys. Nulls are left out."""
    texts = rows.select("run", *[F.col(c).cast("string").alias(k) for c, k in names.items()])
    return texts.unpivot("run", [F.col(f"`{k}`") for k in names.values()], "key", "value").where("value is not null").withColumn("grp", F.lit(""))


def header(kv: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a run with a column for each key; of a key in several groups the value of the first group by name."""
    rows = kv.where(F.col("key").isin(*keys)).groupBy("run", "key").agg(F.min_by("value", "grp").alias("value"))
    return rows.groupBy("run").pivot("key", list(keys)).agg(F.first("value"))


def by_profiler(metadata: DataFrame, profilers: list[str]) -> DataFrame:
    """run, key and one column for each profiler."""
    return metadata.groupBy("run", "key").pivot("profiler", profilers).agg(F.min("value"))


def search(kv: DataFrame, text: str) -> DataFrame:
    """Key-values whose group or key holds a text in any case."""
    held = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    return kv.where(held("grp") | held("key"))


def page(table: DataFrame, number: int, rows: int = 50) -> DataFrame:
    """Page ``number`` (from 0) of a table sorted by its columns."""
    return table.orderBy(*table.columns).offset(number * rows).limit(rows)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of keys in both the second's value holds."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def pids(collector: Column, others: Column) -> Column:
    """The ids of the collector and its subprocesses, each once."""
    return F.array_sort(F.array_union(F.array(collector), F.coalesce(others, F.array().cast("array<long>"))))
