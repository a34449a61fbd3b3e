"""What a tool asks of a report: its metrics, one metric's values in several shapes, changes against the base run, findings, profiles, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import joins, profile, rules
from gaugeframe.operators import timeseries as ts

SHAPES = ("raw", "compact", "downsampled", "average", "summary")


def metrics(points: DataFrame) -> DataFrame:
    """data_name, metric, and the runs and series that have it."""
    return points.groupBy("data_name", "metric").agg(F.count_distinct("run").alias("runs"), F.count_distinct("series").alias("series"))


def values(points: DataFrame, metric: str, shape: str = "raw", run: str | None = None, series: tuple[str, ...] = (), begin: int | None = None, end: int | None = None) -> DataFrame:
    """A metric's values: raw points, deltas as text, at most 50 buckets, the average of its series, or a summary. Series that do not exist are an error."""
    rows = points.where((F.col("metric") == metric) & (F.lit(True) if run is None else F.col("run") == run))
    if series:
        rows = rows.where(F.col("series").isin(*series))
        if rows.isEmpty():
            raise ValueError(f"no such series: {', '.join(series)}")
    rows = ts.between(rows, begin, end) if begin is not None or end is not None else rows
    return {"raw": lambda x: x, "compact": ts.run_length_text, "downsampled": ts.downsample, "average": ts.positional_average, "summary": ts.summary}[shape](rows)


def changes(stats: DataFrame, base_run: str, stat: str | None = None, least_percent: float = 0.0, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = ts.deltas(stats, base_run)
    return ts.page_of_deltas(rows if stat is None else rows.where(F.col("stat") == stat), offset, limit, least_percent)


def findings(found: DataFrame, sources: tuple[str, ...] = (), kind: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    return rules.ranked(rules.chosen(found, sources, kind), offset, limit)


def functions(samples: DataFrame, run: str, n: int = 20, least_percent: float = 0.0, pattern: str | None = None) -> DataFrame:
    return profile.flame_top(profile.flame(samples.where(F.col("run") == run)), n, least_percent, pattern)


def function_changes(samples: DataFrame, base_run: str, n: int = 20) -> DataFrame:
    return profile.largest_differences(profile.difference(profile.frames(samples), base_run), n)


def key_values(kv: DataFrame, names: list[str], differing: bool = False) -> DataFrame:
    """Key-values of the runs side by side; all, or those that differ."""
    rows = kv.where(F.col("run").isin(*names))
    if differing:
        rows = rows.join(joins.differing_keys(rows, rows.select("run").distinct()), ["grp", "key"], "left_semi")
    return joins.key_values_side_by_side(rows, names)
