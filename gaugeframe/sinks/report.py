"""Report files: series and findings as JSON behind ``name = ``, tables as HTML, and an archive of them."""

from __future__ import annotations

import html
import json
import os
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.expr import trunc2
from gaugeframe.operators import timeseries as ts


def shown(value: Column) -> Column:
    """A number as reports have it: two decimals, cut toward zero; null where it is not finite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(trunc2(value))


def series_json(points: DataFrame, stats: DataFrame) -> DataFrame:
    """data_name, run, metric, json: a metric with its series in natural order as parallel arrays, and its statistics. A series is one value of the JSON."""
    rows = points.groupBy("data_name", "run", "metric", "series").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "time_diff", shown(F.col("value")).alias("value")))).alias("p"), F.bool_or("is_aggregate").alias("is_aggregate"))
    from gaugeframe.functions.expr import natural_key

    one = F.struct(F.col("series").alias("series_name"), F.transform("p", lambda x: x["time_diff"]).alias("time_diff"), F.transform("p", lambda x: x["value"]).alias("values"), "is_aggregate")
    series = rows.withColumn("k", natural_key(F.col("series"))).groupBy("data_name", "run", "metric").agg(F.transform(F.sort_array(F.collect_list(F.struct("is_aggregate", "k", one.alias("s")))), lambda x: x["s"]).alias("series"))
    numbers = F.struct(*[shown(F.col(c)).alias(c) for c in ts.STATS]).alias("stats")
    out = series.join(stats.select("data_name", "run", "metric", numbers), ["data_name", "run", "metric"])
    return out.select("data_name", "run", "metric", F.to_json(F.struct(F.col("metric").alias("metric_name"), "series", "stats"), {"ignoreNullFields": "false"}).alias("json"))


def key_values_json(kv: DataFrame) -> DataFrame:
    """data_name, run, json: group -> key -> value."""
    groups = kv.groupBy("data_name", "run", "grp").agg(F.sort_array(F.collect_set(F.struct("key", "value"))).alias("e"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("grp", "e"))), lambda x: F.struct(x["grp"], F.map_from_entries(x["e"])))
    return groups.groupBy("data_name", "run").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def lines_json(lines: DataFrame) -> DataFrame:
    """data_name, run, json: a text's lines."""
    rows = lines.groupBy("data_name", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    return rows.select("data_name", "run", F.to_json(F.struct("lines")).alias("json"))


#: Formats of data by name.
FORMATS: dict[str, Callable[..., DataFrame]] = {"time_series": series_json, "key_value": key_values_json, "text": lines_json}


def to_json(kind: str, *tables: DataFrame) -> DataFrame:
    return FORMATS[kind](*tables)


def findings_json(findings: DataFrame) -> DataFrame:
    """data_name, json: run -> key -> findings."""
    rows = findings.groupBy("data_name", "run", "key").agg(F.sort_array(F.collect_list(F.struct("rule_name", "score", "description"))).alias("f"))
    return rows.select("data_name", F.to_json(F.struct("run", "key", F.col("f").alias("findings"))).alias("json"))


def write_variables(tables: DataFrame, path: str) -> None:
    """Each row (name, json) as a text file part ``name = json`` in a folder of its name; written by the tasks."""
    tables.select(F.col("name").alias("part"), F.concat_ws(" = ", "name", "json").alias("value")).write.partitionBy("part").mode("overwrite").text(path)


def html_rows(table: DataFrame) -> DataFrame:
    """One row of HTML for each row of a table."""
    names = table.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = ["".join(f"<td>{html.escape('' if pd.isna(x) else str(x))}</td>" for x in row) for row in b[names].itertuples(index=False)]
            yield pd.DataFrame({"html": [f"<tr>{c}</tr>" for c in cells]})

    return table.mapInPandas(run, "html string")


def html_page(table: DataFrame, rows: int = 5000) -> str:
    """A table of at most ``rows`` rows as HTML."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    return f"<table><tr>{head}</tr>{''.join(r['html'] for r in html_rows(table.limit(rows)).collect())}</table>"


def append_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("append").partitionBy("run", "data_name").parquet(path)


def write_csv(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        flat = table.select(*[F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in table.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def archive(folder: str, to: str) -> None:
    """A report's folder as a .tar.gz, under its own name."""
    with tarfile.open(to, "w:gz") as tar:
        tar.add(folder, os.path.basename(folder.rstrip("/")))


def answer(table: DataFrame, rows: int = 1000) -> str:
    """A query's rows, at most so many, as one JSON text."""
    return json.dumps([json.loads(r["json"]) for r in table.limit(rows).select(F.to_json(F.struct("*")).alias("json")).collect()])
