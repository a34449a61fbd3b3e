"""Hardware counters: scaling by scheduled time, metrics by formula for each CPU and over all; processes by CPU time."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}
SAMPLE = ("run", "sample_idx", "ts")


def formula(text: str, events: list[str]) -> Column:
    """Arithmetic over event names (+ - * /, parentheses, numbers) as a column over columns of those names; division by 0 is null."""
    for k in sorted(range(len(events)), key=lambda k: -len(events[k])):
        text = text.replace(events[k], f"\0{k}\0")
    for k in range(len(events)):
        text = text.replace(f"\0{k}\0", f"_event{k}")

    def column(x: ast.expr) -> Column:
        if isinstance(x, ast.BinOp) and type(x.op) in OPERATIONS:
            return OPERATIONS[type(x.op)](column(x.left), column(x.right))
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
            return -column(x.operand)
        if isinstance(x, ast.Constant) and isinstance(x.value, int | float):
            return F.lit(float(x.value))
        if isinstance(x, ast.Name) and x.id.startswith("_event"):
            return F.col(f"`{events[int(x.id.removeprefix('_event'))]}`")
        raise ValueError(f"not a formula: {ast.unparse(x)}")

    return column(ast.parse(text.strip(), mode="eval").body)


def scheduled(counts: DataFrame) -> DataFrame:
    """``enabled`` and ``running``, which add up over a run, as what each snapshot added; the first adds its own."""
    by = Window.partitionBy("run", "cpu", "event").orderBy("sample_idx")
    return counts.withColumns({c: F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0.0)) for c in ("enabled", "running")})


def scaled(counts: DataFrame) -> DataFrame:
    """run, sample_idx, ts, cpu, event, value: first counts of ``scheduled`` rows, times enabled over running; those that never ran are left out."""
    value = F.get("counts", F.lit(0)) * F.try_divide("enabled", "running")
    return counts.select(*SAMPLE, "cpu", "event", value.alias("value")).where("value is not null")


def metric(values: DataFrame, name: str, text: str, events: list[str]) -> DataFrame:
    """Points of a formula for each CPU, and for series Aggregate over the sums of all CPUs. All events are needed; only finite values stay."""
    rows = values.where(F.col("event").isin(events))
    cpus = rows.groupBy(*SAMPLE, "cpu").agg(*[F.sum(F.when(F.col("event") == e, F.col("value"))).alias(e) for e in events])
    every = cpus.groupBy(*SAMPLE).agg(*[F.sum(f"`{e}`").alias(e) for e in events])
    both = cpus.withColumn("series", F.concat(F.lit("CPU"), "cpu")).drop("cpu").unionByName(every.withColumn("series", F.lit("Aggregate")))
    out = both.select(*SAMPLE, F.lit(name).alias("metric"), "series", formula(text, events).alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def schedule_rates(counts: DataFrame) -> DataFrame:
    """Mean percent of time that counters ran, for each CPU and over all (cpu null), from ``scheduled`` rows."""
    share = F.try_divide(F.col("running") * 100, F.col("enabled"))
    return counts.groupingSets([["run", "sample_idx", "cpu"], ["run", "sample_idx"]], "run", "sample_idx", "cpu").agg(F.avg(share).alias("percent"))


def legacy_ratio(counts: DataFrame) -> DataFrame:
    """Sums over CPUs of ``numerator`` times ``scale`` over ``denominator``, by run, sample and stat; none where the denominator is 0."""
    total = counts.groupBy(*SAMPLE, "stat").agg(F.sum(F.col("numerator") * F.col("scale")).alias("n"), F.sum("denominator").alias("d"))
    return total.select(*SAMPLE, F.col("stat").alias("metric"), F.lit("values").alias("series"), F.try_divide("n", "d").alias("value")).where("value is not null")


def busiest(processes: DataFrame, n: int = 16, own: tuple[str, ...] = ()) -> DataFrame:
    """Points of the ``n`` processes with the most user and kernel time in each run, and of the pids ``own``."""
    most = processes.where(F.col("metric").isin("user_time", "kernel_time")).groupBy("run", "series", "metric").agg(F.max("value").alias("v"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("cpu"), "series"))
    total = most.groupBy("run", "series").agg(F.sum("v").alias("cpu")).withColumn("rank", rank)
    kept = total.where((F.col("rank") <= n) | F.substring_index("series", "_", 1).isin(*own))
    return processes.join(kept.select("run", "series"), ["run", "series"], "left_semi")


def process_counts(processes: DataFrame) -> DataFrame:
    """Processes in each snapshot."""
    return processes.groupBy(*SAMPLE).agg(F.countDistinct("series").cast("double").alias("value"))
