"""Each source from raw snapshots to points: parser, rates or gauges, aggregate series. A source is a function of raw(run, sample_idx, ts, payload)
(``ts`` in seconds since the run's start, whole) that returns points(run, metric, series, sample_idx, time_diff, value, is_aggregate)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import counters
from gaugeframe.operators import timeseries as ts
from gaugeframe.sources import snapshots, text

COLUMNS = ("run", "metric", "series", "sample_idx", "time_diff", "value", "is_aggregate")
#: Kinds of work requests, whose mean bytes are a metric.
REQUESTS = ("send", "recv", "rdma_write", "rdma_read")


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time_diff", F.col("ts").cast("long")).drop("ts")


def finished(points: DataFrame) -> DataFrame:
    out = points if "is_aggregate" in points.columns else points.withColumn("is_aggregate", F.lit(False))
    return out.select(*COLUMNS)


def partly_rates(rows: DataFrame, gauge) -> DataFrame:
    """Counters as rates; the metrics that ``gauge`` names stay as they are."""
    return ts.rates(rows.where(~gauge)).unionByName(rows.where(gauge))


def derived(points: DataFrame, quotients: dict[str, tuple[str, str]]) -> DataFrame:
    """``points`` and, for each quotient (above, below), that metric of every series and snapshot with one of the two: 0 where ``below`` is 0 or missing. A series' metrics at a snapshot
    are one row with a map in between, so points are read once, however many quotients there are. Of points with equal keys the last by value holds."""
    keys = ["run", "series", "sample_idx"]
    row = points.groupBy(*keys, "metric").agg(F.max("time_diff").alias("time_diff"), F.max("value").alias("value")).groupBy(*keys).agg(F.min("time_diff").alias("time_diff"), F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    zero = F.lit(0.0)
    parts = [F.col("m")]
    for name, (above, below) in quotients.items():
        a, b = (F.coalesce(F.try_element_at("m", F.lit(x)), zero) for x in (above, below))
        value = F.when(b > 0, a / F.nullif(b, zero)).otherwise(zero)
        there = F.map_contains_key("m", F.lit(above)) | F.map_contains_key("m", F.lit(below))
        parts.append(F.when(there, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,double>")))
    return row.select(*keys, "time_diff", F.explode(F.map_concat(*parts)).alias("metric", "value"))


def aggregated(points: DataFrame, seen: DataFrame) -> DataFrame:
    """``points`` (one for each series and snapshot) with the average series of every metric that has several series in ``seen`` (run, metric, series), series and averages from one
    pass by grouping sets."""
    keys = ["run", "metric", "sample_idx"]
    sets = points.groupingSets([[*keys, "series"], keys], *keys, "series").agg(F.min("time_diff").alias("time_diff"), F.avg("value").alias("value"), F.grouping("series").alias("_all"))
    many = seen.groupBy("run", "metric").agg((F.min("series") < F.max("series")).alias("_many"))
    rows = sets.join(many, ["run", "metric"], "left").where((F.col("_all") == 0) | F.col("_many"))
    return rows.withColumns({"is_aggregate": F.col("_all") == 1, "series": F.when(F.col("_all") == 1, "average").otherwise(F.col("series"))}).select(*COLUMNS)


def cpu_utilization(raw: DataFrame) -> DataFrame:
    rows = timed(text.cpu_shares(text.cpu(raw)))
    return finished(rows.withColumn("is_aggregate", (F.col("metric") == "aggregate") & (F.col("series") == "total")))


def vmstat(raw: DataFrame) -> DataFrame:
    rows = partly_rates(timed(text.pairs(raw)), F.col("metric").startswith("nr_"))
    return finished(rows.unionByName(ts.remainder(rows, "pgfault", "pgmajfault", "pgminorfault")))


def diskstats(raw: DataFrame) -> DataFrame:
    return finished(partly_rates(timed(text.disks(raw)), F.col("metric") == "in_progress"))


def interrupts(raw: DataFrame) -> DataFrame:
    rows = timed(snapshots.interrupts(raw))
    return aggregated(ts.rates(rows), rows)


def meminfo(raw: DataFrame) -> DataFrame:
    return finished(timed(text.memory(raw)))


def netstat(raw: DataFrame) -> DataFrame:
    return finished(ts.rates(timed(text.network(raw))))


def numastat(raw: DataFrame) -> DataFrame:
    rows = timed(text.components(raw))
    return aggregated(ts.rates(rows), rows)


def ena_stat(raw: DataFrame) -> DataFrame:
    rows = timed(text.queue_split(text.components(raw)))
    return aggregated(ts.rates(rows), rows)


def efa_stat(raw: DataFrame) -> DataFrame:
    rows = timed(text.components(raw))
    quotients = {f"avg_bytes_per_{k}_wr": (f"{k}_bytes", f"{k}_wrs") for k in REQUESTS}
    names = F.create_map(*[F.lit(x) for name, pair in quotients.items() for m in pair for x in (m, name)])
    seen = rows.select("run", "series", F.explode(F.array_compact(F.array("metric", F.try_element_at(names, F.col("metric"))))).alias("metric"))
    return aggregated(derived(ts.rates(rows), quotients), seen)


def memalloc(raw: DataFrame) -> DataFrame:
    """payloads of buddies, page types and slabs in columns buddyinfo, pagetypeinfo, slabinfo; gauges."""
    rows = timed(snapshots.memory(raw))
    return aggregated(rows, rows).withColumn("metric", text.memory_label(F.col("metric")))


def processes(raw: DataFrame, ticks: int = 100, page_size: int = 4096, own: tuple[str, ...] = (), n: int = 16) -> DataFrame:
    """The busiest processes: times in seconds a second, the others as they are; and the number of processes."""
    rows = snapshots.processes(raw, page_size)
    count = timed(counters.process_counts(rows)).select("run", F.lit("process_count").alias("metric"), F.lit("values").alias("series"), "sample_idx", "time_diff", "value")
    time = F.col("metric").isin("user_time", "kernel_time")
    kept = timed(counters.busiest(rows, n, own)).withColumn("value", F.when(time, F.col("value") / ticks).otherwise(F.col("value")))
    return finished(partly_rates(kept, ~time).unionByName(count))


def perf_stat(raw: DataFrame, metrics: dict[str, str], events: list[str]) -> DataFrame:
    """Metrics by formula for each CPU and over all, with the share of time that the counters ran."""
    rows = counters.scheduled(snapshots.counters(raw))
    values = counters.scaled(rows)
    used = lambda formula: [e for e in events if e in formula]
    out = [counters.metric(values, name, formula, used(formula)) for name, formula in metrics.items()]
    ran = counters.schedule_rates(rows).join(raw.select("run", "sample_idx", "ts"), ["run", "sample_idx"])
    ran = ran.select("run", "sample_idx", "ts", F.lit("mux_counter_schedule_rate").alias("metric"), F.when(F.col("cpu").isNull(), "Aggregate").otherwise(F.concat(F.lit("CPU"), "cpu")).alias("series"), F.col("percent").alias("value"))
    for more in out:
        ran = ran.unionByName(more.select(*ran.columns))
    return finished(timed(ran).withColumn("is_aggregate", F.col("series") == "Aggregate"))


def perf_stat_legacy(raw: DataFrame) -> DataFrame:
    return finished(timed(counters.legacy_ratio(text.legacy_counters(raw))))


def self_stats(raw: DataFrame) -> DataFrame:
    """Snapshots with a map ``stats`` of series -> metric -> value: gauges, and their sum as series ``total``."""
    rows = raw.select("run", "sample_idx", "ts", F.explode("stats").alias("series", "m")).select("run", "sample_idx", "ts", "series", F.explode("m").alias("metric", "value"))
    return finished(ts.with_aggregate(timed(rows), "sum", "total"))


def self_stats_of_log(records: DataFrame) -> DataFrame:
    """The recorder's own log: ``stats`` by metric and series, or in older ones ``counts`` by ``metric-series``, where print stands for write and a key of one part for both; gauges and their sum as series ``total``."""
    keys = ("run", "sample_idx", "ts")
    if "stats" in records.columns:
        rows = records.select(*keys, F.explode("stats").alias("metric", "m")).select(*keys, "metric", F.explode("m").alias("series", "value"))
    else:
        parts = F.split("key", "-")
        series = F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
        rows = records.select(*keys, F.explode("counts").alias("key", "n")).select(*keys, F.get(parts, F.lit(0)).alias("metric"), F.when(series == "print", "write").otherwise(series).alias("series"), F.col("n").cast("double").alias("value"))
    return finished(ts.with_aggregate(timed(rows), "sum", "total"))


#: Sources by name; a source of one's own is one more entry.
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cpu_utilization": cpu_utilization, "vmstat": vmstat, "diskstats": diskstats, "interrupts": interrupts, "meminfo": meminfo, "netstat": netstat, "numastat": numastat, "ena_stat": ena_stat, "efa_stat": efa_stat,
    "memalloc": memalloc, "processes": processes, "perf_stat_legacy": perf_stat_legacy, "self_stats": self_stats,
}


def points(raw: DataFrame) -> DataFrame:
    """All sources of raw(data_name, run, sample_idx, ts, payload) that are known and text, as points with data_name."""
    out = None
    for name, source in SOURCES.items():
        if name not in ("memalloc", "self_stats"):
            rows = source(raw.where(F.col("data_name") == name).drop("data_name")).withColumn("data_name", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    return out
