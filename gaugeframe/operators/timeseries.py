"""Time series: rates of counters, aggregate series, statistics, ranges, comparison of runs.

All operators work on the long table points(run, metric, series, sample_idx, time_diff, value, is_aggregate). What goes along a series (rates, differences, trend,
spikes, positions) is scanned in blocks (blocks.Scan), so no task holds a series; what concerns a whole metric (statistics, zeros, ranges) is added up in the map tasks,
and no task holds a metric. Aggregates add up in the map tasks before they shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.functions.expr import ratio, round2, tenths_text
from gaugeframe.operators.blocks import SERIES, WIDTH, Scan

STATS = ("avg", "std", "min", "max", "p50", "p90", "p99", "p99_9")
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}


def rates(points: DataFrame, keep_first: bool = False) -> DataFrame:
    """Counters as rates a second. A decrease or a stalled clock drops the point, and the next one is taken against
    the dropped value; the first point is 0, or its own value with ``keep_first``."""
    out = Scan(points).neighbours(_v=("value", -1), _t=("time_diff", -1)).done()
    first = F.col("value") if keep_first else F.lit(0.0)
    rate = F.when(F.col("_v").isNull(), first).otherwise(F.try_divide(F.col("value") - F.col("_v"), F.col("time_diff") - F.col("_t")))
    return out.where("_v is null or (value >= _v and time_diff > _t)").withColumn("value", rate).select(*points.columns)


def decreases(points: DataFrame) -> DataFrame:
    """How often each counter fell."""
    return Scan(points).neighbours(_v=("value", -1)).rows.groupBy(*SERIES).agg(F.count_if(F.col("_v") > F.col("value")).alias("decreases"))


def with_aggregate(points: DataFrame, how: str = "average", name: str | None = None) -> DataFrame:
    """Adds one aggregate series for each metric: at each snapshot the average or sum over the series that are there. A metric of one series gets none."""
    value = {"average": F.avg, "sum": F.sum}[how]("value")
    total = points.groupBy("run", "metric", "sample_idx").agg(F.min("time_diff").alias("time_diff"), value.alias("value"))
    many = points.groupBy("run", "metric").agg(F.countDistinct("series").alias("_n")).where("_n > 1").drop("_n")
    total = total.join(many, ["run", "metric"], "left_semi").withColumns({"series": F.lit(name or how), "is_aggregate": F.lit(True)})
    return points.withColumn("is_aggregate", F.lit(False)).unionByName(total)


#: Parts of a doubling of values that count as one cell.
CELLS = 256


def _cell(value: Column) -> Column:
    """A number of cells that never falls as the value rises: of the sign and the logarithm, 0 for 0, NaN last."""
    size = F.floor((F.log2(F.abs(value)) + 1100) * CELLS)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value == 0, F.lit(0).cast("long")).otherwise(F.when(value > 0, size).otherwise(-size))


def digest(values: DataFrame, by: list[str]) -> DataFrame:
    """How often each ``value`` occurs in each group: ``by``, cell, value, n. Statistics come from it exactly; stored by run, a new run's is added without reading the others again."""
    return values.groupBy(*by, _cell(F.col("value")).alias("cell"), "value").agg(F.count("value").alias("n"))


def merged(digests: list[DataFrame], by: list[str]) -> DataFrame:
    """One digest of several, of other runs or of parts of the same groups."""
    every = reduce(DataFrame.unionByName, digests)
    return every.groupBy(*by, "cell", "value").agg(F.sum("n").alias("n"))


def statistics_of(digest_: DataFrame, by: list[str]) -> DataFrame:
    """The eight statistics of each group of a digest: population deviation, nearest-rank percentiles (the value at floor(q x n), counted from 0).

    Values are counted up inside their cell; a row for each cell gives the counts before it, the mean and the spread. So a task sorts the values of a cell or the cells of
    a group, never a group, and percentiles are exact.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    cells, rising = Window.partitionBy("_g", "cell"), Window.unboundedPreceding
    rows = digest_.select(group.alias("_g"), "cell", "value", "n")
    rows = rows.withColumns({"upto": F.sum("n").over(cells.orderBy("value").rowsBetween(rising, 0)), "low": F.min("value").over(cells)})
    off = (F.col("value") - F.col("low")) * F.col("n")  # little, so squares lose no digits
    of_cell = rows.groupBy("_g", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("value").alias("high"), F.sum(off).alias("_s"), F.sum(off * (F.col("value") - F.col("low"))).alias("_q"))
    whole = Window.partitionBy("_g")
    of_cell = of_cell.withColumns({"all": F.sum("n").over(whole), "before": F.coalesce(F.sum("n").over(whole.orderBy("cell").rowsBetween(rising, -1)), F.lit(0)), "mean": F.col("low") + F.try_divide("_s", "n")})
    of_cell = of_cell.withColumn("avg", F.try_divide(F.sum(F.col("mean") * F.col("n")).over(whole), F.col("all")))
    away = F.col("mean") - F.col("avg")
    spread = F.greatest(F.col("_q") - F.try_divide(F.col("_s") * F.col("_s"), "n"), F.lit(0.0)) + F.col("n") * away * away
    std = F.sqrt(F.try_divide(F.sum(spread), F.max("all")))
    rank = {p: F.floor(F.col("all") * q) - F.col("before") for p, q in QUANTILES.items()}
    at = [F.max(F.when((r >= 0) & (r < F.col("n")), F.struct(F.lit(p).alias("of"), "cell", r.alias("rank")))) for p, r in rank.items()]
    known = of_cell.groupBy("_g").agg(F.max("avg").alias("avg"), std.alias("std"), F.min("low").alias("min"), F.max("high").alias("max"), F.array(*at).alias("at"))
    wanted = known.withColumn("at", F.explode_outer(F.array_compact("at"))).select("_g", "avg", "std", "min", "max", "at.*")
    found = wanted.join(rows.select("_g", "cell", "value", "upto"), ["_g", "cell"], "left")
    value = lambda p: F.min(F.when((F.col("of") == p) & (F.col("upto") > F.col("rank")), F.col("value"))).alias(p)
    return found.groupBy("_g", "avg", "std", "min", "max").agg(*map(value, QUANTILES)).select(*[F.col("_g")[c].alias(c) for c in by], *STATS)


def statistics(values: DataFrame, by: list[str]) -> DataFrame:
    """The eight statistics of ``value`` for each group, by way of a digest."""
    return statistics_of(digest(values, by), by)


def largest_series(points: DataFrame) -> DataFrame:
    """For each metric the series with the greatest average above 0 (the first by name among equals, and where none is above 0)."""
    avg = points.groupBy(*SERIES).agg(F.avg("value").alias("avg"))
    order = Window.partitionBy("run", "metric").orderBy(F.greatest(F.col("avg"), F.lit(0.0)).desc(), "series")
    return avg.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def value_range(points: DataFrame, by: list[str]) -> DataFrame:
    low, high = F.greatest(F.lit(0), F.floor(F.min("value"))), F.greatest(F.lit(0), F.ceil(F.max("value")))
    return points.groupBy(*by).agg(low.cast("long").alias("range_lo"), high.cast("long").alias("range_hi"))


def squeeze_zeros(points: DataFrame, stats_series: str | None = None) -> DataFrame:
    """Where a metric is 0 throughout, only the first and the last point of each series stay. With ``stats_series``, that series alone decides, and
    what stays is set to 0."""
    own = points if stats_series is None else points.where(F.col("series") == stats_series)
    zero = own.groupBy("run", "metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).where("_lo = 0 and _hi = 0").select("run", "metric")
    rest = points.join(zero, ["run", "metric"], "left_anti")
    dull = points.join(zero, ["run", "metric"], "left_semi")
    ends = dull.groupBy(*SERIES).agg(F.min("sample_idx").alias("_lo"), F.max("sample_idx").alias("_hi"))
    dull = dull.join(ends, SERIES).where("sample_idx in (_lo, _hi)").drop("_lo", "_hi")
    dull = dull if stats_series is None else dull.withColumn("value", F.lit(0.0))
    return rest.unionByName(dull.select(*rest.columns))


def between(points: DataFrame, begin: int | None, end: int | None, duration: Column | None = None) -> DataFrame:
    """Points in an inclusive range of seconds; negative bounds count back from the duration, else from the series' last time."""
    back = any(x is not None and x < 0 for x in (begin, end))
    out = Scan(points).greatest(_a="time_diff").done() if back and duration is None else points.withColumn("_a", duration if back else F.lit(0))
    bound = lambda x: F.greatest(F.lit(0), F.col("_a") + x) if x < 0 else F.lit(x)
    out = out if begin is None else out.where(F.col("time_diff") >= bound(begin))
    out = out if end is None else out.where(F.col("time_diff") <= bound(end))
    return out.select(*points.columns)


def long_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.unpivot(by, list(STATS), "stat", "value")


def deltas(stats: DataFrame, base_run: str) -> DataFrame:
    """Each run's statistics against the base run's: raw and relative difference; ``percent`` is of the signed base, two decimals, 100 from a base of 0.
    Statistics that did not move are left out."""
    tall = long_stats(stats, ["run", "metric"])
    base = tall.where(F.col("run") == base_run).select("metric", "stat", F.col("value").alias("base"))
    out = tall.where(F.col("run") != base_run).join(base, ["metric", "stat"])
    percent = F.when(F.abs("base") > 1e-10, F.try_divide(F.col("value") - F.col("base"), F.col("base")) * 100).when(F.abs("value") > 1e-10, 100.0).otherwise(0.0)
    out = out.withColumn("_percent", percent).where("_percent <> 0")
    return out.select("run", "metric", "stat", "value", "base", (F.col("value") - F.col("base")).alias("diff"), ratio(F.col("value"), F.col("base")).alias("ratio"), round2(F.col("_percent")).alias("percent"))


def page_of_deltas(deltas_: DataFrame, offset: int = 0, limit: int = 50, least_percent: float = 0.0) -> DataFrame:
    """A page of ``deltas``, the largest relative ones first."""
    rows = deltas_.where(F.abs("percent") >= least_percent)
    return rows.orderBy(F.abs("percent").desc(), "run", "metric", "stat").offset(offset).limit(limit)


def scored_deltas(stats: DataFrame, base_run: str, descriptions: DataFrame) -> DataFrame:
    """Each run's statistics against the base run's, relative where the base is above 0, else raw, with ``good``: 1 where the change goes in the metric's ``desired``
    direction ('higher' or 'lower' in descriptions(metric, desired)), -1 where it goes against it, 0 where it is neither, for deviations and without a description."""
    tall = long_stats(stats, ["run", "metric"])
    base = tall.where(F.col("run") == base_run).select("metric", "stat", F.col("value").alias("base"))
    delta = F.when(F.col("base") > 0, F.try_divide(F.col("value") - F.col("base"), F.col("base"))).otherwise(F.col("value") - F.col("base"))
    rows = tall.where(F.col("run") != base_run).join(base, ["metric", "stat"]).withColumn("delta", delta).join(descriptions, "metric", "left")
    sign = F.when(F.col("desired") == "higher", F.signum("delta")).when(F.col("desired") == "lower", -F.signum("delta")).otherwise(0.0)
    return rows.withColumn("good", F.when(F.col("stat") == "std", 0.0).otherwise(sign).cast("int")).select("run", "metric", "stat", "value", "base", "delta", "good")


def by_delta(scored: DataFrame) -> DataFrame:
    """The largest changes upwards first; a change from a base of 0 counts as boundless."""
    bound = F.when(F.col("base") == 0, F.when(F.col("delta") > 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("delta"))
    return scored.orderBy(bound.desc(), F.desc("delta"), "run", "metric", "stat")


def downsample(points: DataFrame, buckets: int = 50) -> DataFrame:
    """At most ``buckets`` equal runs of points for each series, with average, least and greatest value."""
    out = Scan(points).placed().rows
    b = F.least(F.col("_n"), F.lit(buckets))
    bucket = F.floor((F.col("_k") * b - 1) / F.col("_n")).cast("int")  # the last b with floor(b n / B) < k
    return out.withColumn("bucket", bucket).groupBy(*SERIES, "bucket").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def trend(points: DataFrame) -> DataFrame:
    """The mean of the first and the last tenth of each series (one point at least) and the change in percent of the signed first mean: under 2 either way it
    is stable, as it is from a first mean of 0.001 or less in size."""
    return _trend(Scan(points).placed().rows)


def _trend(placed: DataFrame) -> DataFrame:
    tenth = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    mean = lambda some: F.avg(F.when(some, F.col("value")))
    out = placed.groupBy(*SERIES).agg(mean(F.col("_k") <= tenth).alias("first"), mean(F.col("_k") > F.col("_n") - tenth).alias("last"))
    percent = F.when(F.abs("first") > 0.001, (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100).otherwise(0.0)
    return out.withColumn("percent", percent).withColumn("trend", F.when(F.abs("percent") < 2, "stable").when(F.col("percent") > 0, "rising").otherwise("falling"))


def _excursions(placed: DataFrame) -> Scan:
    """Points of Scan.placed("value") above mean + 2 deviations (_spike) and below mean - 2 deviations, 0 at least (_drop, where the deviation is above 0.001)."""
    out = Scan(placed)
    spike = F.col("value") > F.col("_avg") + 2 * F.col("_std")
    drop = (F.col("value") < F.greatest(F.col("_avg") - 2 * F.col("_std"), F.lit(0.0))) & (F.col("_std") > 0.001)
    out.rows = out.rows.withColumns({"_spike": spike.cast("int"), "_drop": drop.cast("int")})
    return out


def _closed(placed: DataFrame) -> DataFrame:
    return closed_runs(_excursions(placed))


def closed_runs(scan: Scan) -> DataFrame:
    """kind, number (from 1), begin, end, peak of the runs of points with _spike or _drop set (1, else 0) that another point closes; ``end`` is that point's time."""
    kinds = ("spike", "drop")
    scan = scan.neighbours(**{f"_was_{k}": (f"_{k}", -1) for k in kinds})
    was = {k: F.coalesce(f"_was_{k}", F.lit(0)) for k in kinds}
    scan.running(**{f"_no_{k}": ((F.col(f"_{k}") == 1) & (was[k] == 0)).cast("int") for k in kinds})
    part = lambda k: F.when((F.col(f"_{k}") == 1) | (was[k] == 1), F.struct(F.lit(k).alias("kind"), F.col(f"_no_{k}").alias("number"), (F.col(f"_{k}") == 1).alias("inside")))
    rows = scan.rows.select(*SERIES, "time_diff", "value", F.explode(F.filter(F.array(*map(part, kinds)), lambda x: x.isNotNull())).alias("x")).select(*SERIES, "time_diff", "value", "x.*")
    own = lambda c: F.when(F.col("inside"), F.col(c))
    peak = F.when(F.col("kind") == "spike", F.max(own("value"))).otherwise(F.min(own("value")))
    runs = rows.groupBy(*SERIES, "kind", "number").agg(F.min(own("time_diff")).alias("begin"), F.max(F.when(~F.col("inside"), F.col("time_diff"))).alias("end"), peak.alias("peak"))
    return runs.where("end is not null")


def spikes(points: DataFrame) -> DataFrame:
    """Runs of points above mean + 2 deviations that a lower point closes: begin, that point's time, and peak."""
    return _closed(Scan(points).placed("value").rows).where("kind = 'spike'").select(*SERIES, "begin", "end", "peak")


def drops(points: DataFrame) -> DataFrame:
    """Runs of points below mean - 2 deviations (0 at least) that a higher point closes, where the deviation is above 0.001: begin, that point's time, and trough."""
    return _closed(Scan(points).placed("value").rows).where("kind = 'drop'").select(*SERIES, "begin", "end", F.col("peak").alias("trough"))


def anomalies(points: DataFrame, most: int = 5) -> DataFrame:
    """Of each series the first ``most`` spikes, then drops, in the order of time: place (from 1), kind, begin, end, peak (trough of a drop)."""
    return _anomalies(Scan(points).placed("value").rows, most)


def _anomalies(placed: DataFrame, most: int) -> DataFrame:
    few = _closed(placed).where(F.col("number") <= most)  # so many of each kind at most
    order = Window.partitionBy(*SERIES).orderBy(F.desc("kind"), "number")
    return few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(*SERIES, "place", "kind", "begin", "end", "peak")


def summary(points: DataFrame, most: int = 5) -> DataFrame:
    """A row for each series: statistics, first and last tenth, trend, numbers of its spikes and drops among the first ``most`` anomalies, and these as text."""
    placed = Scan(points).placed("value").rows
    said = F.concat(F.col("kind"), F.format_string(" t=%ds-%ds (", "begin", "end"), F.when(F.col("kind") == "spike", "peak ").otherwise("trough "), tenths_text(F.col("peak")), F.lit(")"))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    found = _anomalies(placed, most).withColumn("said", said).groupBy(*SERIES).agg(count("spike"), count("drop"), F.array_sort(F.collect_list(F.struct("place", "said"))).alias("said"))
    found = found.withColumn("anomalies", F.array_join(F.transform("said", lambda x: x["said"]), "; ")).drop("said")
    return statistics(points, SERIES).join(_trend(placed), SERIES).join(found, SERIES, "left").na.fill(0, ["spikes", "drops"]).na.fill("", ["anomalies"])


def delta_runs(points: DataFrame) -> DataFrame:
    """Differences of neighbours, two decimals, run-length encoded: position of the run, difference, length."""
    scan = Scan(points).neighbours(_v=("value", -1))
    scan.rows = scan.rows.withColumn("delta", round2(F.col("value") - F.col("_v"))).where("delta is not null")
    scan.neighbours(_d=("delta", -1)).running(run_no=F.coalesce((F.col("delta") != F.col("_d")).cast("int"), F.lit(1)))
    return scan.rows.groupBy(*SERIES, "run_no").agg(F.first("delta").alias("delta"), F.count("*").alias("n"))


def last_of_each_second(points: DataFrame) -> DataFrame:
    """Of snapshots (``ms``) that follow within half a second, the last."""
    rows = Scan(points, "ms", ("sample_idx",), width=1000 * WIDTH).neighbours(_n=("ms", 1)).done()
    return rows.where("_n is null or floor((_n - ms + 500) / 1000) <> 0").select(*points.columns)


def since_start(points: DataFrame, start_ms: Column) -> DataFrame:
    """Seconds since ``start_ms``; before the first record at or after it, time stands still at 0."""
    begun = F.col("ms") >= start_ms
    return points.withColumn("time_diff", F.when(begun, F.floor((F.col("ms") - start_ms + 500) / 1000)).otherwise(0).cast("long"))


def statistics_of_aggregate(points: DataFrame) -> DataFrame:
    """Statistics of each metric's aggregate series; of the first series by name where a metric has none."""
    series = points.groupBy("run", "metric").agg(F.min(F.struct((~F.col("is_aggregate")).alias("plain"), "series")).alias("_s"))
    own = points.join(series.select("run", "metric", F.col("_s.series").alias("series")), ["run", "metric", "series"], "left_semi")
    return statistics(own, ["run", "metric"])


def without_single_aggregates(points: DataFrame) -> DataFrame:
    """Metrics of two series lose the aggregate: it says what the other says."""
    n = points.groupBy("run", "metric").agg(F.count_distinct("series").alias("_n")).where("_n = 2").select("run", "metric", F.lit(True).alias("_two"))
    return points.join(n, ["run", "metric"], "left").where("not (is_aggregate and coalesce(_two, false))").drop("_two")


def common_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The least and greatest bounds over all runs."""
    return ranges.groupBy(*by).agg(F.min("range_lo").alias("range_lo"), F.max("range_hi").alias("range_hi"))


def quotient(points: DataFrame, above: str, below: str, name: str) -> DataFrame:
    """A metric from two others, by series and snapshot: ``above`` over ``below``, 0 where that is 0 or missing, as long as one of them is there."""
    pick = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    rows = points.where(F.col("metric").isin(above, below)).groupBy("run", "series", "sample_idx").agg(F.min("time_diff").alias("time_diff"), pick(above).alias("_a"), pick(below).alias("_b"))
    value = F.when(F.col("_b") > 0, F.col("_a") / F.nullif("_b", F.lit(0.0))).otherwise(0.0)
    return rows.select("run", F.lit(name).alias("metric"), "series", "sample_idx", "time_diff", value.alias("value"))


def remainder(points: DataFrame, whole: str, part: str, name: str) -> DataFrame:
    """A metric from two others: ``whole`` less ``part``, where a snapshot has both."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    rows = points.where(F.col("metric").isin(whole, part)).groupBy("run", "series", "sample_idx").agg(F.min("time_diff").alias("time_diff"), (pick(whole) - pick(part)).alias("value"))
    return rows.where("value is not null").select("run", F.lit(name).alias("metric"), "series", "sample_idx", "time_diff", "value")


def with_processes(own: DataFrame, processes: DataFrame, pids: DataFrame, total: str = "total") -> DataFrame:
    """``own`` with the series ``pid_name`` of the processes whose pid is in pids(run, pid), and ``total`` added up anew over all series at each second."""
    pid = F.split_part("series", F.lit("_"), F.lit(1)).try_cast("long")
    more = processes.withColumn("pid", pid).join(pids.select("run", "pid"), ["run", "pid"], "left_semi").drop("pid")
    rows = own.where(F.col("series") != total).unionByName(more.select(*own.columns))
    sums = rows.groupBy("run", "metric", "time_diff").agg(F.sum("value").alias("value"), F.min("sample_idx").alias("sample_idx")).withColumn("series", F.lit(total))
    return rows.unionByName(sums.select(*[F.col(c) if c in sums.columns else F.lit(True).alias(c) for c in own.columns]))


def positional_average(points: DataFrame) -> DataFrame:
    """Of each metric the average of the i-th points of all its series, as many as the first series by name has, at that one's times."""
    at = Scan(points).placed().rows.withColumn("k", F.col("_k") - 1)
    first = at.groupBy("run", "metric").agg(F.min("series").alias("series"))
    times = at.join(first, SERIES, "left_semi").select("run", "metric", "k", "time_diff")
    return at.groupBy("run", "metric", "k").agg(F.avg("value").alias("value")).join(times, ["run", "metric", "k"])


def matching(points: DataFrame, pattern: str) -> DataFrame:
    """Points of the metrics in whose name the regular expression is found."""
    return points.where(F.col("metric").rlike(pattern))


def visible(points: DataFrame, cpus: tuple[int, ...] = (), aggregate: bool = True) -> DataFrame:
    """Series of the chosen CPUs, the series Aggregate if asked for, and all that are neither."""
    cpu = F.regexp_extract("series", r"^CPU(\d+)$", 1)
    return points.where(F.when(F.col("series") == "Aggregate", F.lit(aggregate)).when(cpu != "", cpu.isin(*map(str, cpus))).otherwise(True))


def moving_metrics(stats: DataFrame) -> DataFrame:
    """Metrics with a least or greatest value other than 0 in any run."""
    return stats.groupBy("metric").agg(F.bool_or((F.col("min") != 0) | (F.col("max") != 0)).alias("_any")).where("_any").select("metric")


def durations(runs: DataFrame) -> DataFrame:
    """Seconds from start to end of each run; null where either is missing or they are one."""
    return runs.select("run", F.nullif(F.floor((F.col("end_ms") - F.col("start_ms")) / 1000), F.lit(0)).alias("duration"))


def wall_clock(runs: DataFrame, bound: int) -> DataFrame:
    """A bound in seconds as a moment of each run: from its start, or back from its end if negative."""
    return runs.select("run", F.greatest(F.lit(0), F.col("start_ms" if bound >= 0 else "end_ms") + bound * 1000).alias("ms"))


def parse_range(text: str) -> tuple[str, int | None, int | None]:
    """(run, from, to) of RUN=FROM:TO, either bound optional."""
    run, equals, span = text.rpartition("=")
    begin, colon, end = span.partition(":")
    if not (run and equals and colon):
        raise ValueError(f"not RUN=FROM:TO: {text}")
    return run, int(begin) if begin else None, int(end) if end else None


def check_ranges(ranges: list[tuple[str, int | None, int | None]], runs: list[str]) -> dict[str, tuple[int | None, int | None]]:
    """Ranges by run; an unknown run, a second range of a run, and bounds of one sign in the wrong order are errors."""
    out: dict[str, tuple[int | None, int | None]] = {}
    for run, begin, end in ranges:
        if run not in runs:
            raise ValueError(f"unknown run: {run}")
        if run in out:
            raise ValueError(f"two ranges for {run}")
        if begin is not None and end is not None and (begin < 0) == (end < 0) and begin > end:
            raise ValueError(f"{begin} comes after {end}")
        out[run] = (begin, end)
    return out


def ordered_metrics(stats: DataFrame, preferred: tuple[str, ...] = (), by_average: bool = False) -> DataFrame:
    """run, metric and place: the preferred metrics in their order, the others by falling average or by name."""
    listed = F.array_position(F.array(*[F.lit(m) for m in preferred]) if preferred else F.array().cast("array<string>"), F.col("metric"))
    order = [F.when(listed == 0, len(preferred) + 1).otherwise(listed), *([F.desc("avg")] if by_average else []), "metric"]
    return stats.select("run", "metric", (F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1).alias("place"))


def merged_order(orders: list[list[str]]) -> list[str]:
    """One order of names that agrees with all given ones (of several, the least name goes first); where they contradict each other, the names as
    they first come. Names only: as many as there are metrics."""
    import heapq

    after: dict[str, set[str]] = {x: set() for names in orders for x in names}
    for names in orders:
        for x, y in zip(names, names[1:], strict=False):
            after[x].add(y)
    waits = dict.fromkeys(after, 0)
    for names in after.values():
        for x in names:
            waits[x] += 1
    ready, out = [x for x, n in waits.items() if not n], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for x in after[out[-1]]:
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(ready, x)
    return out if len(out) == len(after) else list(after)


def first_seen_order(metrics: DataFrame) -> DataFrame:
    """metric and place over all runs: names in the order of (run's number, place in the run), each once."""
    first = metrics.groupBy("metric").agg(F.min(F.struct("run_no", "place")).alias("_f"))
    return first.select("metric", (F.row_number().over(Window.orderBy("_f", "metric")) - 1).alias("place"))  # a row for each metric


def combined(points: DataFrame, metric: str, most: int = 200) -> DataFrame:
    """A metric's series of all runs side by side, named run:series; of more than ``most`` the first by name."""
    rows = points.where(F.col("metric") == metric).withColumn("series", F.concat_ws(":", "run", "series"))
    kept = rows.select("series").distinct().orderBy("series").limit(most)
    return rows.join(F.broadcast(kept), "series", "left_semi").select("series", "time_diff", "value")


def cpu_count(points: DataFrame) -> DataFrame:
    """CPUs of each run: series named CPU and a number in the first metric by name that has one."""
    rows = points.where(F.lower("series").rlike(r"^cpu\d+$")).groupBy("run", "metric").agg(F.count_distinct("series").alias("cpus"))
    return rows.groupBy("run").agg(F.min_by("cpus", "metric").alias("cpus"))


def metric_counts(points: DataFrame, by: str = "data_name") -> DataFrame:
    return points.groupBy(by).agg(F.count_distinct("metric").alias("metrics"))


def run_length_text(points: DataFrame) -> DataFrame:
    """The deltas of each series as text: three or more equal ones as ``dxN``, others one by one, joined by commas."""
    runs = delta_runs(points)
    number = F.regexp_replace(F.format_string("%.2f", "delta"), r"\.?0+$", "")
    part = F.when(F.col("n") >= 3, F.concat(number, F.lit("x"), "n")).otherwise(F.array_join(F.array_repeat(number, F.col("n").cast("int")), ","))
    rows = runs.select(*SERIES, "run_no", part.alias("part"))
    return rows.groupBy(*SERIES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "part"))), lambda x: x["part"]), ",").alias("text"))
