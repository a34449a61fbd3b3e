"""Queries of series tools, findings, profiles, joins, key-values and hot spots, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import expr
from gaugeframe.operators import answers, hotspots, joins, keyvalues, profile, rules
from gaugeframe.operators import timeseries as ts
from gaugeframe.plans.queries import EXCURSIONS, SCORE, P, S, change, number, points, query, rounded, samples, stats, table
from gaugeframe.sinks import report
from gaugeframe.sources import binary, jvm, kernel_config, runs, snapshots, text

W = "PARTITION BY run, metric, series"


def daily(spark, d) -> DataFrame:
    """Revenue by day as one series a run and order priority."""
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    first = o.agg(F.min("day")).scalar()
    keys = [F.concat(F.lit("run"), F.col("o_custkey") % 2).alias("run"), F.lit("revenue").alias("metric"), F.col("o_orderpriority").alias("series"), F.datediff("day", first).cast("long").alias("sample_idx")]
    rows = o.groupBy(*keys).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return rows.withColumn("time_diff", F.col("sample_idx") * 60).select("run", "metric", "series", "sample_idx", "time_diff", "value")


Y = """y AS (SELECT 'run' || (o_custkey % 2) AS run, 'revenue' AS metric, o_orderpriority AS series, date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) AS sample_idx,
date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) * 60 AS time_diff, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"""
@query(f"""WITH {Y}, z AS (SELECT * REPLACE (1e7 - value AS value) FROM y), {EXCURSIONS.format(source="z")} SELECT run, metric, series, "begin", "end", round(peak, 6) AS trough FROM er WHERE kind = 'drop'""")
def ts_drops(spark, d):
    return rounded(ts.drops(daily(spark, d).withColumn("value", 1e7 - F.col("value"))))


M = "m AS (SELECT 'run' || (user_id % 2) AS run, event_type AS metric, 'all' AS series, event_id AS sample_idx, epoch_us(ts) // 1000 AS ms, value FROM events)"


def moments(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("run"), F.col("user_id") % 2).alias("run"), F.col("event_type").alias("metric"), F.lit("all").alias("series"), F.col("event_id").alias("sample_idx"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


@query(f"WITH {M}, n AS (SELECT * REPLACE (ms // 1000000 * 400 AS ms) FROM m), l AS (SELECT *, lead(ms) OVER ({W} ORDER BY ms, sample_idx) AS nx FROM n) SELECT run, metric, sample_idx, ms, value FROM l WHERE nx IS NULL OR (nx - ms + 500) // 1000 <> 0")
def ts_last_of_each_second(spark, d):
    rows = moments(spark, d).withColumn("ms", F.floor(F.col("ms") / 1000000) * 400)
    return ts.last_of_each_second(rows).drop("series")


@query(f"WITH {M}, s AS (SELECT min(ms) + 864000000 AS t FROM m), g AS (SELECT *, max(CASE WHEN ms >= t THEN 1 ELSE 0 END) OVER ({W} ORDER BY ms, sample_idx) AS begun FROM m, s) SELECT run, metric, sample_idx, CASE WHEN begun = 1 THEN greatest(0, (ms - t + 500) // 1000) ELSE 0 END AS time_diff, value FROM g")
def ts_gate(spark, d):
    rows = moments(spark, d)
    return ts.since_start(rows, rows.agg(F.min("ms") + 864000000).scalar()).drop("series", "ms")


HOURLY = f"""{P}, a AS (SELECT run, metric, sample_idx, min(time_diff) AS time_diff, avg(value) AS value FROM h GROUP BY ALL)"""
STAT_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ts.STATS)


def ranked_stats(source: str, by: str) -> str:
    """SQL of the eight statistics of a table by some columns."""
    ranks = ", ".join(f"max(CASE WHEN k = floor(n * {q}) THEN value END) AS {p}" for p, q in ts.QUANTILES.items())
    return f"(SELECT {by}, avg(value) AS avg, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, {ranks} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source}) GROUP BY {by})"


@query(f"WITH {HOURLY} SELECT run, metric, {STAT_COLUMNS} FROM {ranked_stats('a', 'run, metric')}")
def ts_statistics_of_aggregate(spark, d):
    return rounded(ts.statistics_of_aggregate(ts.with_aggregate(points(spark, d, hourly=True))))


@query(f"WITH {P} SELECT run, metric, series, {STAT_COLUMNS} FROM {ranked_stats('p', 'run, metric, series')}")
def ts_statistics_by_series(spark, d):
    return rounded(ts.statistics(points(spark, d), ["run", "metric", "series"]))


@query(f"""WITH {P}, q AS (SELECT run, metric, CASE WHEN metric = 'click' THEN 'one' ELSE 's' || (sample_idx % 3) END AS series, sample_idx, value FROM h),
u AS (SELECT run, metric, series, sample_idx, sum(value) AS value, false AS is_aggregate FROM q GROUP BY ALL UNION ALL SELECT run, metric, 'sum', sample_idx, sum(value), true FROM q GROUP BY ALL)
SELECT run, metric, series, sample_idx, round(value, 6) AS value, is_aggregate FROM u WHERE NOT (is_aggregate AND metric = 'click')""")
def ts_without_single_aggregates(spark, d):
    q = points(spark, d, hourly=True).withColumn("series", F.when(F.col("metric") == "click", "one").otherwise(F.concat(F.lit("s"), F.col("sample_idx") % 3)))
    own = q.groupBy("run", "metric", "series", "sample_idx").agg(F.sum("value").alias("value")).withColumn("is_aggregate", F.lit(False))
    all_ = q.groupBy("run", "metric", "sample_idx").agg(F.sum("value").alias("value")).withColumns({"series": F.lit("sum"), "is_aggregate": F.lit(True)})
    return rounded(ts.without_single_aggregates(own.unionByName(all_)))


@query(f"WITH {P}, v AS (SELECT run, metric, greatest(0, floor(min(value)))::BIGINT AS lo, greatest(0, ceil(max(value)))::BIGINT AS hi FROM p GROUP BY ALL) SELECT metric, min(lo) AS range_lo, max(hi) AS range_hi FROM v GROUP BY metric")
def ts_common_ranges(spark, d):
    return ts.common_ranges(ts.value_range(points(spark, d), ["run", "metric"]), ["metric"])


@query(f"""WITH {Y}, own AS (SELECT run, metric, 'disk' AS series, sample_idx, time_diff, value FROM y WHERE series = '1-URGENT'), proc AS (SELECT run, metric, left(series, 1) || '_' || substr(series, 3) AS series, sample_idx, time_diff, value FROM y WHERE series <> '1-URGENT'),
u AS (SELECT * FROM own UNION ALL SELECT * FROM proc WHERE (run, split_part(series, '_', 1)) IN (('run0', '2'), ('run1', '2'), ('run1', '3')))
SELECT run, metric, series, sample_idx, time_diff, round(value, 6) AS value FROM u UNION ALL SELECT run, metric, 'total', min(sample_idx), time_diff, round(sum(value), 6) FROM u GROUP BY run, metric, time_diff""")
def ts_with_processes(spark, d):
    y = daily(spark, d)
    own = y.where("series = '1-URGENT'").withColumn("series", F.lit("disk"))
    own = own.unionByName(own.withColumn("series", F.lit("total")))
    proc = y.where("series <> '1-URGENT'").withColumn("series", F.replace("series", F.lit("-"), F.lit("_")))
    pids = spark.sql("SELECT * FROM VALUES ('run0', 2L), ('run1', 2L), ('run1', 3L) AS t(run, pid)")
    return rounded(ts.with_processes(own, proc, pids))


@query(f"""WITH {Y}, k AS (SELECT *, row_number() OVER ({W} ORDER BY sample_idx) - 1 AS k FROM y), t AS (SELECT run, metric, k, time_diff FROM k WHERE series = '1-URGENT')
SELECT t.run, t.metric, t.k, t.time_diff, round(avg(value), 6) AS value FROM k JOIN t ON k.run = t.run AND k.metric = t.metric AND k.k = t.k GROUP BY ALL""")
def ts_positional_average(spark, d):
    return rounded(ts.positional_average(daily(spark, d)).select("run", "metric", "k", "time_diff", "value"))


C = "c AS (SELECT 'run' || (l_orderkey % 2) AS run, l_returnflag AS metric, CASE WHEN l_linenumber = 7 THEN 'Aggregate' WHEN l_linenumber = 6 THEN 'disk' ELSE 'CPU' || (l_linenumber + 7) END AS series, l_orderkey AS time_diff, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def by_cpu(spark, d) -> DataFrame:
    n = F.col("l_linenumber")
    series = F.when(n == 7, "Aggregate").when(n == 6, "disk").otherwise(F.concat(F.lit("CPU"), n + 7))
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("run"), F.col("l_orderkey") % 2).alias("run"), F.col("l_returnflag").alias("metric"), series.alias("series"), F.col("l_orderkey").alias("time_diff")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {C} SELECT run, metric, series, time_diff, value FROM c WHERE regexp_matches(metric, '^[AN]') AND (series IN ('CPU9', 'CPU10', 'disk'))")
def ts_visible(spark, d):
    return ts.visible(ts.matching(by_cpu(spark, d), "^[AN]"), (9, 10), aggregate=False)


@query(f"WITH {C} SELECT run, count(DISTINCT series) AS cpus FROM c WHERE metric = 'A' AND series LIKE 'CPU%' GROUP BY run")
def ts_cpu_count(spark, d):
    return ts.cpu_count(by_cpu(spark, d))


@query(f"WITH {C}, k AS (SELECT * FROM c WHERE metric = 'R'), s AS (SELECT DISTINCT run || ':' || series AS s FROM k ORDER BY s LIMIT 9) SELECT run || ':' || series AS series, time_diff, value FROM k WHERE run || ':' || series IN (SELECT s FROM s)")
def ts_combined(spark, d):
    return ts.combined(by_cpu(spark, d), "R", 9)


@query(f"WITH {C} SELECT run, count(DISTINCT metric) AS metrics FROM c GROUP BY run")
def ts_metric_counts(spark, d):
    return ts.metric_counts(by_cpu(spark, d), "run")


@query(f"WITH {P}, s AS (SELECT run, metric, min(CASE WHEN metric = 'click' THEN 0 ELSE value END) AS lo, max(CASE WHEN metric = 'click' THEN 0 ELSE value END) AS hi FROM p GROUP BY ALL) SELECT metric FROM s GROUP BY metric HAVING bool_or(lo <> 0 OR hi <> 0)")
def ts_moving_metrics(spark, d):
    still = points(spark, d).withColumn("value", F.when(F.col("metric") == "click", 0.0).otherwise(F.col("value")))
    return ts.moving_metrics(ts.statistics(still, ["run", "metric"]))


@query(f"WITH {P} SELECT run, metric, (row_number() OVER (PARTITION BY run ORDER BY CASE metric WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, avg DESC, metric) - 1)::BIGINT AS place FROM (SELECT run, metric, round(avg(value), 9) AS avg FROM p GROUP BY ALL)")
def ts_ordered_metrics(spark, d):
    avg = points(spark, d).groupBy("run", "metric").agg(F.round(F.avg("value"), 9).alias("avg"))
    return ts.ordered_metrics(avg, ("purchase", "click"), by_average=True).withColumn("place", F.col("place").cast("long"))


@query("""WITH n AS (SELECT n_regionkey AS run_no, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place, right(n_name, 1) AS metric FROM nation), f AS (SELECT metric, min((run_no, place)) AS f FROM n GROUP BY metric)
SELECT metric, (row_number() OVER (ORDER BY f, metric) - 1)::BIGINT AS place FROM f""")
def ts_first_seen_order(spark, d):
    n = table(spark, d, "nation")
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = n.select(F.col("n_regionkey").alias("run_no"), place.alias("place"), F.right("n_name", F.lit(1)).alias("metric"))
    return ts.first_seen_order(rows).withColumn("place", F.col("place").cast("long"))


R = """r AS (SELECT 'run' || user_id AS run, min(epoch_us(ts) // 1000) AS start_ms, max(epoch_us(ts) // 1000) AS end_ms FROM events GROUP BY user_id)"""


def user_runs(spark, d) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.concat(F.lit("run"), "user_id").alias("run")).agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"))


@query(f"WITH {R} SELECT run, nullif((end_ms - start_ms) // 1000, 0) AS duration, start_ms + 60000 AS begin, end_ms - 60000 AS \"end\" FROM r")
def run_durations(spark, d):
    r = user_runs(spark, d)
    return ts.durations(r).join(ts.wall_clock(r, 60).withColumnRenamed("ms", "begin"), "run").join(ts.wall_clock(r, -60).withColumnRenamed("ms", "end"), "run")


@query(f"""WITH {P}, q AS (SELECT * REPLACE (CAST(floor(value / 40) AS DOUBLE) AS value) FROM p), x AS (SELECT *, (value - lag(value) OVER ({W} ORDER BY sample_idx))::INT AS delta FROM q),
y AS (SELECT *, CASE WHEN delta = lag(delta) OVER ({W} ORDER BY sample_idx) THEN 0 ELSE 1 END AS new FROM x WHERE delta IS NOT NULL), z AS (SELECT *, sum(new) OVER ({W} ORDER BY sample_idx) AS no FROM y),
g AS (SELECT run, metric, series, no, min(delta) AS delta, count(*) AS n FROM z GROUP BY ALL)
SELECT run, metric, series, string_agg(CASE WHEN n >= 3 THEN delta || 'x' || n WHEN n = 2 THEN delta || ',' || delta ELSE delta || '' END, ',' ORDER BY no) AS text FROM g GROUP BY ALL""")
def ts_run_length_text(spark, d):
    return ts.run_length_text(points(spark, d).withColumn("value", F.floor(F.col("value") / 40).cast("double")))


DELTA = f"""WITH {P}, u AS (UNPIVOT (SELECT * FROM st) ON avg, std, min, max, p50, p90, p99, p99_9 INTO NAME stat VALUE value), j AS (SELECT o.run, o.metric, o.stat, o.value, b.value AS base FROM u o JOIN u b ON o.metric = b.metric AND o.stat = b.stat WHERE o.run <> 'run0' AND b.run = 'run0')"""


@query(f"""{DELTA}, p2 AS (SELECT *, round((CASE WHEN abs(base) > 1e-10 THEN (value - base) / base * 100 WHEN abs(value) > 1e-10 THEN 100 ELSE 0 END) * 100) / 100 AS percent FROM j)
SELECT run, metric, stat, percent FROM p2 WHERE abs(percent) >= 1 ORDER BY abs(percent) DESC, run, metric, stat LIMIT 10 OFFSET 2""")
def deltas_page(spark, d):
    return ts.page_of_deltas(ts.deltas(stats(spark, d), "run0"), 2, 10, 1.0).select("run", "metric", "stat", "percent")


@query(f"""{DELTA}, s AS (SELECT *, CASE WHEN base > 0 THEN (value - base) / base ELSE value - base END AS delta FROM j)
SELECT run, metric, stat, round(value, 6) AS value, round(base, 6) AS base, round(delta, 6) AS delta, (CASE WHEN stat = 'std' THEN 0 WHEN metric = 'purchase' THEN sign(delta) WHEN metric = 'click' THEN -sign(delta) ELSE 0 END)::INT AS good FROM s""")
def deltas_scored(spark, d):
    wished = spark.sql("SELECT * FROM VALUES ('purchase', 'higher'), ('click', 'lower') AS t(metric, desired)")
    return rounded(ts.by_delta(ts.scored_deltas(stats(spark, d), "run0", wished)))


@query(f"""WITH {P}, c AS (SELECT a.run, a.avg AS v, b.avg AS b, CASE WHEN a.avg = b.avg THEN 0 WHEN b.avg = 0 THEN 1 ELSE (a.avg - b.avg) / b.avg END AS c FROM st a JOIN st b ON a.run = b.run AND a.metric = 'click' AND b.metric = 'purchase')
SELECT run, 'click' AS key, 'Clicks' AS rule_name, round({SCORE.format(v="c", t="-0.9", s="-2")}, 6) AS score, 'The average in click (' || {number("v")} || ') is ' || {change("c")} || ' purchase (' || {number("b")} || ').' AS description, '' AS message FROM c WHERE c >= -0.9""")
def rule_metric_comparison(spark, d):
    return rounded(rules.MetricComparison("Clicks", "purchase", "click", "avg", ">=", -0.9, -2).findings(stats(spark, d)))


KV = """kv AS (SELECT n_name AS run, c_mktsegment AS grp, 'status' AS key, CASE WHEN avg(c_acctbal) > 4500 THEN 'rich' ELSE 'poor' END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' OR n_nationkey % 3 > 0 GROUP BY ALL),
runs AS (SELECT n_name AS run FROM nation), own AS (SELECT run, arg_min(value, grp) AS value FROM kv WHERE grp = 'BUILDING' GROUP BY run)"""


def nation_kv(spark, d) -> tuple[DataFrame, DataFrame]:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).where("c_mktsegment <> 'BUILDING' or n_nationkey % 3 > 0")
    kv = rows.groupBy(F.col("n_name").alias("run"), F.col("c_mktsegment").alias("grp")).agg(F.when(F.avg("c_acctbal") > 4500, "rich").otherwise("poor").alias("value")).withColumn("key", F.lit("status"))
    return n.select(F.col("n_name").alias("run")), kv


@query(f"WITH {KV} SELECT run, 'status' AS key, 'Rich' AS rule_name, -2.0::DOUBLE AS score, CASE WHEN value IS NULL THEN 'The key status in ' || run || ' is missing, instead of being set to rich' ELSE 'The value of status in ' || run || ' is \"' || value || '\", instead of \"rich\".' END AS description, '' AS message FROM runs LEFT JOIN own USING (run) WHERE value IS DISTINCT FROM 'rich'")
def rule_key_expected(spark, d):
    run, kv = nation_kv(spark, d)
    return rules.KeyExpected("Rich", "status", "rich", -2).findings(run, kv.where("grp = 'BUILDING'"))


@query(f"""WITH {KV}, base AS (SELECT run AS base, value AS b FROM own WHERE run = (SELECT n_name FROM nation WHERE n_nationkey = 1)) SELECT run, 'status' AS key, 'Same' AS rule_name, -256.0::DOUBLE AS score,
CASE WHEN value IS NULL THEN 'The key status does not exist in ' || run || ', while its value in ' || base || ' is "' || b || '".' ELSE 'The value of status in ' || run || ' ("' || value || '") is different from ' || base || ' ("' || b || '").' END AS description, '' AS message
FROM runs LEFT JOIN own USING (run), base WHERE run <> (SELECT n_name FROM nation WHERE n_nationkey = 1) AND value IS DISTINCT FROM b""")
def rule_key_comparison(spark, d):
    run, kv = nation_kv(spark, d)
    base = table(spark, d, "nation").where("n_nationkey = 1").first()["n_name"]
    return rules.KeyComparison("Same", "status", -256).findings(run, kv.where("grp = 'BUILDING'"), base)


ST = S.replace("1 AS n FROM customer", "c_custkey % 4 AS state, c_nationkey % 2 AS prof, 1 AS n FROM customer")


def stated(spark, d) -> DataFrame:
    """Customers as stacks with states of threads and profilers."""
    return samples(spark, d).withColumns({"thread_state": (F.col("block") % 4).cast("int"), "profiler": F.concat(F.lit("p"), F.col("block") % 3)})


@query(f"""WITH {ST}, q AS (SELECT run, 'p' || (block % 3) AS key, sum(n) AS every, sum(n) FILTER (WHERE regexp_matches(f1, '^A') AND (regexp_matches(f2, '^B') OR regexp_matches(f3, '^B')) OR regexp_matches(f2, '^A') AND regexp_matches(f3, '^B')) AS x, sum(n) FILTER (WHERE regexp_matches(f1, '^E') OR regexp_matches(f2, '^E') OR regexp_matches(f3, '^E')) AS y FROM s WHERE state > 0 GROUP BY ALL)
SELECT run, key, 'Stacks' AS rule_name, -16.0::DOUBLE AS score, 'Stack pattern [A.*, B.*], [E.*] accounts for ' || printf('%.2f', (coalesce(x, 0) + coalesce(y, 0)) * 100.0 / every) || '% of samples in all profiles (threshold: 5.00%)' AS description, '' AS message FROM q WHERE (coalesce(x, 0) + coalesce(y, 0)) * 100.0 / every >= 5""")
def rule_stack_threshold(spark, d):
    return rules.StackThreshold("Stacks", (("A.*", "B.*"), ("E.*",)), 5.0, -16).findings(stated(spark, d))


META = """md AS (SELECT 'run' || c_nationkey AS run, CASE WHEN c_nationkey > 2 THEN c_mktsegment ELSE 'BUILDING' END AS profiler, CASE WHEN min(c_custkey) % 3 = 0 THEN NULL ELSE 'v' || (min(c_custkey) % 2) END AS value FROM customer GROUP BY ALL), mk AS (SELECT * FROM md WHERE value IS NOT NULL)"""


def profiler_metadata(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment")).otherwise("BUILDING"))
    low = F.min("c_custkey")
    return rows.groupBy(F.concat(F.lit("run"), "c_nationkey").alias("run"), F.col("c_mktsegment").alias("profiler")).agg(F.when(low % 3 == 0, None).otherwise(F.concat(F.lit("v"), low % 2)).alias("value")).withColumn("key", F.lit("version"))


@query(f"WITH {META} SELECT run, profiler AS key, 'Version' AS rule_name, -2.0::DOUBLE AS score, CASE WHEN value IS NULL THEN 'Event type ''g'' field ''version'' not found in profile data' ELSE 'Event type ''g'' field ''version'' in ' || profiler || ' should match pattern ''1$'', found: \"' || value || '\"' END AS description, '' AS message FROM md WHERE value IS NULL OR NOT regexp_matches(value, '1$')")
def rule_metadata_expected(spark, d):
    m = profiler_metadata(spark, d)
    return rules.MetadataExpected("Version", "version", "1$", -2, group="g").findings(m.select("run", "profiler"), m.where("value is not null"))


@query(f"""WITH {META}, runs AS (SELECT DISTINCT run FROM md), n AS (SELECT run, count(*) AS n, min(value) AS v, min(profiler) AS only FROM mk GROUP BY run), b AS (SELECT * FROM mk WHERE run = 'run4'), bn AS (SELECT * FROM n WHERE run = 'run4'),
one AS (SELECT n.run, n.only AS key, 'Event type '''' field ''version'' in ' || n.run || ' for ''' || n.only || ''' ("' || n.v || '") differs from run4 for ''' || bn.only || ''' ("' || bn.v || '")' AS said FROM n, bn WHERE n.run <> 'run4' AND n.n = 1 AND bn.n = 1 AND n.v <> bn.v), many AS (SELECT r.run, b.profiler AS key, CASE WHEN m.value IS NULL THEN 'Event type '''' field ''version'' not found in ' || r.run || ' for ''' || b.profiler || ''', while its value in run4 is "' || b.value || '"' ELSE 'Event type '''' field ''version'' in ' || r.run || ' for ''' || b.profiler || ''' ("' || m.value || '") differs from run4 ("' || b.value || '")' END AS said FROM runs r LEFT JOIN n USING (run) CROSS JOIN bn JOIN b ON true LEFT JOIN mk m ON m.run = r.run AND m.profiler = b.profiler WHERE r.run <> 'run4' AND NOT (coalesce(n.n, 0) = 1 AND bn.n = 1) AND (m.value IS NULL OR m.value <> b.value)),
lacks AS (SELECT 'run4' AS run, 'Versions' AS key, 'Event type '''' field ''version'' not found in run run4.' AS said WHERE NOT EXISTS (SELECT 1 FROM b)) SELECT run, key, 'Versions' AS rule_name, -256.0::DOUBLE AS score, said AS description, '' AS message FROM (SELECT * FROM one UNION ALL SELECT * FROM many UNION ALL SELECT * FROM lacks)""")
def rule_metadata_comparison(spark, d):
    m = profiler_metadata(spark, d)
    return rules.MetadataComparison("Versions", "version", -256).findings(m.select("run").distinct(), m, "run4")


@query(f"""WITH {P}, x AS (SELECT run, metric AS key, 'High' AS rule_name, {SCORE.format(v="p99", t="0.0001", s="-2")} AS score, 'The p99 in ' || run || ' is ' || {number("p99")} || '.' AS description, 'Too high.' AS message FROM st WHERE metric = 'click' AND p99 > 0.0001),
w AS (SELECT run, metric AS key, 'Large' AS rule_name, arg_max({SCORE.format(v="value", t="50", s="1")}, (abs({SCORE.format(v="value", t="50", s="1")}), series, time_diff)) AS score, '' AS description, '' AS message FROM p WHERE regexp_matches(metric, 'c') AND value > 50 GROUP BY run, metric)
SELECT 'events' AS data_name, run, key, rule_name, round(score, 6) AS score, description, message FROM (SELECT * FROM x UNION ALL SELECT * FROM w) WHERE score < 0 AND contains(lower(rule_name), 'hig') ORDER BY score""")
def findings_chosen(spark, d):
    facts = rules.Facts(points(spark, d).select("run").distinct(), "run0", stats=stats(spark, d), points=points(spark, d))
    found = rules.run_rules([rules.StatThreshold("High", "click", "p99", ">", 0.0001, -2, message="Too high."), rules.PointThreshold("Large", "c", ">", 50, 1), rules.KeyExpected("No facts", "k", "v", 1)], facts)
    return rounded(rules.worst_first(rules.chosen(found.withColumn("data_name", F.lit("events")), ("events",), "poor", "HIG")).select("data_name", "run", "key", "rule_name", "score", "description", "message"))


@query(f"WITH {ST} SELECT run, coalesce(sum(n) FILTER (WHERE state > 0), 0)::BIGINT AS samples FROM s GROUP BY run")
def profile_total_samples(spark, d):
    return profile.total_samples(stated(spark, d))


@query(f"WITH {S}, c AS (SELECT run, block // 20 AS cell, sum(n)::BIGINT AS samples FROM s GROUP BY ALL) SELECT run, cell, samples, round(samples / max(samples) OVER (PARTITION BY run), 6) AS heat FROM c")
def profile_heat(spark, d):
    return rounded(profile.heat(samples(spark, d), 20))


@query(f"""WITH {S}, f AS (SELECT run, f1 AS frame, n, 0 AS self FROM s UNION ALL SELECT run, f2, n, 0 FROM s UNION ALL SELECT run, f3, n, n FROM s), fs AS (SELECT run, frame, sum(n) AS total, sum(self) AS self FROM f GROUP BY ALL), e AS (SELECT run, sum(n) AS every FROM s GROUP BY run)
SELECT run, frame, self::BIGINT AS self, total::BIGINT AS total, round(self * 100.0 / every, 6) AS self_percent, round(total * 100.0 / every, 6) AS total_percent FROM fs JOIN e USING (run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY self DESC, frame) <= 7""")
def profile_top_functions(spark, d):
    return rounded(profile.top_functions(samples(spark, d), 7))


@query(f"WITH {S} SELECT run, count(*) AS nodes, sum(self)::BIGINT AS samples FROM g WHERE regexp_matches(split_part(node, ';', -1), '^[BM]') GROUP BY run")
def profile_search(spark, d):
    return profile.search(profile.nodes(samples(spark, d)), "^[BM]")


BACK = """t AS (SELECT run, f3 AS node, n, 0 AS self FROM s UNION ALL SELECT run, f3 || ';' || f2, n, 0 FROM s UNION ALL SELECT run, f3 || ';' || f2 || ';' || f1, n, n FROM s), g AS (SELECT run, node, sum(n)::BIGINT AS total, sum(self)::BIGINT AS self FROM t GROUP BY ALL)"""


@query(f"WITH {S.split('t AS (')[0]} {BACK} SELECT * FROM g")
def profile_callers(spark, d):
    return profile.nodes(samples(spark, d), backward=True).withColumn("node", F.concat_ws(";", "node"))


@query(f"""WITH {S}, e AS (SELECT run, sum(n) AS every FROM s GROUP BY run), q AS (SELECT run, node, split_part(node, ';', -1) AS name, total AS samples, total * 100.0 / every AS percent, len(string_split(node, ';')) - 1 AS depth FROM g JOIN e USING (run))
SELECT run, name, samples, round(percent, 6) AS percent, depth::INT AS depth, CASE WHEN depth = 0 THEN '-' ELSE string_split(node, ';')[depth] END AS parent FROM q WHERE percent >= 0.5 AND regexp_matches(name, '[AE]') ORDER BY percent DESC, run, node LIMIT 20""")
def profile_flame_top(spark, d):
    return rounded(profile.flame_top(profile.flame(samples(spark, d)), 20, 0.5, "[AE]"))


SHARE = """f AS (SELECT 'run' || (c_custkey % 3) AS run, n_name AS frame, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> c_nationkey % 5 GROUP BY ALL), h AS (SELECT run, frame, n * 100.0 / sum(n) OVER (PARTITION BY run) AS share FROM f),
o AS (SELECT DISTINCT run FROM f WHERE run <> 'run0'), k AS (SELECT run, frame FROM h WHERE run <> 'run0' UNION SELECT o.run, b.frame FROM o, h b WHERE b.run = 'run0'),
x AS (SELECT k.run, k.frame, coalesce(h.share, 0) AS share, coalesce(b.share, 0) AS base_share FROM k LEFT JOIN h ON h.run = k.run AND h.frame = k.frame LEFT JOIN h b ON b.run = 'run0' AND b.frame = k.frame)"""


def nation_frames(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).where("c_custkey % 3 <> c_nationkey % 5")
    return rows.groupBy(F.concat(F.lit("run"), F.col("c_custkey") % 3).alias("run"), F.col("n_name").alias("frame")).agg(F.count("*").alias("self"))


@query(f"WITH {SHARE} SELECT run, frame, round(share, 6) AS share, round(base_share, 6) AS base_share, round(share - base_share, 6) AS delta FROM x")
def profile_difference(spark, d):
    return rounded(profile.difference(nation_frames(spark, d), "run0"))


@query(f"WITH {SHARE} SELECT run, frame, round(share - base_share, 6) AS delta FROM x ORDER BY abs(round(share - base_share, 6)) DESC, run, frame LIMIT 9")
def profile_largest_differences(spark, d):
    return profile.largest_differences(rounded(profile.difference(nation_frames(spark, d), "run0")), 9).select("run", "frame", "delta")


@query(f"""WITH {S}, e AS (SELECT run, sum(n) AS every FROM s GROUP BY run), q AS (SELECT run, node, total, total * 100.0 / every AS percent FROM g JOIN e USING (run)), b AS (SELECT * FROM q WHERE run = 'run0'),
x AS (SELECT q.run, q.node, q.total - coalesce(b.total, 0) AS samples, q.percent - coalesce(b.percent, 0) AS points FROM q LEFT JOIN b USING (node) WHERE q.run <> 'run0') SELECT run, node, samples, round(points, 6) AS points, round(points / max(abs(points)) OVER (PARTITION BY run), 6) AS normal FROM x""")
def profile_against_base(spark, d):
    return rounded(profile.against_base(profile.nodes(samples(spark, d)), "run0").withColumn("node", F.concat_ws(";", "node")))


KINDS = "['_[0]', '_[j]', '_[i]', '_[k]', '_[1]', '']"


@query(f"""WITH q AS (SELECT n_name || {KINDS}[1 + n_nationkey % 6] AS frame, n_name, n_nationkey FROM nation) SELECT frame, ['interpreted', 'compiled', 'inlined', 'kernel', 'c1', 'native'][1 + n_nationkey % 6] AS kind, n_name AS plain,
greatest(n_nationkey * 100 - (1007 - 1007 % 20), 0) // 20 AS block FROM q""")
def profile_frame_kinds(spark, d):
    n = table(spark, d, "nation")
    ending = F.element_at(F.array(*[F.lit(x) for x in ("_[0]", "_[j]", "_[i]", "_[k]", "_[1]", "")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    frame = F.concat("n_name", ending)
    return n.select(frame.alias("frame"), profile.frame_kind(frame).alias("kind"), profile.plain_name(frame).alias("plain"), profile.block_of((F.col("n_nationkey") * 100).cast("long"), F.lit(1007)).alias("block"))


@query("SELECT (o_orderkey * 7) || '|' || o_custkey || '|' || o_orderstatus || ';' || o_orderpriority AS line FROM orders")
def profile_stack_text(spark, d):
    o = table(spark, d, "orders")
    return profile.stack_text(o.select((F.col("o_orderkey") * 7).alias("ms"), F.col("o_custkey").alias("pid"), F.array("o_orderstatus", "o_orderpriority").alias("path")))


FR = "fr AS (SELECT 'r' || (p_partkey % 2) AS run, (p_partkey % 3) * 15 AS depth, (p_partkey * 37 % 500)::DOUBLE AS x, ((3 - p_partkey % 3) * p_size)::DOUBLE AS w, p_name || p_partkey AS name FROM part)"


@query(f"WITH {FR} SELECT f.run, f.depth, f.x, f.w, f.name, coalesce(arg_min(p.name, (p.x, p.name)), '-') AS parent FROM fr f LEFT JOIN fr p ON p.run = f.run AND p.depth = CASE WHEN f.depth >= 15 THEN f.depth - 15 ELSE f.depth + 15 END AND p.x <= f.x AND p.x + p.w >= f.x + f.w GROUP BY ALL")
def join_enclosing(spark, d):
    k = F.col("p_partkey")
    frames = table(spark, d, "part").select(F.concat(F.lit("r"), k % 2).alias("run"), (k % 3 * 15).alias("depth"), (k * 37 % 500).cast("double").alias("x"), ((3 - k % 3) * F.col("p_size")).cast("double").alias("w"), F.concat("p_name", k).alias("name"))
    return joins.enclosing(frames)


@query("""WITH s AS (SELECT p_size % 5 AS pid, p_partkey * 20 AS start, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 30 END AS size, p_name || p_partkey AS name FROM part), e AS (SELECT *, CASE WHEN size > 0 THEN start + size ELSE coalesce(lead(start) OVER (PARTITION BY pid ORDER BY start), 4611686018427387904::BIGINT) END AS until FROM s),
a AS (SELECT l_linenumber % 5 AS pid, l_partkey * 20 + l_suppkey AS address, l_orderkey, l_linenumber FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, a.address, CASE WHEN a.address < e.until THEN e.name END AS symbol FROM a ASOF LEFT JOIN e ON a.pid = e.pid AND a.address >= e.start""")
def join_symbols(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    symbols = p.select((F.col("p_size") % 5).alias("pid"), (F.col("p_partkey") * 20).alias("start"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(30).alias("size"), F.concat("p_name", "p_partkey").alias("name"))
    addresses = l.select((F.col("l_linenumber") % 5).alias("pid"), (F.col("l_partkey") * 20 + F.col("l_suppkey")).alias("address"), "l_orderkey", "l_linenumber")
    return joins.symbolized(addresses, symbols, ["pid"]).drop("pid")


@query("""SELECT o.o_orderkey AS id, r_name || '.' || n_name || '_[j];' || c_mktsegment || '.' || c_name || '_[0]' AS path, CASE o_orderstatus WHEN 'F' THEN 'cpu' WHEN 'O' THEN 'wall' ELSE NULL END AS kind, (o_orderkey * 13 + 5) * 1000 // 7 AS ms
FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def jvm_stacks(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    event = F.when(F.col("o_orderstatus") == "F", "jdk.ExecutionSample").when(F.col("o_orderstatus") == "O", "jdk.NativeMethodSample").otherwise("other")
    run = F.lit("run").alias("run")
    events = o.select(run, F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("trace"), event.alias("event"), (F.col("o_orderkey") * 13).alias("ticks"))
    frame = lambda m, k: F.struct(m.alias("method"), F.lit(k).alias("kind"))
    traces = c.select(run, F.col("c_custkey").alias("trace"), F.array(frame(F.concat(F.lit("c"), "c_custkey"), "Interpreted"), frame(F.concat(F.lit("n"), "c_nationkey"), "JIT compiled")).alias("frames"))
    methods = c.select(run, F.concat(F.lit("c"), "c_custkey").alias("method"), F.col("c_mktsegment").alias("class"), F.col("c_name").alias("name")).unionByName(n.select(run, F.concat(F.lit("n"), "n_nationkey").alias("method"), F.col("n_regionkey").cast("string").alias("class"), F.col("n_name").alias("name")))
    classes = c.select(run, F.col("c_mktsegment").alias("class"), F.col("c_mktsegment").alias("name")).distinct().unionByName(r.select(run, F.col("r_regionkey").cast("string").alias("class"), F.col("r_name").alias("name")))
    out = jvm.stacks(events, traces, methods, classes)
    return out.select("id", F.concat_ws(";", "path").alias("path"), "kind", jvm.milliseconds(F.col("ticks"), F.lit(-5), F.lit(7)).alias("ms"))


@query("""SELECT c_nationkey::VARCHAR AS run, c_custkey AS pid, CASE WHEN k = 0 THEN c_mktsegment ELSE c_mktsegment || ' (' || k || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer)""")
def jvm_numbered_names(spark, d):
    return jvm.numbered_names(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("run"), F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("name")))


@query("SELECT r_name AS run, left(n_name, 1) AS event, string_agg(n_name || ': ' || n_nationkey, chr(10) ORDER BY n_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jvm_settings(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return jvm.settings(rows.select(F.col("r_name").alias("run"), F.left("n_name", F.lit(1)).alias("event"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value")))


@query("SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'int' || repeat('[]', n_regionkey + 1) WHEN 1 THEN 'java.lang.' || n_name || repeat('[]', n_regionkey) WHEN 2 THEN 'x.' || n_name ELSE 'boolean[]' END AS class FROM nation")
def jvm_class_names(spark, d):
    k, n = F.col("n_nationkey") % 4, F.col("n_regionkey")
    deep = lambda m: F.repeat(F.lit("["), m)
    name = F.when(k == 0, F.concat(deep(n + 1), F.lit("I"))).when(k == 1, F.concat(deep(n), F.lit("Ljava/lang/"), "n_name", F.lit(";"))).when(k == 2, F.concat(F.lit("x/"), "n_name")).otherwise("[Z")
    return table(spark, d, "nation").select("n_name", jvm.class_name(name).alias("class"))


@query("""SELECT 'run' || n_regionkey AS run, 'p' || n_nationkey AS profiler, 'jdk.JVMInformation' AS grp, unnest(['jvmName', 'jvmVersion']) AS key, unnest([n_name, '' || n_nationkey]) AS value FROM nation""")
def jvm_metadata(spark, d):
    fields = F.create_map(F.lit("jvmName"), F.col("n_name"), F.lit("jvmVersion"), F.col("n_nationkey").cast("string"))
    text = F.to_json(F.create_map(F.lit("jdk.JVMInformation"), fields, F.lit("jdk.Other"), fields))
    return jvm.metadata(table(spark, d, "nation").select(F.concat(F.lit("run"), "n_regionkey").alias("run"), F.concat(F.lit("p"), "n_nationkey").alias("profiler"), text.alias("payload")))


LOAD = """q AS (SELECT l_suppkey AS ino, l_linenumber AS "offset", [0, 8, 9, 10, 11, 12, 14][1 + l_orderkey % 7] AS source, l_partkey % 300 + 60 AS total, CASE WHEN l_orderkey % 50 = 0 THEN 4095 ELSE l_partkey % 20 END AS issue, l_orderkey % 11 AS translation FROM lineitem),
l AS (SELECT *, issue = 4095 AS sat, CASE WHEN source = 0 THEN 0 WHEN source = 8 THEN 1 WHEN source IN (10, 11, 12) THEN 2 ELSE 3 END AS place, CASE WHEN total - issue - translation <= 100 THEN 0 WHEN total - issue - translation <= 200 THEN 1 WHEN total - issue - translation <= 250 THEN 2 ELSE 3 END AS bin FROM q),
lat AS (SELECT ino, "offset", sum(CASE WHEN sat THEN 0 ELSE total END)::BIGINT AS total, sum(CASE WHEN sat THEN 0 ELSE issue END)::BIGINT AS issue, sum(CASE WHEN sat THEN 0 ELSE translation END)::BIGINT AS translation, count(*) FILTER (WHERE sat) AS saturated, count(*) AS count, """ + ", ".join(f"count(*) FILTER (WHERE place = {k // 4} AND bin = {k % 4} AND NOT sat) AS h{k}" for k in range(16)) + """ FROM l GROUP BY ALL)"""


def hot(spark, d) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (0, 8, 9, 10, 11, 12, 14))), (F.col("l_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ino"), F.col("l_linenumber").alias("offset"), code.alias("source"), (F.col("l_partkey") % 300 + 60).alias("total"), F.when(F.col("l_orderkey") % 50 == 0, 4095).otherwise(F.col("l_partkey") % 20).alias("issue"), (F.col("l_orderkey") % 11).alias("translation"))
    return hotspots.latencies(hotspots.loads(rows, (100, 200, 250)), ["ino", "offset"])


@query(f"WITH {LOAD} SELECT * FROM lat")
def hotspot_latencies(spark, d):
    return hot(spark, d).select("ino", "offset", "total", "issue", "translation", "saturated", "count", *[F.get("h", F.lit(k)).alias(f"h{k}") for k in range(16)])


PLACES = [("L1", 0), ("L2", 4), ("L3", 8), ("DRAM", 12)]
SUM = lambda a, n: "(" + " + ".join(f"h{k}" for k in range(a, a + n)) + ")"


@query(f"""WITH {LOAD} SELECT ino, "offset", {", ".join(f"round(coalesce({SUM(a, 4)} * 100.0 / nullif({SUM(0, 16)}, 0), 0), 6) AS {p}" for p, a in PLACES)}, {", ".join(f"round(coalesce(h{a + b} * 100.0 / nullif({SUM(a, 4)}, 0), 0), 6) AS {p}_{b}" for p, a in PLACES for b in range(4))},
round(coalesce(total / nullif(count * 1000, 0), 0), 6) AS mean_total, round(coalesce(issue / nullif(count * 1000, 0), 0), 6) AS mean_issue, round(coalesce(translation / nullif(count * 1000, 0), 0), 6) AS mean_translation FROM lat""")
def hotspot_shares(spark, d):
    return rounded(hotspots.mean_latency(hotspots.shares(hot(spark, d))).drop("h", "total", "issue", "translation", "saturated", "count"))


@query(f"WITH {LOAD} SELECT ino, \"offset\", total - issue - translation AS execution FROM lat ORDER BY total - issue - translation DESC, ino, \"offset\" LIMIT 12")
def hotspot_top_execution(spark, d):
    lat = hot(spark, d)
    top = hotspots.reports(lat, lat.withColumn("mispredicted", F.lit(0)), 12)["execution"]
    return top.select("ino", "offset", (F.col("total") - F.col("issue") - F.col("translation")).alias("execution"))


@query("""SELECT l_partkey AS ino, count(*) AS count, count(*) FILTER (WHERE (l_orderkey & 128) <> 0) AS mispredicted, arg_max(l_linenumber, (l_orderkey, l_linenumber)) AS branch_type, round(count(*) FILTER (WHERE (l_orderkey & 128) <> 0) * 100.0 / count(*), 6) AS percent FROM lineitem GROUP BY l_partkey""")
def hotspot_branches(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ino"), F.col("l_orderkey").alias("events"), F.struct("l_orderkey", "l_linenumber").alias("ts"), F.col("l_linenumber").alias("branch_type"))
    return rounded(hotspots.branches(rows, ["ino"]))


@query("SELECT s_name AS run, '' AS grp, unnest(['Name', 'Nation', 'Balance']) AS key, unnest([s_name, '' || s_nationkey, '' || floor(s_acctbal)::BIGINT]) AS value FROM supplier")
def kv_from_columns(spark, d):
    rows = table(spark, d, "supplier").withColumns({"run": F.col("s_name"), "floor": F.floor("s_acctbal")})
    return keyvalues.from_columns(rows, {"s_name": "Name", "s_nationkey": "Nation", "floor": "Balance"})


@query("SELECT s_name AS run, '' || s_nationkey AS \"Nation\", NULL::VARCHAR AS \"Missing\", s_name AS \"Name\" FROM supplier")
def kv_header(spark, d):
    return keyvalues.header(kv_from_columns(spark, d), ("Nation", "Missing", "Name"))


@query(f"WITH {KV} SELECT lower(grp) AS grp, lower(key) AS key, min(value) FILTER (WHERE run = 'NATION_1') AS \"NATION_1\", min(value) FILTER (WHERE run = 'NATION_3') AS \"NATION_3\" FROM kv GROUP BY ALL")
def kv_side_by_side(spark, d):
    _, kv = nation_kv(spark, d)
    return joins.key_values_side_by_side(kv, ["NATION_1", "NATION_3"])


@query(f"WITH {KV} SELECT grp, key, run, value FROM kv WHERE contains(lower(grp), 'mach') ORDER BY grp, key, run, value LIMIT 10 OFFSET 10")
def kv_search_page(spark, d):
    _, kv = nation_kv(spark, d)
    return keyvalues.page(keyvalues.search(kv, "MaCh").select("grp", "key", "run", "value"), 1, 10)


@query("SELECT n_name, n_nationkey || ',' || (n_regionkey + 100) AS pids, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS x FROM nation")
def kv_merged(spark, d):
    n = table(spark, d, "nation")
    maps = keyvalues.merged(F.create_map(F.lit("x"), F.lit("old"), F.lit("z"), F.lit("z")), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("x"), F.lit("new"))).otherwise(F.create_map(F.lit("y"), F.lit("y"))))
    return n.select("n_name", F.array_join(keyvalues.pids(F.col("n_nationkey").cast("long"), F.array(F.col("n_regionkey").cast("long") + 100, F.col("n_nationkey").cast("long"))).cast("array<string>"), ",").alias("pids"), maps["x"].alias("x"))


@query(f"""WITH q AS (SELECT p_partkey, (p_retailprice - 1200) * pow(10, p_partkey % 9) AS v FROM part) SELECT p_partkey, {number("v")} AS text, {change("v")} AS percent FROM q""")
def expr_number_text(spark, d):
    v = (F.col("p_retailprice") - 1200) * F.pow(F.lit(10.0), F.col("p_partkey") % 9)
    return table(spark, d, "part").withColumn("v", v).select("p_partkey", expr.number_text(F.col("v")).alias("text"), expr.percent_text(F.col("v")).alias("percent"))


@query("SELECT series, (row_number() OVER (ORDER BY n, series) - 1)::INT AS place FROM (SELECT DISTINCT 'CPU' || l_suppkey AS series, l_suppkey AS n FROM lineitem)")
def expr_natural_order(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "lineitem").select(F.concat(F.lit("CPU"), "l_suppkey").alias("series")).distinct()
    return rows.select("series", (F.row_number().over(Window.orderBy(expr.natural_key(F.col("series")))) - 1).alias("place"))


@query("SELECT 'jit' AS run, p_partkey * 4096 AS start, p_size::BIGINT AS size, p_name AS name FROM part UNION ALL SELECT 'kernel', p_partkey * 65536, 0, 'f' || p_partkey FROM part WHERE p_partkey % 4 > 0")
def read_symbol_maps(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    jit = part.select(F.lit("jit").alias("run"), F.concat_ws("\n", F.lit("no symbol here!"), F.concat_ws(" ", F.lower(F.hex(k * 4096)), F.lower(F.hex("p_size")), "p_name")).alias("payload"))
    kind = F.element_at(F.array(*map(F.lit, "dtTw")), (k % 4 + 1).cast("int"))
    kernel = part.select(F.lit("kernel").alias("run"), F.concat(F.lower(F.hex(k * 65536)), F.lit(" "), kind, F.lit(" f"), k, F.lit("\t[module]")).alias("payload"))
    return runs.jit_symbols(jit).unionByName(runs.kernel_symbols(kernel))


@query("SELECT 'r' || n_regionkey AS run, n_name AS name, (n_nationkey * 1234)::BIGINT AS samples, n_nationkey + 0.5::DOUBLE AS pct, n_nationkey * 10.5::DOUBLE AS x, (n_nationkey % 4 * 15)::DOUBLE AS depth, 7.25::DOUBLE AS w FROM nation")
def read_flame_graph(spark, d):
    k = F.col("n_nationkey")
    frame = F.concat(F.lit("<g><title>"), "n_name", F.lit(" ("), F.format_number(k * 1234, 0), F.lit(" samples, "), k + 0.5, F.lit('%)</title><rect x="'), k * 10.5, F.lit('" y="'), k % 4 * 15, F.lit('" width="7.25" height="15"/></g>'))
    svg = table(spark, d, "nation").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("run")).agg(F.concat(F.lit('<svg><g><title>all (9,999 samples, 100%)</title><rect x="0" y="0" width="9"/></g>'), F.array_join(F.collect_list(frame), "\n"), F.lit("</svg>")).alias("svg"))
    return runs.flame_frames(svg)


@query(f"WITH {HOURLY}, u AS (SELECT run, metric, series, sample_idx, time_diff, value, false AS is_aggregate, row_number() OVER ({W} ORDER BY sample_idx, time_diff) - 1 AS k FROM h) SELECT 'events' AS data_name, run, metric, series, k AS sample_idx, time_diff, trunc(value * 100) / 100 AS value, is_aggregate FROM u")
def report_round_trip(spark, d):
    from pyspark.sql.window import Window

    rows = points(spark, d).withColumns({"is_aggregate": F.lit(False), "data_name": F.lit("events")})
    in_time = [F.col(c).asc_nulls_last() for c in ("time_diff", "sample_idx")]  # hours follow from seconds; events of one second by their ids
    rows = rows.withColumn("sample_idx", F.row_number().over(Window.partitionBy(*ts.SERIES).orderBy(*in_time)) - 1)
    numbers = ts.statistics(rows, ["run", "metric"]).withColumn("data_name", F.lit("events"))
    json = report.to_json("time_series", rows, numbers)
    merge = lambda key, what: F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), key, F.lit('":'), what)), ","), F.lit("}"))
    by_run = json.groupBy("data_name", "run").agg(F.concat(F.lit('{"metrics":'), merge("metric", "json"), F.lit("}")).alias("json"))
    whole = by_run.groupBy("data_name").agg(F.concat(F.lit('{"data_name":"events","data_format":"time_series","runs":'), merge("run", "json"), F.lit("}")).alias("json"))
    return runs.points_of(runs.variables(whole.select(F.concat(F.lit("processed_events_data = "), "json", F.lit(";")).alias("value"))))


@query(f"WITH {SHARE.split(', o AS')[0]}, b AS (SELECT run, frame FROM f) SELECT frame, count(DISTINCT run) AS runs FROM b GROUP BY frame")
def names_of_all_runs(spark, d):
    """The union of all runs' function names, each once."""
    f = nation_frames(spark, d)
    one, two = f.where("run = 'run0'").select("run", "frame"), f.where("run <> 'run0'").select("run", "frame")
    return one.union(two).distinct().groupBy("frame").agg(F.count_distinct("run").alias("runs"))


@query(f"""WITH {Y}, {EXCURSIONS.format(source="y")}, k AS (SELECT *, row_number() OVER ({W} ORDER BY sample_idx) AS k, count(*) OVER ({W}) AS n FROM y), t AS (SELECT *, greatest(1, n // 10) AS t FROM k),
tr AS (SELECT run, metric, series, avg(value) FILTER (WHERE k <= t) AS first, avg(value) FILTER (WHERE k > n - t) AS last FROM t GROUP BY ALL), tc AS (SELECT *, CASE WHEN abs(first) > 0.001 THEN (last - first) / first * 100 ELSE 0 END AS c FROM tr),
an AS (SELECT run, metric, series, count(*) FILTER (WHERE kind = 'spike') AS spikes, count(*) FILTER (WHERE kind = 'drop') AS drops,
  string_agg(format('{{}} t={{}}s-{{}}s ({{}} {{:.1f}})', kind, "begin", "end", CASE kind WHEN 'spike' THEN 'peak' ELSE 'trough' END, peak), '; ' ORDER BY place) AS anomalies FROM ea GROUP BY ALL)
SELECT s.run, s.metric, s.series, {STAT_COLUMNS}, round(first, 6) AS first, round(last, 6) AS last, round(c, 6) AS percent, CASE WHEN abs(c) < 2 THEN 'stable' WHEN c > 0 THEN 'rising' ELSE 'falling' END AS trend,
coalesce(an.spikes, 0) AS spikes, coalesce(an.drops, 0) AS drops, coalesce(an.anomalies, '') AS anomalies FROM {ranked_stats('y', 'run, metric, series')} s JOIN tc USING (run, metric, series) LEFT JOIN an USING (run, metric, series)""")
def answer_summary(spark, d):
    return rounded(answers.values(daily(spark, d), "revenue", "summary"))


@query(f"WITH {P} SELECT 'events' AS data_name, metric, count(DISTINCT run) AS runs, count(DISTINCT series) AS series FROM p GROUP BY metric")
def answer_metrics(spark, d):
    return answers.metrics(points(spark, d).withColumn("data_name", F.lit("events")))


@query(f"""WITH {Y}, c AS (SELECT * FROM y WHERE run = 'run1' AND series IN ('1-URGENT', '2-HIGH') AND time_diff BETWEEN 600 AND 60000), k AS (SELECT *, row_number() OVER ({W} ORDER BY sample_idx) - 1 AS k, count(*) OVER ({W}) AS n FROM c),
b AS (SELECT *, CAST(((k + 1) * least(n, 50) - 1) // n AS INTEGER) AS bucket FROM k) SELECT run, metric, series, bucket, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS n FROM b GROUP BY ALL""")
def answer_values(spark, d):
    return rounded(answers.values(daily(spark, d), "revenue", "downsampled", "run1", ("1-URGENT", "2-HIGH"), 600, 60000))


@query(f"WITH {KV}, t AS (SELECT * FROM kv WHERE run IN ('NATION_1', 'NATION_4')), x AS (SELECT grp, key FROM t GROUP BY grp, key HAVING count(DISTINCT value) + CASE WHEN count(DISTINCT run) < 2 THEN 1 ELSE 0 END > 1) SELECT lower(grp) AS grp, lower(key) AS key, min(value) FILTER (WHERE run = 'NATION_1') AS \"NATION_1\", min(value) FILTER (WHERE run = 'NATION_4') AS \"NATION_4\" FROM t WHERE (grp, key) IN (SELECT (grp, key) FROM x) GROUP BY ALL")
def answer_key_values(spark, d):
    _, kv = nation_kv(spark, d)
    return answers.key_values(kv, ["NATION_1", "NATION_4"], differing=True)


@query("""SELECT 'run' || n_regionkey AS run, 'Timers' AS grp, 'CONFIG_' || n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'y' ELSE 'not set' END AS value FROM nation UNION ALL SELECT 'run' || r_regionkey, '', 'CONFIG_TOP', r_name FROM region""")
def source_kernel_config(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("CONFIG_"), "n_name", F.lit("=y"))).otherwise(F.concat(F.lit("# CONFIG_"), "n_name", F.lit(" is not set")))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("CONFIG_TOP="), "r_name", F.lit("\n#\n# Timers\n#\n"), "lines", F.lit("\n# end of Timers\n"))
    return kernel_config.kernel_config(rows.select(F.concat(F.lit("run"), "r_regionkey").alias("run"), text.alias("payload")))


@query("SELECT 'r' || o_custkey % 5 AS run, '' AS grp, o_orderpriority AS key, arg_max(o_orderstatus || o_orderkey, o_orderkey) AS value FROM orders GROUP BY ALL")
def source_settings(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("run"), F.col("o_orderkey").alias("sample_idx"), F.create_map("o_orderpriority", F.concat("o_orderstatus", "o_orderkey")).alias("entries"))
    return snapshots.settings(raw)


@query("SELECT n_name AS run, 'CONFIG_PREEMPT_LAZY' AS key, 'PREEMPT_LAZY Detected' AS rule_name, 0.0::DOUBLE AS score, 'Kernel ' || n_nationkey % 10 || '.1.0 in ' || n_name || ' is running with PREEMPT_LAZY preemption model.' AS description, '' AS message FROM nation WHERE n_nationkey % 10 >= 7 AND n_regionkey % 2 = 0")
def rule_preemption(spark, d):
    n = table(spark, d, "nation")
    row = lambda key, value: n.select(F.col("n_name").alias("run"), F.lit("").alias("grp"), F.lit(key).alias("key"), value.alias("value"))
    kv = row("Kernel Version", F.concat(F.col("n_nationkey") % 10, F.lit(".1.0"))).unionByName(row("CONFIG_PREEMPT_LAZY", F.when(F.col("n_regionkey") % 2 == 0, "y").otherwise("n")))
    return rules.PreemptionRule().findings(kv)


@query("""WITH m AS (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN 'buddyinfo_order_' || l_quantity::INT WHEN 1 THEN 'pagetype_order_' || l_quantity::INT || '_type_' || l_returnflag WHEN 2 THEN 'pageblocks_type_' || l_linestatus || l_quantity::INT WHEN 3 THEN 'slabinfo_' || l_returnflag || l_quantity::INT ELSE 'x' || l_quantity::INT END AS metric FROM lineitem)
SELECT metric, row_number() OVER (ORDER BY CASE WHEN starts_with(metric, 'buddyinfo') THEN 0 WHEN starts_with(metric, 'pagetype') THEN 1 WHEN starts_with(metric, 'pageblocks') THEN 2 WHEN starts_with(metric, 'slabinfo') THEN 3 ELSE 4 END,
regexp_extract(metric, '_type_(.+)$', 1), coalesce(try_cast(regexp_extract(metric, '_order_(\\d+)', 1) AS INT), -1), metric)::INT AS place FROM m""")
def order_of_memory_metrics(spark, d):
    from pyspark.sql.window import Window

    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    name = F.when(k == 0, F.concat(F.lit("buddyinfo_order_"), q)).when(k == 1, F.concat(F.lit("pagetype_order_"), q, F.lit("_type_"), "l_returnflag")).when(k == 2, F.concat(F.lit("pageblocks_type_"), "l_linestatus", q))
    rows = table(spark, d, "lineitem").select(name.when(k == 3, F.concat(F.lit("slabinfo_"), "l_returnflag", q)).otherwise(F.concat(F.lit("x"), q)).alias("metric")).distinct()  # names only
    return rows.select("metric", F.row_number().over(Window.orderBy(text.memory_order(F.col("metric")))).alias("place"))


@query("""SELECT c_nationkey::VARCHAR AS run, 'p' || c_nationkey % 3 AS profiler, c_mktsegment AS profile_type, c_custkey AS block, (c_custkey % 4)::INT AS thread_state, c_mktsegment || ';' || c_name AS path, 2::BIGINT AS count FROM customer""")
def read_stored_profiles(spark, d):
    entry = F.struct(F.col("c_custkey").alias("block"), (F.col("c_custkey") % 4).cast("int").alias("thread_state"), F.array("c_mktsegment", "c_name").alias("path"), F.lit(2).alias("count"))
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.collect_list(entry).alias("s")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "s"))).alias("profiles"))
    texts = rows.select(F.col("c_nationkey").cast("string").alias("run"), F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("profiler"), F.to_json(F.struct(F.lit(5).alias("start_time_ms"), "profiles")).alias("payload"))
    return binary.stored_samples(texts).withColumn("path", F.concat_ws(";", "path"))
