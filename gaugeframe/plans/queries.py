"""Queries of the engine's own operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import expr
from gaugeframe.operators import calltree, counters, joins, profile, rules
from gaugeframe.operators import timeseries as ts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order; six decimals don't."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def points(spark: SparkSession, d: str, hourly: bool = False) -> DataFrame:
    """``events`` as points: two runs by user, a metric for each event type, a series for each user."""
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    start = e.agg(F.min("ms")).scalar()
    p = e.select(F.concat(F.lit("run"), F.col("user_id") % 2).alias("run"), F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("sample_idx"), expr.seconds_since(F.col("ms"), start).alias("time_diff"), "value")
    return p.withColumn("sample_idx", F.floor(F.col("time_diff") / 3600)) if hourly else p


P = """e AS (SELECT 'run' || (user_id % 2) AS run, event_type AS metric, CAST(user_id AS VARCHAR) AS series, event_id AS sample_idx, epoch_us(ts) // 1000 AS ms, value FROM events),
p AS (SELECT run, metric, series, sample_idx, (ms - (SELECT min(ms) FROM e) + 500) // 1000 AS time_diff, value FROM e),
h AS (SELECT run, metric, series, time_diff // 3600 AS sample_idx, time_diff, value FROM p),
l AS (SELECT *, lag(value) OVER w AS pv, lag(time_diff) OVER w AS pt FROM p WINDOW w AS (PARTITION BY run, metric, series ORDER BY sample_idx)),
r AS (SELECT run, metric, series, sample_idx, time_diff, CASE WHEN pv IS NULL THEN 0.0 ELSE (value - pv) / (time_diff - pt) END AS value FROM l WHERE pv IS NULL OR (value >= pv AND time_diff > pt)),
rk AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY run, metric) AS n FROM r),
st AS (SELECT run, metric, avg(value) AS avg, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(CASE WHEN k = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN k = floor(n * 0.9) THEN value END) AS p90,
  max(CASE WHEN k = floor(n * 0.99) THEN value END) AS p99, max(CASE WHEN k = floor(n * 0.999) THEN value END) AS p99_9 FROM rk GROUP BY run, metric)"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    return ts.statistics(ts.rates(points(spark, d)), ["run", "metric"])


@query(f"WITH {P} SELECT run, metric, series, sample_idx, time_diff, round(value, 6) AS value FROM r")
def ts_rates(spark, d):
    return rounded(ts.rates(points(spark, d)))


@query(f"WITH {P} SELECT run, metric, series, count(*) FILTER (WHERE pv > value) AS decreases FROM l GROUP BY ALL")
def ts_decreases(spark, d):
    return ts.decreases(points(spark, d))


@query(f"""WITH {P}, a AS (SELECT run, metric, sample_idx, min(time_diff) AS time_diff, avg(value) AS value FROM h GROUP BY ALL)
SELECT run, metric, series, sample_idx, time_diff, round(value, 6) AS value, false AS is_aggregate FROM h UNION ALL
SELECT run, metric, 'average', sample_idx, time_diff, round(value, 6), true FROM a WHERE (run, metric) IN (SELECT (run, metric) FROM h GROUP BY run, metric HAVING count(DISTINCT series) > 1)""")
def ts_aggregate_average(spark, d):
    return rounded(ts.with_aggregate(points(spark, d, hourly=True)))


@query(f"WITH {P} SELECT run, metric, round(avg, 6) AS avg, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(p99_9, 6) AS p99_9 FROM st")
def ts_statistics(spark, d):
    return rounded(stats(spark, d))


@query(f"""WITH {P}, u AS (UNPIVOT (SELECT * FROM st) ON avg, std, min, max, p50, p90, p99, p99_9 INTO NAME stat VALUE value),
j AS (SELECT o.run, o.metric, o.stat, o.value, b.value AS base FROM u o JOIN u b ON o.metric = b.metric AND o.stat = b.stat WHERE o.run <> 'run0' AND b.run = 'run0')
SELECT run, metric, stat, round(value, 6) AS value, round(base, 6) AS base, round(value - base, 6) AS diff,
round(CASE WHEN value = base THEN 0 WHEN base = 0 THEN 1 ELSE (value - base) / base END, 6) AS ratio,
round(round((CASE WHEN abs(base) > 1e-10 THEN (value - base) / base * 100 WHEN abs(value) > 1e-10 THEN 100 ELSE 0 END) * 100) / 100, 6) AS percent FROM j
WHERE CASE WHEN abs(base) > 1e-10 THEN (value - base) / base * 100 WHEN abs(value) > 1e-10 THEN 100 ELSE 0 END <> 0""")
def ts_run_deltas(spark, d):
    return rounded(ts.deltas(stats(spark, d), "run0"))


@query(f"""WITH {P}, a AS (SELECT run, metric, series, avg(value) AS avg FROM r GROUP BY ALL)
SELECT run, metric, series, round(avg, 6) AS avg FROM a QUALIFY row_number() OVER (PARTITION BY run, metric ORDER BY greatest(avg, 0) DESC, series) = 1""")
def ts_largest_series(spark, d):
    return rounded(ts.largest_series(ts.rates(points(spark, d))))


@query(f"WITH {P} SELECT run, metric, greatest(0, floor(min(value)))::BIGINT AS range_lo, greatest(0, ceil(max(value)))::BIGINT AS range_hi FROM p GROUP BY run, metric")
def ts_value_range(spark, d):
    return ts.value_range(points(spark, d), ["run", "metric"])


@query(f"WITH {P}, z AS (SELECT run, metric, series, sample_idx, time_diff, CASE WHEN metric = 'click' THEN 0.0 ELSE value END AS value FROM p), m AS (SELECT *, min(value) OVER x = 0 AND max(value) OVER x = 0 AS zero, min(sample_idx) OVER s AS lo, max(sample_idx) OVER s AS hi FROM z WINDOW x AS (PARTITION BY run, metric), s AS (PARTITION BY run, metric, series)) SELECT run, metric, series, sample_idx, time_diff, round(value, 6) AS value FROM m WHERE NOT zero OR sample_idx IN (lo, hi)")
def ts_squeeze_zeros(spark, d):
    return rounded(ts.squeeze_zeros(points(spark, d).withColumn("value", F.when(F.col("metric") == "click", 0.0).otherwise(F.col("value")))))


@query(f"WITH {P}, m AS (SELECT *, max(time_diff) OVER (PARTITION BY run, metric, series) AS a FROM p) SELECT run, metric, series, sample_idx, time_diff, value FROM m WHERE time_diff >= greatest(0, a - 864000) AND time_diff <= greatest(0, a - 3600)")
def ts_time_range(spark, d):
    return ts.between(points(spark, d), -864000, -3600)


@query(f"""WITH {P}, k AS (SELECT *, row_number() OVER (PARTITION BY run, metric, series ORDER BY sample_idx) - 1 AS k, count(*) OVER (PARTITION BY run, metric, series) AS n FROM (SELECT * REPLACE ('all' AS series) FROM p)),
b AS (SELECT *, CAST(((k + 1) * least(n, 50) - 1) // n AS INTEGER) AS bucket FROM k) SELECT run, metric, series, bucket, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM b GROUP BY ALL""")
def ts_downsample(spark, d):
    return rounded(ts.downsample(points(spark, d).withColumn("series", F.lit("all"))))


@query(f"""WITH {P}, k AS (SELECT *, row_number() OVER (PARTITION BY run, metric, series ORDER BY sample_idx) AS k, count(*) OVER (PARTITION BY run, metric, series) AS n FROM p), t AS (SELECT *, greatest(1, n // 10) AS t FROM k),
f AS (SELECT run, metric, series, avg(value) FILTER (WHERE k <= t) AS first, avg(value) FILTER (WHERE k > n - t) AS last FROM t GROUP BY ALL), c AS (SELECT *, CASE WHEN abs(first) > 0.001 THEN (last - first) / first * 100 ELSE 0 END AS c FROM f)
SELECT run, metric, series, round(first, 6) AS first, round(last, 6) AS last, round(c, 6) AS percent, CASE WHEN abs(c) < 2 THEN 'stable' WHEN c > 0 THEN 'rising' ELSE 'falling' END AS trend FROM c""")
def ts_trend(spark, d):
    return rounded(ts.trend(points(spark, d)))


#: Runs of high and low points of ``{source}`` by the rules of the summary: a run begins at its first point and ends at the time of the point that closes it; one that is still open at the end doesn't count.
EXCURSIONS = """ex AS (SELECT *, avg(value) OVER w AS av, stddev_pop(value) OVER w AS sd FROM {source} WINDOW w AS (PARTITION BY run, metric, series)),
ey AS (SELECT *, 'spike' AS kind, value > av + 2 * sd AS inside FROM ex UNION ALL SELECT *, 'drop', value < greatest(av - 2 * sd, 0) AND sd > 0.001 FROM ex),
ez AS (SELECT *, coalesce(lag(inside) OVER w, false) AS was FROM ey WINDOW w AS (PARTITION BY run, metric, series, kind ORDER BY sample_idx)),
en AS (SELECT *, sum((inside AND NOT was)::INT) OVER (PARTITION BY run, metric, series, kind ORDER BY sample_idx) AS number FROM ez),
er AS (SELECT run, metric, series, kind, number::BIGINT AS number, min(time_diff) FILTER (WHERE inside) AS "begin", max(time_diff) FILTER (WHERE NOT inside) AS "end", CASE kind WHEN 'spike' THEN max(value) FILTER (WHERE inside) ELSE min(value) FILTER (WHERE inside) END AS peak
  FROM en WHERE inside OR was GROUP BY run, metric, series, kind, number HAVING count(*) FILTER (WHERE NOT inside) > 0),
ea AS (SELECT *, row_number() OVER (PARTITION BY run, metric, series ORDER BY kind DESC, number) AS place FROM er QUALIFY place <= 5)"""


@query(f"""WITH {P}, {EXCURSIONS.format(source="p")} SELECT run, metric, series, "begin", "end", round(peak, 6) AS peak FROM er WHERE kind = 'spike'""")
def ts_spikes(spark, d):
    return rounded(ts.spikes(points(spark, d)))


@query(f"""WITH {P}, a AS (SELECT run, metric, 'all' AS series, sample_idx, time_diff, value FROM p), {EXCURSIONS.format(source="a")} SELECT run, metric, series, place, kind, "begin", "end", round(peak, 6) AS peak FROM ea""")
def ts_anomalies(spark, d):
    return rounded(ts.anomalies(points(spark, d).withColumn("series", F.lit("all"))).withColumn("place", F.col("place").cast("long")))


@query(f"WITH {P} SELECT run, metric, round(avg, 6) AS avg, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, round(p99_9, 6) AS p99_9 FROM st")
def ts_statistics_merged(spark, d):
    """Statistics of all runs from one digest for each run."""
    rows, by = ts.rates(points(spark, d)), ["run", "metric"]
    parts = [ts.digest(rows.where(F.col("run") == r), by) for r in ("run0", "run1")]
    return rounded(ts.statistics_of(ts.merged(parts, by), by))


@query(f"""WITH {P}, q AS (SELECT * REPLACE (CAST(floor(value / 20) AS DOUBLE) AS value) FROM p), x AS (SELECT *, round((value - lag(value) OVER w) * 100) / 100 AS delta FROM q WINDOW w AS (PARTITION BY run, metric, series ORDER BY sample_idx)),
y AS (SELECT *, CASE WHEN delta = lag(delta) OVER w THEN 0 ELSE 1 END AS new FROM x WHERE delta IS NOT NULL WINDOW w AS (PARTITION BY run, metric, series ORDER BY sample_idx)),
z AS (SELECT *, sum(new) OVER (PARTITION BY run, metric, series ORDER BY sample_idx) AS run_no FROM y) SELECT run, metric, series, run_no::BIGINT AS run_no, round(min(delta), 6) AS delta, count(*) AS n FROM z GROUP BY ALL""")
def ts_delta_runs(spark, d):
    return rounded(ts.delta_runs(points(spark, d).withColumn("value", F.floor(F.col("value") / 20).cast("double"))).withColumn("run_no", F.col("run_no").cast("long")))


def cut(x: str) -> str:
    """SQL of a number cut to two decimals, without zeros at its end."""
    return rf"regexp_replace(printf('%.2f', trunc(({x}) * 100) / 100), '\.?0+$', '')"


def number(x: str) -> str:
    """SQL of a number with a unit of thousands."""
    units = " ".join(f"WHEN ({x}) >= {size} THEN {cut(f'({x}) / {size}')} || '{u}'" for size, u in (("1e12", "T"), ("1e9", "G"), ("1e6", "M"), ("1e3", "K")))
    return f"CASE WHEN isnan(({x})::DOUBLE) THEN 'NaN' {units} ELSE {cut(x)} END"


def change(x: str) -> str:
    """SQL of a relative change in percent."""
    return f"CASE WHEN ({x}) = 0 THEN 'equal to' ELSE {cut(f'abs({x}) * 100')} || CASE WHEN ({x}) > 0 THEN '% greater than' ELSE '% less than' END END"


SCORE = "CASE WHEN {t} = 0 THEN (CASE WHEN {v} < 1 THEN {s} ELSE ({v} - 1) * {s} END) WHEN {v} = 0 THEN 2 * {s} WHEN {v} / {t} < 1 THEN {s} / ({v} / {t}) ELSE ({v} / {t}) * {s} END"


@query(f"""WITH {P} SELECT run, metric AS key, 'High rate' AS rule_name, round({SCORE.format(v="p99", t="0.001", s="-2")}, 6) AS score, 'The p99 in ' || run || ' is ' || {number("p99")} || '.' AS description, 'Look at it.' AS message FROM st WHERE metric = 'click' AND p99 > 0.001""")
def rule_stat_threshold(spark, d):
    return rounded(rules.StatThreshold("High rate", "click", "p99", ">", 0.001, -2, message="Look at it.").findings(stats(spark, d)))


@query(f"""WITH {P}, a AS (SELECT o.run, o.metric, o.avg AS v, b.avg AS b, CASE WHEN o.avg = b.avg THEN 0 WHEN b.avg = 0 THEN 1 ELSE (o.avg - b.avg) / b.avg END AS d FROM st o JOIN st b USING (metric) WHERE o.run <> 'run0' AND b.run = 'run0' AND metric = 'click'), c AS (SELECT *, abs(d) AS c FROM a)
SELECT run, metric AS key, 'Changed' AS rule_name, round({SCORE.format(v="c", t="0.01", s="-16")}, 6) AS score, 'The average in ' || run || ' (' || {number("v")} || ') is ' || {change("d")} || ' run0 (' || {number("b")} || ').' AS description, '' AS message FROM c WHERE c >= 0.01""")
def rule_run_comparison(spark, d):
    return rounded(rules.RunComparison("Changed", "click", "avg", ">=", 0.01, -16, absolute=True).findings(stats(spark, d), "run0"))


@query(f"""WITH {P}, h1 AS (SELECT *, {SCORE.format(v="value", t="50", s="-1")} AS score FROM p WHERE regexp_matches(metric, 'c') AND value > 50)
SELECT run, metric AS key, 'Large values' AS rule_name, round(arg_max(score, (abs(score), series, time_diff)), 6) AS score, 'At least one data point in ' || run || ' is ' || {number("arg_max(value, (abs(score), series, time_diff))")} || ' (greater than the threshold of 50).' AS description, '' AS message FROM h1 GROUP BY run, metric""")
def rule_point_threshold(spark, d):
    return rounded(rules.PointThreshold("Large values", "c", ">", 50, -1).findings(points(spark, d)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Customers as stacks: region, nation, segment."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    path = F.array("r_name", "n_name", "c_mktsegment")
    return rows.select(F.concat(F.lit("run"), F.col("c_custkey") % 2).alias("run"), F.col("c_custkey").alias("block"), F.lit(1).alias("thread_state"), path.alias("path"), F.lit(1).cast("long").alias("count"))


S = """s AS (SELECT 'run' || (c_custkey % 2) AS run, c_custkey AS block, r_name AS f1, n_name AS f2, c_mktsegment AS f3, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT run, f1 AS node, n, 0 AS self FROM s UNION ALL SELECT run, f1 || ';' || f2, n, 0 FROM s UNION ALL SELECT run, f1 || ';' || f2 || ';' || f3, n, n FROM s),
g AS (SELECT run, node, sum(n)::BIGINT AS total, sum(self)::BIGINT AS self FROM t GROUP BY ALL)"""


@query(f"WITH {S} SELECT * FROM g")
def profile_nodes(spark, d):
    return profile.nodes(samples(spark, d)).withColumn("node", F.concat_ws(";", "node"))


@query(f"WITH {S}, f AS (SELECT run, f1 AS frame, n, 0 AS self FROM s UNION ALL SELECT run, f2, n, 0 FROM s UNION ALL SELECT run, f3, n, n FROM s) SELECT run, frame, sum(n)::BIGINT AS total, sum(self)::BIGINT AS self FROM f GROUP BY ALL")
def profile_frames(spark, d):
    return profile.frames(samples(spark, d))


@query(f"WITH {S} SELECT run, f1 || ';' || f2 || ';' || f3 AS stack, sum(n)::BIGINT AS count FROM s GROUP BY ALL")
def profile_collapsed(spark, d):
    return profile.collapsed(samples(spark, d))


@query(f"WITH {S} SELECT run, count(*) FILTER (WHERE regexp_matches(f1, '^A') AND regexp_matches(f2, 'I') AND regexp_matches(f3, '^B'))::BIGINT AS total, count(*) FILTER (WHERE regexp_matches(f1, '^A') AND regexp_matches(f2, 'I') AND regexp_matches(f3, '^B'))::BIGINT AS self FROM s GROUP BY run")
def profile_pattern(spark, d):
    return profile.matches(samples(spark, d), ["A.*", ".*I.*", "B.*"])


@query(f"WITH {S} SELECT run, f1 || ';' || f2 || ';' || f3 AS stack, sum(n)::BIGINT AS count FROM s GROUP BY ALL")
def profile_collapsed_whole(spark, d):
    return profile.collapsed(samples(spark, d))


@query(f"""WITH {S}, m AS (SELECT run, n, regexp_matches(f1, '^A') AS a1, regexp_matches(f2, '^A') AS a2, regexp_matches(f2, '^B') AS b2, regexp_matches(f3, '^B') AS b3 FROM s)
SELECT run, coalesce(sum(n) FILTER (WHERE (a1 AND (b2 OR b3)) OR (a2 AND b3)), 0)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE (a1 OR a2) AND b3), 0)::BIGINT AS self FROM m GROUP BY run""")
def profile_pattern_whole(spark, d):
    return profile.matches(samples(spark, d), ["A.*", "B.*"])


#: Stacks with endings of frame names: a nation's kind of code follows from its key.
KINDS = """k AS (SELECT 'run' || (c_custkey % 2) AS run, r_name AS f1, n_name || CASE n_nationkey % 3 WHEN 0 THEN '_[j]' WHEN 1 THEN '_[0]' ELSE '' END AS f2, c_mktsegment || CASE c_custkey % 2 WHEN 0 THEN '_[k]' ELSE '' END AS f3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    kind = lambda k: F.when(k == 0, "_[j]").when(k == 1, "_[0]").otherwise("")
    path = F.array("r_name", F.concat("n_name", kind(F.col("n_nationkey") % 3)), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "_[k]").otherwise("")))
    return rows.select(F.concat(F.lit("run"), F.col("c_custkey") % 2).alias("run"), path.alias("path"), F.lit(1).cast("long").alias("count"))


#: By the rule of patterns: ^pattern(ending)?$ for each frame, the last with the ending asked for; in order from the root; total: any stack that completes them, self: the last one is the leaf, with the others above it.
ANY = r"(_\[(0|j|i|k|1|v)\])?"
TYPED = f"""{KINDS}, m AS (SELECT run, regexp_matches(f1, '^(?:ASIA|AFRICA){ANY}$') AS a1, regexp_matches(f2, '^(?:ASIA|AFRICA){ANY}$') AS a2, regexp_matches(f2, '^.*I.*_\\[j\\]$') AS b2, regexp_matches(f3, '^.*I.*_\\[j\\]$') AS b3,
regexp_matches(f2, '^.*I.*{ANY}$') AS c2, regexp_matches(f3, '^.*I.*{ANY}$') AS c3 FROM k)"""


@query(f"""WITH {TYPED} SELECT run, count(*) FILTER (WHERE a1 AND (b2 OR b3) OR a2 AND b3)::BIGINT AS total, count(*) FILTER (WHERE (a1 OR a2) AND b3)::BIGINT AS self FROM m GROUP BY run""")
def profile_typed_pattern(spark, d):
    return profile.matches(typed(spark, d), ["(?:ASIA|AFRICA)", ".*I.*"], "compiled")


@query(f"""WITH {TYPED} SELECT run, count(*) FILTER (WHERE a1 AND (c2 OR c3) OR a2 AND c3)::BIGINT AS total, count(*) FILTER (WHERE (a1 OR a2) AND c3)::BIGINT AS self FROM m GROUP BY run""")
def profile_tree_pattern(spark, d):
    return calltree.matches(calltree.tree(typed(spark, d)), ["(?:ASIA|AFRICA)", ".*I.*"])


#: Layout of the three levels of stacks from the leaf up: siblings by falling total, then name, from where their parent begins.
LAYOUT = """a1 AS (SELECT run, f3 AS p1, count(*) AS t FROM k GROUP BY ALL), a2 AS (SELECT run, f3 AS p1, f2 AS p2, count(*) AS t FROM k GROUP BY ALL), a3 AS (SELECT run, f3 AS p1, f2 AS p2, f1 AS p3, count(*) AS t FROM k GROUP BY ALL),
x1 AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY run ORDER BY t DESC, p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM a1),
x2 AS (SELECT a2.*, x1.x + coalesce(sum(a2.t) OVER (PARTITION BY a2.run, p1 ORDER BY a2.t DESC, p2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM a2 JOIN x1 USING (run, p1)),
x3 AS (SELECT a3.*, x2.x + coalesce(sum(a3.t) OVER (PARTITION BY a3.run, p1, p2 ORDER BY a3.t DESC, p3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM a3 JOIN x2 USING (run, p1, p2))"""


@query(f"""WITH {KINDS}, {LAYOUT} SELECT run, p1 AS node, 1 AS depth, t AS total, 0 AS self, x::BIGINT AS x FROM x1 UNION ALL SELECT run, p1 || ';' || p2, 2, t, 0, x::BIGINT FROM x2 UNION ALL SELECT run, p1 || ';' || p2 || ';' || p3, 3, t, t, x::BIGINT FROM x3""")
def profile_flame_reverse(spark, d):
    s = typed(spark, d)
    rows = calltree.with_paths(calltree.laid_out(calltree.tree(s, backward=True)), s, backward=True)
    return rows.select("run", F.concat_ws(";", "node").alias("node"), "depth", "total", "self", "x")


@query(f"""WITH {KINDS}, n AS (SELECT run, count(*) AS every FROM k GROUP BY run), f AS (SELECT run, unnest([f1, f2, f3]) AS frame FROM k), h AS (SELECT run, frame, count(*) * 100.0 / any_value(every) AS percent FROM f JOIN n USING (run) GROUP BY run, frame),
q AS (SELECT h.run, h.frame, h.percent, coalesce(b.percent, 0) AS base_percent, h.percent - coalesce(b.percent, 0) AS delta FROM h LEFT JOIN h b ON b.frame = h.frame AND b.run = 'run0' WHERE h.run <> 'run0'),
w AS (SELECT *, CASE WHEN abs(delta) < 0.01 THEN 0 ELSE delta END AS moved FROM q) SELECT run, frame, round(percent, 6) AS percent, round(base_percent, 6) AS base_percent, round(delta, 6) AS delta, round(coalesce(moved / nullif(max(abs(moved)) OVER (PARTITION BY run), 0), 0), 6) AS normal FROM w""")
def profile_function_deltas(spark, d):
    return rounded(profile.function_deltas(typed(spark, d), "run0"))


#: Orders as a stored tree: node 0 the root, below it a node for each of ten residues, below these the priorities, a customer's node below its priority; the customers' orders are counts of blocks.
@query("""WITH o AS (SELECT o_custkey % 10 AS a, o_orderpriority AS p, o_custkey AS c, o_orderstatus AS s, year(o_orderdate) AS block FROM orders)
SELECT s AS run, 'p' AS profiler, 'cpu' AS profile_type, block::BIGINT AS block, 1 AS thread_state, 'r' || a || ';' || p || ';c' || c AS path, count(*) AS count FROM o GROUP BY ALL""")
def profile_from_stored_tree(spark, d):
    by = [F.col("o_orderstatus").alias("run"), F.lit("p").alias("profiler"), F.lit("cpu").alias("profile_type")]
    o = table(spark, d, "orders").select(*by, F.xxhash64(F.concat(F.lit("r"), F.col("o_custkey") % 10)).alias("r"), "o_orderpriority", "o_custkey", F.year("o_orderdate").cast("long").alias("block"))
    names = [F.concat(F.lit("r"), F.col("o_custkey") % 10), F.col("o_orderpriority"), F.concat(F.lit("c"), "o_custkey")]
    ids = [F.xxhash64(names[0]), F.xxhash64(names[0], names[1]), F.xxhash64(*names)]
    own = lambda k: o.select("run", "profiler", "profile_type", ids[k].alias("node_id"), (ids[k - 1] if k else F.lit(0).cast("long")).alias("parent"), F.xxhash64(names[k]).alias("frame_id"), names[k].alias("name"))
    every = own(0).unionByName(own(1)).unionByName(own(2)).distinct()
    frames = every.select("run", "profiler", "profile_type", "frame_id", "name").distinct()
    counts = o.groupBy("run", "profiler", "profile_type", "block", F.lit(1).alias("thread_state"), ids[2].alias("node_id")).agg(F.count("*").alias("count"))
    return calltree.from_stored(every.drop("name"), frames, counts).withColumn("path", F.concat_ws(";", "path"))


@query(f"""WITH {S}, q AS (SELECT *, CASE WHEN contains(node, ';') THEN left(node, length(node) - length(split_part(node, ';', -1)) - 1) ELSE '' END AS parent FROM g)
SELECT run, node, total, self, coalesce(sum(total) OVER (PARTITION BY run, parent ORDER BY total DESC, split_part(node, ';', -1) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM q""")
def profile_flame(spark, d):
    return profile.flame(samples(spark, d)).select("run", F.concat_ws(";", "node").alias("node"), "total", "self", "x")


@query("SELECT e.event_id, e.user_id, e.value, p.value AS before FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.select("event_id", "user_id", "ts", "value"), right, ["user_id"], "ts", "value", "before").drop("ts")


@query("""WITH r AS (SELECT p_size AS grp, p_partkey * 10 AS start, 25 AS len FROM part), q AS (SELECT l_linenumber AS grp, l_partkey * 10 + 12 AS at, l_orderkey, l_linenumber FROM lineitem)
SELECT q.l_orderkey, q.l_linenumber, q.at, max(r.start) AS start FROM q JOIN r ON q.grp = r.grp AND q.at >= r.start AND q.at < r.start + r.len GROUP BY q.l_orderkey, q.l_linenumber, q.at""")
def join_interval(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    ranges = part.select(F.col("p_size").alias("grp"), (F.col("p_partkey") * 10).alias("start"), F.lit(25).alias("len"))
    at = line.select(F.col("l_linenumber").alias("grp"), (F.col("l_partkey") * 10 + 12).alias("at"), "l_orderkey", "l_linenumber")
    return joins.containing(at, ranges, ["grp"], "at", "start", "len", 50, once=True).select("l_orderkey", "l_linenumber", "at", "start")


@query("""WITH c AS (SELECT p_brand, p_retailprice AS latency, CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice < 1500 THEN 1 WHEN p_retailprice < 1800 THEN 2 ELSE 3 END AS k FROM part)
SELECT p_brand, round(sum(latency), 6) AS total, count(*) AS count, count(*) FILTER (WHERE k = 0) AS h0, count(*) FILTER (WHERE k = 1) AS h1, count(*) FILTER (WHERE k = 2) AS h2, count(*) FILTER (WHERE k = 3) AS h3,
round(count(*) FILTER (WHERE k = 0) * 100.0 / count(*), 6) AS share0, round(count(*) FILTER (WHERE k = 1) * 100.0 / count(*), 6) AS share1, round(count(*) FILTER (WHERE k = 2) * 100.0 / count(*), 6) AS share2, round(count(*) FILTER (WHERE k = 3) * 100.0 / count(*), 6) AS share3 FROM c GROUP BY p_brand""")
def hotspot_latency_map(spark, d):
    return rounded(joins.latency_map(table(spark, d, "part").withColumn("latency", F.col("p_retailprice")), ["p_brand"]))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 16")
def top_spenders(spark, d):
    spend = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return joins.top(spend, "spend", 16, ["o_custkey"])


@query("""WITH kv AS (SELECT 'customer' AS run, CAST(c_nationkey AS VARCHAR) AS grp, c_mktsegment AS key, CAST(count(*) AS VARCHAR) AS value FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), 'BUILDING', CAST(count(*) AS VARCHAR) FROM supplier GROUP BY ALL)
SELECT grp, key FROM (SELECT grp, key, run, nullif(coalesce(value, ''), '') AS value FROM kv) GROUP BY grp, key HAVING count(DISTINCT value) + CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN run END) < 2 THEN 1 ELSE 0 END > 1""")
def kv_differing_keys(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").count().select(F.lit("customer").alias("run"), F.col("c_nationkey").cast("string").alias("grp"), F.col("c_mktsegment").alias("key"), F.col("count").cast("string").alias("value"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").count().select(F.lit("supplier").alias("run"), F.col("s_nationkey").cast("string").alias("grp"), F.lit("BUILDING").alias("key"), F.col("count").cast("string").alias("value"))
    kv = c.unionByName(s)
    return joins.differing_keys(kv, kv.select("run").distinct())


@query("""WITH e AS (SELECT l_linestatus AS run, l_suppkey AS sample_idx, l_linenumber AS cpu, l_returnflag AS event, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
c AS (SELECT run, sample_idx, cpu, sum(value) FILTER (WHERE event = 'A') AS a, sum(value) FILTER (WHERE event = 'R') AS r, sum(value) FILTER (WHERE event = 'N') AS n FROM e GROUP BY ALL),
t AS (SELECT run, sample_idx, 'CPU' || cpu AS series, a, r, n FROM c UNION ALL SELECT run, sample_idx, 'Aggregate', sum(a), sum(r), sum(n) FROM c GROUP BY ALL)
SELECT run, sample_idx, 'share' AS metric, series, round(100 * (a + r) / (a + r + 2 * n), 6) AS value FROM t WHERE a + r + n IS NOT NULL AND a + r + 2 * n <> 0""")
def counter_formula(spark, d):
    flag = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("run"), F.col("l_suppkey").alias("sample_idx"), F.col("l_linenumber").alias("cpu"), F.col("l_returnflag").alias("event")).agg(F.sum("l_quantity").alias("value"))
    values = flag.withColumn("ts", F.col("sample_idx"))
    return rounded(counters.metric(values, "share", "100 * (A + R) / (A + R + 2 * N)", ["A", "R", "N"])).drop("ts")


@query("""WITH t AS (SELECT o_orderstatus AS run, o_custkey || '_' || 'c' AS series, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS k FROM orders GROUP BY ALL),
b AS (SELECT run, series FROM t WHERE u IS NOT NULL OR k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY coalesce(u, 0) + coalesce(k, 0) DESC, series) <= 16)
SELECT o_orderstatus AS run, o_custkey || '_' || 'c' AS series, count(*) AS n FROM orders WHERE (o_orderstatus, o_custkey || '_' || 'c') IN (SELECT (run, series) FROM b) GROUP BY ALL""")
def process_ranking(spark, d):
    metric = F.when(F.col("o_orderpriority") == "1-URGENT", "user_time").when(F.col("o_orderpriority") == "2-HIGH", "kernel_time").otherwise("threads")
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), F.concat("o_custkey", F.lit("_c")).alias("series"), metric.alias("metric"), F.col("o_totalprice").alias("value"))
    return counters.busiest(rows).groupBy("run", "series").agg(F.count("*").alias("n"))
