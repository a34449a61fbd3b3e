"""Queries that run whole sources: counts of orders by day become snapshots of text, which the parsers and pipelines turn into points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.plans.queries import query, rounded, table
from gaugeframe.sources import pipelines, snapshots, text

D = """d AS (SELECT 'run' || (o_custkey % 2) AS run, date_diff('day', (SELECT min(o_orderdate)::DATE FROM orders), o_orderdate::DATE) AS k, count(*) AS a, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS b,
count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY ALL)"""


def rates(source: str, name: str = "r") -> str:
    """SQL of the rates of a table (run, metric, series, k, value)."""
    return f"""{name}l AS (SELECT *, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM {source} WINDOW w AS (PARTITION BY run, metric, series ORDER BY k)),
    {name} AS (SELECT run, metric, series, k, CASE WHEN pv IS NULL THEN 0.0 ELSE (value - pv) / ((k - pk) * 60) END AS value FROM {name}l WHERE pv IS NULL OR value >= pv)"""


def averages(source: str, name: str = "v") -> str:
    """SQL of a table (run, metric, series, k, value) with its average series."""
    return f"""{name} AS (SELECT run, metric, series, k, value, false AS is_aggregate FROM {source} UNION ALL SELECT run, metric, 'average', k, avg(value), true FROM {source}
    WHERE (run, metric) IN (SELECT (run, metric) FROM {source} GROUP BY run, metric HAVING count(DISTINCT series) > 1) GROUP BY run, metric, k)"""


def out(source: str, aggregate: str = "false") -> str:
    return f"SELECT run, metric, series, k AS sample_idx, k * 60 AS time_diff, round(value, 6) AS value, {aggregate} AS is_aggregate FROM {source}"


def long(*entries: tuple[str, str, str]) -> str:
    """SQL of a table (run, metric, series, k, value) from entries (metric, series, value) of each day."""
    cols = ["[" + ", ".join(x) + "]" for x in zip(*[(f"'{m}'", f"'{s}'", f"({v})::DOUBLE") for m, s, v in entries], strict=True)]
    return f"(SELECT run, k, unnest({cols[0]}) AS metric, unnest({cols[1]}) AS series, unnest({cols[2]}) AS value FROM d)"


def days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    first = o.agg(F.min("day")).scalar()
    some = lambda c, v: F.count_if(F.col(c) == v)
    keys = [F.concat(F.lit("run"), F.col("o_custkey") % 2).alias("run"), F.datediff("day", first).cast("long").alias("sample_idx")]
    return o.groupBy(*keys).agg(F.count("*").alias("a"), some("o_orderpriority", "1-URGENT").alias("b"), some("o_orderpriority", "2-HIGH").alias("c"), some("o_orderstatus", "F").alias("f")).withColumn("ts", F.col("sample_idx") * 60)


def payload(template: str) -> Column:
    """Text with the day's numbers in place of {a}, {b}, {c}, {f}."""
    parts = F.lit(template)
    for c in "abcf":
        parts = F.replace(parts, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return parts


def snapshots_of(spark: SparkSession, d: str, template: str) -> DataFrame:
    return days(spark, d).select("run", "sample_idx", "ts", payload(template).alias("payload"))


@query(f"""WITH {D}, x AS {long(("pgfault", "values", "a"), ("pgmajfault", "values", "b"))}, {rates("x")}, g AS {long(("nr_free_pages", "values", "c"))},
m AS (SELECT p.run, 'pgminorfault' AS metric, p.series, p.k, p.value - q.value AS value FROM r p JOIN r q ON p.run = q.run AND p.k = q.k AND p.metric = 'pgfault' AND q.metric = 'pgmajfault'),
u AS (SELECT * FROM r UNION ALL BY NAME SELECT * FROM g UNION ALL BY NAME SELECT * FROM m) {out("u")}""")
def source_vmstat(spark, d):
    return rounded(pipelines.vmstat(snapshots_of(spark, d, "pgfault {a}\npgmajfault\t{b}\r\n\nnr_free_pages {c}")))


@query(f"""WITH {D}, x AS {long(("MemTotal", "values", "a * 1024"), ("MemFree", "values", "b * 1048576"), ("HugePages", "values", "c"))} {out("x")}""")
def source_meminfo(spark, d):
    return rounded(pipelines.meminfo(snapshots_of(spark, d, "MemTotal: {a} kB\nMemFree:   {b} MB\nHugePages: {c}\nbroken")))


@query(f"""WITH {D}, x AS {long(("IpExt:InOctets", "values", "a"), ("IpExt:OutOctets", "values", "b"), ("Tcp:Opens", "values", "c"))}, {rates("x")} {out("r")}""")
def source_netstat(spark, d):
    return rounded(pipelines.netstat(snapshots_of(spark, d, "IpExt: InOctets OutOctets\nIpExt: {a} {b}\nTcp: Opens\nTcp: {c}\n")))


DISK = [("reads", "a"), ("reads_merged", "b"), ("sectors_read", "c"), ("ms_reading", "f")] + [(m, "f" if m == "in_progress" else "0") for m in text.DISK_FIELDS[4:]]


@query(f"""WITH {D}, x AS {long(*[(m, "sda", v) for m, v in DISK if m != "in_progress"])}, {rates("x")}, g AS {long(("in_progress", "sda", "f"))}, u AS (SELECT * FROM r UNION ALL BY NAME SELECT * FROM g) {out("u")}""")
def source_diskstats(spark, d):
    return rounded(pipelines.diskstats(snapshots_of(spark, d, "   8 0 sda {a} {b} {c} {f} 0 0 0 0 {f} 0 0\n 8 1 short 1")))


CPUS = {"Aggregate": "a + f, b + c, c + b, f + a", "CPU0": "a, b, c, f", "CPU1": "f, c, b, a"}


@query(f"""WITH {D}, x AS ({" UNION ALL ".join(f"SELECT run, k, '{s}' AS series, unnest(['user', 'nice', 'system', 'idle', 'iowait', 'irq', 'softirq', 'steal']) AS metric, unnest([{v}, 0, 0, 0, 0]) AS value FROM d" for s, v in CPUS.items())}),
g AS (SELECT *, greatest(value - lag(value) OVER (PARTITION BY run, series, metric ORDER BY k), 0) AS e FROM x), h AS (SELECT *, sum(e) OVER (PARTITION BY run, series, k) AS every, sum(e) FILTER (WHERE metric = 'idle') OVER (PARTITION BY run, series, k) AS idle FROM g WHERE e IS NOT NULL),
s AS (SELECT run, k, CASE WHEN series = 'Aggregate' THEN 'aggregate' ELSE metric END AS metric, CASE WHEN series = 'Aggregate' THEN metric ELSE series END AS series, CASE WHEN every = 0 THEN 0 ELSE e * 100.0 / every END AS value FROM h
UNION ALL SELECT DISTINCT run, k, 'aggregate', 'total', CASE WHEN every = 0 THEN 0 ELSE (every - idle) * 100.0 / every END FROM h WHERE series = 'Aggregate') {out("s", "metric = 'aggregate' AND series = 'total'")}""")
def source_cpu(spark, d):
    n = days(spark, d).withColumns({"s": F.col("a") + F.col("f"), "t": F.col("b") + F.col("c")})
    line = lambda name, *cols: F.concat_ws(" ", F.lit(name), *[F.col(c).cast("string") for c in cols], F.lit("0 0 0 0 0 0"))
    raw = n.select("run", "sample_idx", "ts", F.concat_ws("\n", line("cpu ", "s", "t", "t", "s"), line("cpu0", "a", "b", "c", "f"), line("cpu4", "f", "c", "b", "a"), F.lit("intr 1 2")).alias("payload"))
    return rounded(pipelines.cpu_utilization(raw))


@query(f"""WITH {D}, x AS {long(("(chip)", "CPU0", "a"), ("(chip)", "CPU1", "b"), ("()", "CPU0", "b"), ("()", "CPU1", "b"), ("LOC (Local timer)", "CPU0", "c"), ("LOC (Local timer)", "CPU1", "f"), ("ERR", "ERR", "a"))}, {rates("x")}, {averages("r")} {out("v", "is_aggregate")}""")
def source_interrupts(spark, d):
    return rounded(pipelines.interrupts(snapshots_of(spark, d, "    CPU0   CPU1\n 7: {a} {b} chip\n 9: {b} {b}\nLOC: {c} {f} Local timer\nERR: {a}\n")))


@query(f"""WITH {D}, x AS {long(("numa_hit", "node0", "a"), ("numa_miss", "node0", "b"), ("numa_hit", "node1", "c"), ("other", "node1", "f"))}, {rates("x")}, {averages("r")} {out("v", "is_aggregate")}""")
def source_numastat(spark, d):
    return rounded(pipelines.numastat(snapshots_of(spark, d, "node0:\nnuma_hit {a}\nnuma_miss {b}\nnode1:\r\nnuma_hit 7\nnuma_hit {c}\nother {f}\nbad x\n")))


@query(f"""WITH {D}, x AS {long(("tx", "eth0_queue_0", "a"), ("tx", "eth0_queue_1", "b"), ("bw_in_allowance_exceeded", "eth0", "c"))}, {rates("x")}, {averages("r")} {out("v", "is_aggregate")}""")
def source_ena(spark, d):
    return rounded(pipelines.ena_stat(snapshots_of(spark, d, "eth0:\nqueue_0_tx {a}\nqueue_1_tx {b}\nbw_in_allowance_exceeded {c}\n")))


@query(f"""WITH {D}, x AS {long(("send_bytes", "efa0", "a"), ("send_wrs", "efa0", "b"), ("send_bytes", "efa1", "c"), ("send_wrs", "efa1", "f"), ("rx", "efa1", "a"))}, {rates("x")},
q AS (SELECT run, series, k, coalesce(max(value) FILTER (WHERE metric = 'send_bytes'), 0) AS y, coalesce(max(value) FILTER (WHERE metric = 'send_wrs'), 0) AS n FROM r WHERE metric IN ('send_bytes', 'send_wrs') GROUP BY ALL),
u AS (SELECT run, metric, series, k, value FROM r UNION ALL SELECT run, 'avg_bytes_per_send_wr', series, k, CASE WHEN n > 0 THEN y / n ELSE 0 END FROM q), {averages("u")} {out("v", "is_aggregate")}""")
def source_efa(spark, d):
    return rounded(pipelines.efa_stat(snapshots_of(spark, d, "efa0:\nsend_bytes {a}\nsend_wrs {b}\nefa1:\nsend_bytes {c}\nsend_wrs {f}\nrx {a}\n")))


@query(f"""WITH {D}, x AS {long(("BuddyInfo order_0 (4KB)", "node_0_zone_DMA", "a"), ("BuddyInfo order_1 (8KB)", "node_0_zone_DMA", "b"), ("BuddyInfo order_0 (4KB)", "node_1_zone_DMA", "c"), ("PageType Movable - order_0 (4KB)", "node_0_zone_DMA", "a"),
("PageType Movable - order_1 (8KB)", "node_0_zone_DMA", "f"), ("PageBlocks - Reclaimable", "zone_DMA", "a"), ("PageBlocks - HighAtomic", "zone_DMA", "f"), ("SlabInfo active objs", "ext4", "a"), *[("SlabInfo " + m.replace("_", " "), "ext4", str(k)) for m, k in snapshots.SLAB_FIELDS.items() if m != "active_objs"])}, {averages("x")} {out("v", "is_aggregate")}""")
def source_memalloc(spark, d):
    slab = "slabinfo\n# name <x>\next4 {a} 2 3 4 5 : tunables 8 9 10 : slabdata 13 14 15"
    raw = days(spark, d).select("run", "sample_idx", "ts", payload("Node 0, zone DMA {a} {b}\nNode 1, zone DMA {c}").alias("buddyinfo"), payload("Page block order: 9\nNode 0, zone DMA, type Movable {a} {f}").alias("pagetypeinfo"), payload(slab).alias("slabinfo"))
    return rounded(pipelines.memalloc(raw))


@query(f"""WITH {D}, x AS {long(("user_time", "1_p q", "a / 100.0"), ("kernel_time", "1_p q", "b / 100.0"), ("user_time", "2_r", "c / 100.0"), ("kernel_time", "2_r", "f / 100.0"))}, {rates("x")},
g AS {long(("process_count", "values", "2"), *[(m, s, v) for s, th, vm, rss in (("1_p q", "c", "f", "b"), ("2_r", "a", "b", "c")) for m, v in (("threads", th), ("virtual_bytes", vm), ("resident_pages", rss), ("resident_bytes", f"{rss} * 4096"))])},
u AS (SELECT * FROM r UNION ALL BY NAME SELECT * FROM g) {out("u")}""")
def source_processes(spark, d):
    line = lambda pid, name, u, k, th, vm, rss: f"{pid} ({name}) S 0 0 0 0 0 0 0 0 0 0 {{{u}}} {{{k}}} 0 0 0 0 {{{th}}} 0 0 {{{vm}}} {{{rss}}} 0"
    return rounded(pipelines.processes(snapshots_of(spark, d, line(1, "p q", "a", "b", "c", "f", "b") + "\n" + line(2, "r", "c", "f", "a", "b", "c") + "\n3 (short) S 1 2")))


@query(f"""WITH {D}, x AS (SELECT run, k, 'ipc' AS metric, 'values' AS series, ((a + b) * 10 + c * 10) / nullif(f + 2 * a, 0)::DOUBLE AS value FROM d), y AS (SELECT * FROM x WHERE value IS NOT NULL) {out("y")}""")
def source_legacy_counters(spark, d):
    return rounded(pipelines.perf_stat_legacy(snapshots_of(spark, d, "0 ipc; {a} {b}; {f}; 10\n1 ipc; {c}; {a} {a}; 10\n1 broken; 1")))


@query(f"""WITH {D}, c AS (SELECT run, k, unnest([0, 0, 1, 1]) AS cpu, unnest(['i', 'n', 'i', 'n']) AS event, unnest([a, b, c, f])::DOUBLE AS v, unnest([k * 100, k * 100, k * 100, k * 100])::DOUBLE AS enabled, unnest([k * 50, k * 100, k * 100, k * 25])::DOUBLE AS running FROM d),
e AS (SELECT *, enabled - coalesce(lag(enabled) OVER w, 0) AS en, running - coalesce(lag(running) OVER w, 0) AS ru FROM c WINDOW w AS (PARTITION BY run, cpu, event ORDER BY k)), s AS (SELECT *, v * en / nullif(ru, 0) AS value FROM e),
p AS (SELECT run, k, cpu, sum(value) FILTER (WHERE event = 'i') AS i, sum(value) FILTER (WHERE event = 'n') AS n FROM s WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT run, k, 'CPU' || cpu AS series, i, n FROM p UNION ALL SELECT run, k, 'Aggregate', sum(i), sum(n) FROM p GROUP BY ALL),
u AS (SELECT run, k, 'ipc' AS metric, series, i / nullif(n, 0) * 2 AS value FROM t WHERE n <> 0 AND i IS NOT NULL UNION ALL SELECT run, k, 'mux_counter_schedule_rate', 'CPU' || cpu, avg(ru * 100 / nullif(en, 0)) FROM e GROUP BY run, k, cpu UNION ALL SELECT run, k, 'mux_counter_schedule_rate', 'Aggregate', avg(ru * 100 / nullif(en, 0)) FROM e GROUP BY run, k)
{out("u", "series = 'Aggregate'")}""")
def source_counters(spark, d):
    n = days(spark, d)
    line = lambda cpu, e, c, share: F.concat_ws(";", F.lit(cpu), F.lit(e), F.col(c).cast("string"), (F.col("sample_idx") * 100).cast("string"), (F.col("sample_idx") * share).cast("string"))
    raw = n.select("run", "sample_idx", "ts", F.concat_ws("\n", line("0", "i", "a", 50), line("0", "n", "b", 100), line("1", "i", "c", 100), line("1", "n", "f", 25), F.lit("x;y")).alias("payload"))
    return rounded(pipelines.perf_stat(raw, {"ipc": "i / n * 2"}, ["i", "n"]))


@query(f"""WITH {D}, x AS {long(("user", "own", "a"), ("user", "print", "b"), ("kernel", "own", "c"))}, {averages("x")}, u AS (SELECT * FROM x UNION ALL BY NAME SELECT run, metric, 'total' AS series, k, sum(value) AS value FROM x WHERE metric = 'user' GROUP BY ALL) {out("u", "series = 'total'")}""")
def source_self_stats(spark, d):
    number = lambda c: F.col(c).cast("double")
    stats = F.create_map(F.lit("own"), F.create_map(F.lit("user"), number("a"), F.lit("kernel"), number("c")), F.lit("print"), F.create_map(F.lit("user"), number("b")))
    return rounded(pipelines.self_stats(days(spark, d).select("run", "sample_idx", "ts", stats.alias("stats"))))


@query(f"""WITH {D} SELECT run, (k * 3 + j)::BIGINT AS n, j::BIGINT AS line_no, CASE j WHEN 0 THEN 'day ' || a WHEN 1 THEN '' ELSE '  end' END AS line FROM d, (SELECT unnest([0, 1, 2]) AS j)""")
def source_log(spark, d):
    raw = snapshots_of(spark, d, "day {a} \t\n\n  end\r")
    rows = text.log_lines(raw.withColumn("run", F.concat_ws("|", "run", "sample_idx")))
    parts = F.split("run", r"\|")
    return rows.select(F.get(parts, F.lit(0)).alias("run"), (F.get(parts, F.lit(1)).cast("long") * 3 + F.col("line_no")).alias("n"), "line_no", "line")
