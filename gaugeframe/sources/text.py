"""Parsers of raw text snapshots: raw(run, sample_idx, ts, payload) to counters(run, sample_idx, ts, metric, series, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The states of a CPU line and the fields of a disk line, in the order of the text.
CPU_STATES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
DISK_FIELDS = (
    "reads", "reads_merged", "sectors_read", "ms_reading", "writes", "writes_merged", "sectors_written", "ms_writing", "in_progress",
    "ms_io", "weighted_ms_io", "discards", "discards_merged", "sectors_discarded", "ms_discarding", "flushes", "ms_flushing",
)
OUT = ("run", "sample_idx", "ts", "metric", "series", "value")


def trimmed(line: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def lines(raw: DataFrame) -> DataFrame:
    return raw.select("run", "sample_idx", "ts", F.posexplode(F.split("payload", "\n")).alias("line_no", "line"))


def _parts(line: Column) -> Column:
    return F.split(trimmed(line), r"\s+")


def _number(x: Column) -> Column:
    return x.try_cast("double")


def cpu(raw: DataFrame) -> DataFrame:
    """Lines ``cpu…`` of at least nine parts; ``cpu`` is the total, the others are numbered by their place."""
    rows = lines(raw).withColumn("p", _parts(F.col("line"))).where(F.col("line").startswith("cpu") & (F.size("p") >= 9))
    total = F.element_at("p", 1) == "cpu"
    place = F.row_number().over(Window.partitionBy("run", "sample_idx", total).orderBy("line_no")) - 1
    rows = rows.withColumn("series", F.when(total, F.lit("Aggregate")).otherwise(F.concat(F.lit("CPU"), place)))
    states = F.array(*[F.struct(F.lit(s).alias("metric"), _number(F.get("p", F.lit(k + 1))).alias("value")) for k, s in enumerate(CPU_STATES)])
    return rows.select("run", "sample_idx", "ts", "series", F.inline(states)).select(*OUT)


def disks(raw: DataFrame) -> DataFrame:
    """Lines of 14 parts or more; the device is the third part, missing fields are 0."""
    rows = lines(raw).withColumn("p", _parts(F.col("line"))).where(F.size("p") >= 14).withColumn("series", F.get("p", F.lit(2)))
    fields = F.array(*[F.struct(F.lit(s).alias("metric"), F.coalesce(_number(F.get("p", F.lit(k + 3))), F.lit(0.0)).alias("value")) for k, s in enumerate(DISK_FIELDS)])
    return rows.select("run", "sample_idx", "ts", "series", F.inline(fields)).select(*OUT)


def pairs(raw: DataFrame) -> DataFrame:
    """Lines ``name value``."""
    rows = lines(raw).withColumn("p", _parts(F.col("line"))).where(F.size("p") >= 2)
    return rows.select("run", "sample_idx", "ts", F.get("p", F.lit(0)).alias("metric"), F.lit("values").alias("series"), F.get("p", F.lit(1)).cast("double").alias("value"))


def memory(raw: DataFrame) -> DataFrame:
    """Lines ``Name: value [unit]`` in bytes."""
    rows = lines(raw).withColumn("m", F.regexp_extract("line", r"^([^:]+):\s*(\d+)", 1)).where("m <> ''")
    unit = F.lower(F.regexp_extract("line", r"\d+\s*([kKmMgG][bB])\s*$", 1))
    scale = F.when(unit == "kb", 1 << 10).when(unit == "mb", 1 << 20).when(unit == "gb", 1 << 30).otherwise(1)
    value = F.regexp_extract("line", r"^[^:]+:\s*(\d+)", 1).cast("double") * scale
    return rows.select("run", "sample_idx", "ts", F.col("m").alias("metric"), F.lit("values").alias("series"), value.alias("value"))


def network(raw: DataFrame) -> DataFrame:
    """Pairs of lines, names above values; a snapshot with a pair of unequal length is left out."""
    rows = lines(raw).where(trimmed(F.col("line")) != "")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("run", "sample_idx").orderBy("line_no")) - 1)
    pair = rows.groupBy("run", "sample_idx", "ts", F.floor(F.col("k") / 2).alias("pair")).agg(
        F.max(F.when(F.col("k") % 2 == 0, F.col("line"))).alias("names"), F.max(F.when(F.col("k") % 2 == 1, F.col("line"))).alias("values")
    )
    pair = pair.withColumns({"n": _parts(F.col("names")), "v": _parts(F.coalesce("values", F.lit("")))})
    good = F.min(F.size("n") == F.size("v")).over(Window.partitionBy("run", "sample_idx"))
    pair = pair.withColumn("good", good).where("good")
    zipped = F.explode(F.slice(F.arrays_zip("n", "v"), 2, F.size("n")))
    out = pair.select("run", "sample_idx", "ts", F.regexp_replace(F.get("n", F.lit(0)), ":$", "").alias("prefix"), zipped.alias("x")).where("x.n is not null")
    return out.select("run", "sample_idx", "ts", F.concat_ws(":", "prefix", "x.n").alias("metric"), F.lit("values").alias("series"), _number(F.col("x.v")).alias("value"))


def components(raw: DataFrame) -> DataFrame:
    """Lines ``component:`` above lines ``metric value``; the last of repeated pairs holds."""
    rows = lines(raw).withColumn("line", trimmed(F.col("line")))
    head = F.when(F.col("line").endswith(":"), F.regexp_replace("line", ":$", ""))
    by = Window.partitionBy("run", "sample_idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("series", F.last(head, ignorenulls=True).over(by)).withColumn("p", _parts(F.col("line")))
    rows = rows.where((F.size("p") == 2) & F.col("series").isNotNull()).select("run", "sample_idx", "ts", "line_no", F.get("p", F.lit(0)).alias("metric"), "series", _number(F.get("p", F.lit(1))).alias("value")).where("value is not null")
    return rows.groupBy("run", "sample_idx", "ts", "metric", "series").agg(F.max_by("value", "line_no").alias("value"))


def queue_split(counters: DataFrame) -> DataFrame:
    """Metrics ``queue_N_x`` become metric x of series ``<series>_queue_N``."""
    n, x = (F.regexp_extract("metric", r"^queue_(\d+)_(.+)$", k) for k in (1, 2))
    hit = n != ""
    return counters.withColumns({"series": F.when(hit, F.concat("series", F.lit("_queue_"), n)).otherwise(F.col("series")), "metric": F.when(hit, x).otherwise(F.col("metric"))})


def cpu_shares(counters: DataFrame) -> DataFrame:
    """Each state's share of a CPU's time since the snapshot before, in percent; a fallen counter adds 0. The series Aggregate becomes a metric of its own,
    ``aggregate``, with a series for each state and ``total``, the share of all that is not idle."""
    last = Window.partitionBy("run", "series", "metric").orderBy("sample_idx")
    rows = counters.withColumn("d", F.greatest(F.col("value") - F.lag("value").over(last), F.lit(0.0))).where("d is not null")
    at = ["run", "sample_idx", "ts", "series"]
    sums = rows.groupBy(*at).agg(F.sum("d").alias("all"), F.sum(F.when(F.col("metric") == "idle", F.col("d")).otherwise(0.0)).alias("idle"))
    share = F.coalesce(F.try_divide(F.col("d") * 100, F.col("all")), F.lit(0.0))
    rows = rows.join(sums.select("run", "sample_idx", "series", "all"), ["run", "sample_idx", "series"]).withColumn("value", share)
    whole = F.col("series") == "Aggregate"
    rows = rows.withColumns({"metric": F.when(whole, "aggregate").otherwise(F.col("metric")), "series": F.when(whole, F.col("metric")).otherwise(F.col("series"))})
    busy = F.coalesce(F.try_divide((F.col("all") - F.col("idle")) * 100, F.col("all")), F.lit(0.0))
    total = sums.where(whole).select("run", "sample_idx", "ts", F.lit("aggregate").alias("metric"), F.lit("total").alias("series"), busy.alias("value"))
    return rows.select(*OUT).unionByName(total)


def legacy_counters(raw: DataFrame) -> DataFrame:
    """Lines ``cpu stat; numerators…; denominators…; scale``: run, sample_idx, ts, cpu, stat, numerator, denominator, scale; a sum that no longer fits stays where it was."""
    rows = lines(raw).withColumn("p", F.split("line", ";")).where(F.size("p") >= 4).withColumn("head", _parts(F.get("p", F.lit(0)))).where(F.size("head") == 2)
    most = 2.0**64 - 1

    def total(k: int) -> Column:
        numbers = F.transform(_parts(F.get("p", F.lit(k))), lambda x: x.try_cast("double"))
        return F.aggregate(numbers, F.lit(0.0), lambda acc, x: F.when(acc + x > most, acc).otherwise(acc + F.coalesce(x, F.lit(0.0))))

    out = rows.select("run", "sample_idx", "ts", F.get("head", F.lit(0)).try_cast("int").alias("cpu"), F.get("head", F.lit(1)).alias("stat"), total(1).alias("numerator"), total(2).alias("denominator"), trimmed(F.get("p", F.lit(3))).try_cast("double").alias("scale"))
    return out.where("cpu is not null and scale is not null")


def log_lines(raw: DataFrame) -> DataFrame:
    """run, line_no, line: a log's lines without white space at their ends."""
    rows = raw.select("run", F.posexplode(F.split("payload", "\n")).alias("line_no", "line"))
    return rows.select("run", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"\s+$", "").alias("line"))


def memory_label(metric: Column) -> Column:
    """Readable names of allocator metrics: orders with the size of their blocks."""
    order = F.regexp_extract(metric, r"_order_(\d+)", 1).try_cast("int")
    kb = F.call_function("shiftleft", F.lit(4), F.coalesce(order, F.lit(0)))
    size = F.when(kb >= 1024, F.concat((kb / 1024).cast("long"), F.lit("MB"))).otherwise(F.concat(kb, F.lit("KB")))
    kind = F.regexp_extract(metric, r"^pagetype_order_\d+_type_(.+)$", 1)
    return (
        F.when(metric.rlike(r"^buddyinfo_order_\d+$"), F.concat(F.lit("BuddyInfo order_"), order, F.lit(" ("), size, F.lit(")")))
        .when(metric.startswith("pageblocks_"), F.concat(F.lit("PageBlocks - "), F.regexp_extract(metric, r"^pageblocks_type_(.*)$", 1)))
        .when(kind != "", F.concat(F.lit("PageType "), kind, F.lit(" - order_"), order, F.lit(" ("), size, F.lit(")")))
        .when(metric.startswith("slabinfo_"), F.concat(F.lit("SlabInfo "), F.replace(F.substring(metric, 10, 1000), F.lit("_"), F.lit(" "))))
        .otherwise(metric)
    )


def memory_order(metric: Column) -> Column:
    """A key to sort allocator metrics by: buddies, page types, page blocks, slabs, others; then the migrate type, then the order as a number."""
    kind = F.when(metric.startswith("buddyinfo"), 0).when(metric.startswith("pagetype"), 1).when(metric.startswith("pageblocks"), 2).when(metric.startswith("slabinfo"), 3).otherwise(4)
    return F.struct(kind.alias("kind"), F.regexp_extract(metric, r"_type_(.+)$", 1).alias("type"), F.coalesce(F.regexp_extract(metric, r"_order_(\d+)", 1).try_cast("int"), F.lit(-1)).alias("order"), metric.alias("name"))
