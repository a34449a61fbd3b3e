"""Joins in time and over ranges, without a shuffle for each pair of rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of one key that are sorted in one task, and the most parts that a key with more of them is cut into.
KEY_ROWS, MOST_PARTS = 1 << 20, 256
#: Of all rows, the part from which on a key may be cut; so at most that many keys are.
HOT_PART = 10_000


#: Rows that a task sorts or groups, where they are dealt by their number.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``rows``, ``n`` of them, in as many tasks as they ask for; Spark's own number of tasks does not grow with the input. A task's worth of rows is left to Spark."""
    return rows if n <= TASK_ROWS else rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS + 1), *by)


def in_parts(rows: DataFrame, by: list[str], order: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """``rows`` with ``_part``: 0, but for keys with more than ``key_rows`` rows (and over a HOT_PART of all), whose rows are cut by quantiles of ``order``. Equal values are in one part, lower values
    in lower parts. The table of bounds is broadcast: HOT_PART keys at most, and as many bounds as their rows fill parts, so 2 x HOT_PART."""
    least = max(key_rows, rows.count() // HOT_PART)
    hot = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    if hot.isEmpty():
        return rows.withColumn("_part", F.lit(0))
    few = F.broadcast(hot.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n"))
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(F.col(f"_by_{c}")) for c in by])
    most = min(MOST_PARTS, max(r["_n"] for r in hot.agg(F.max("_n").alias("_n")).collect()) // least + 1)
    bounds = rows.join(few, same).groupBy(*[f"_by_{c}" for c in by]).agg(F.percentile_approx(order, [k / most for k in range(1, most)] or [1.0], 10 * MOST_PARTS).alias("_bounds"))
    return rows.join(F.broadcast(bounds), same, "left").withColumn("_part", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(0))).drop("_bounds", *[f"_by_{c}" for c in by])


def as_of(left: DataFrame, right: DataFrame, by: list[str], order: str, value: str, name: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """``left`` with ``name``: the latest ``value`` (not null) of ``right`` at or before ``order``, within ``by``. One sort of the union of both; a key with more rows than a
    task should sort is cut into parts by ``order``, and each part takes over the last value of those before it."""
    one = left.withColumns({"_side": F.lit(1), name: F.lit(None).cast(right.schema[value].dataType)})
    two = right.select(*by, order, F.col(value).alias(name), F.lit(0).alias("_side"))
    both = in_parts(one.unionByName(two, allowMissingColumns=True), by, order, key_rows)
    w = Window.partitionBy(*by, "_part").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_side = 1")
    ends = both.where(F.col(name).isNotNull()).groupBy(*by, "_part").agg(F.max_by(name, order).alias("_end"))
    later = both.where("_part > 0").select(*by, "_part").distinct().join(ends.withColumnRenamed("_part", "_at"), by, "inner").where("_at < _part") if by else None
    if later is None:
        return rows.drop("_side", "_part")
    carry = later.groupBy(*by, "_part").agg(F.max_by("_end", "_at").alias("_end")).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_to"), "_end")
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]) & (F.col("_part") == F.col("_to"))
    return rows.join(F.broadcast(carry), same, "left").withColumn(name, F.coalesce(name, "_end")).select(*left.columns, name)


def containing(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, length: str, width: int | None = None, once: bool = False) -> DataFrame:
    """Each point with the range of its group that starts last at or before it and holds it. Ranges are cut into cells, so points meet only ranges in
    their own cell. ``width`` of a cell is the mean length of ranges if not given; a range that fills more than MOST_CELLS is cut into cells of
    a coarser grid, of which each is MOST_CELLS times as wide, and so on. Equal points are looked up once, and are one row if ``once``."""
    key, count, n = points.columns, [] if once else ["_n"], points.count()
    some = ranges.where(F.col(length) > 0)
    mean, longest = some.agg(F.avg(length), F.max(length)).first()
    width = width or max(1, math.ceil(mean or 1))
    levels = 0
    while longest and longest > width * MOST_CELLS ** (levels + 1):
        levels += 1
    size = F.pow(F.lit(float(MOST_CELLS)), F.col("_level")) * width
    level = sum(((F.col(length) > width * MOST_CELLS ** (k + 1)).cast("int") for k in range(levels)), F.lit(0))
    cells = some.withColumn("_level", level).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(length) - 1) / size))))
    rows = points if once else dealt(points, n, key).groupBy(*key).agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_cell", F.floor(F.col(at) / size))
    cells = cells.hint("merge") if n > TASK_ROWS else cells
    place = [*by, *(["_level"] if levels else []), "_cell"]  # a level that is 0 throughout would be no key of the join, which then deals once more
    hit = dealt(rows, n * (levels + 1), place).join(cells, place).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length)))
    more = [c for c in ranges.columns if c not in key]
    last = dealt(hit, n, key).groupBy(*key, *count).agg(F.max_by(F.struct(*more), F.col(start)).alias("_r"))
    return last.select(*key, "_r.*") if once else last.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*key, "_r.*")


#: Cells that a range fills at most, but for one.
MOST_CELLS = 16


def enclosing(frames: DataFrame, level: int = 15) -> DataFrame:
    """Frames (run, depth, x, w, name) with ``parent``: the name of the first frame (by x, then name) one level up (down, for those at the top) whose width holds theirs, or '-'.

    Of a level only frames matter that end behind all that begin before them; among these, the first one that ends late enough also begins first. So each
    frame looks up one frame by where it ends, and no pairs are made."""
    at = ["run", "depth"]
    ends = frames.select(*at, "x", (F.col("x") + F.col("w")).alias("_end"), "name").groupBy(*at, "x", "_end").agg(F.min("name").alias("name"))
    ends = ends.withColumn("name", F.min("name").over(Window.partitionBy(*at, "x").orderBy(F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)))
    tops = ends.groupBy(*at, "x").agg(F.max("_end").alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*at).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)))
    records = ends.join(tops, [*at, "x"]).where("_before is null or _end > _before").select("run", F.col("depth").alias("_up"), (-F.col("_end")).alias("_back"), F.struct("x", "name").alias("_frame"))
    up = F.when(F.col("depth") >= level, F.col("depth") - level).otherwise(F.col("depth") + level)
    rows = frames.withColumns({"_up": up, "_back": -(F.col("x") + F.col("w"))})
    found = as_of(rows, records, ["run", "_up"], "_back", "_frame", "_found")
    return found.withColumn("parent", F.when(F.col("_found.x") <= F.col("x"), F.col("_found.name")).otherwise("-")).select(*frames.columns, "parent")


def symbolized(addresses: DataFrame, symbols: DataFrame, by: list[str]) -> DataFrame:
    """``addresses`` (address) with the symbol that starts last at or before each, if it reaches so far; a symbol of size 0 reaches to the next one."""
    end = F.when(F.col("size") > 0, F.col("start") + F.col("size"))
    found = as_of(addresses, symbols.select(*by, F.col("start").alias("address"), F.struct("name", end.alias("end")).alias("symbol")), by, "address", "symbol", "_s")
    return found.withColumn("symbol", F.when(F.col("_s.end").isNull() | (F.col("address") < F.col("_s.end")), F.col("_s.name"))).drop("_s")


def key_values_side_by_side(kv: DataFrame, runs: list[str]) -> DataFrame:
    """grp, key (matched without case) and one column for each run."""
    return kv.groupBy(F.lower("grp").alias("grp"), F.lower("key").alias("key")).pivot("run", runs).agg(F.min("value"))


def differing_keys(kv: DataFrame, runs: DataFrame) -> DataFrame:
    """Keys whose values are not the same in all runs; a missing value, a null and an empty text are one and the same."""
    n = runs.select(F.count_distinct("run")).scalar()
    some = F.nullif(F.coalesce("value", F.lit("")), F.lit(""))
    each = kv.groupBy("grp", "key").agg(F.count_distinct(some).alias("values"), F.count_distinct(F.when(some.isNotNull(), F.col("run"))).alias("runs"))
    return each.where((F.col("values") + (F.col("runs") < n).cast("int")) > 1).select("grp", "key")


def latency_class(ns: Column) -> Column:
    return F.when(ns < 1000, 0).when(ns < 1500, 1).when(ns < 1800, 2).otherwise(3)


def latency_map(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals, and counts of each latency class, for each key; shares in percent."""
    cells = [F.count_if(F.col("class") == k).alias(f"h{k}") for k in range(4)]
    out = rows.withColumn("class", latency_class(F.col("latency"))).groupBy(*by).agg(F.sum("latency").alias("total"), F.count("*").alias("count"), *cells)
    return out.withColumns({f"share{k}": F.try_divide(F.col(f"h{k}") * 100.0, F.col("count")) for k in range(4)})


def top(rows: DataFrame, order: str, n: int, tie: list[str]) -> DataFrame:
    return rows.orderBy(F.desc(order), *tie).limit(n)
