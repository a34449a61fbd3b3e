"""Parsers of interrupt, process, memory-allocator and counter snapshots: raw(run, sample_idx, ts, payload) to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.sources.text import OUT, lines, trimmed

#: Places of a process's figures behind its name, the migrate types of page blocks, and the columns of a slab line.
PROCESS_FIELDS = {"user_time": 11, "kernel_time": 12, "threads": 17, "virtual_bytes": 20, "resident_pages": 21}
MIGRATE_TYPES = ("Unmovable", "Movable", "Reclaimable", "HighAtomic", "CMA", "Isolate")
SLAB_FIELDS = {
    "active_objs": 1, "num_objs": 2, "objsize": 3, "objperslab": 4, "pagesperslab": 5, "limit": 8,
    "batchcount": 9, "sharedfactor": 10, "active_slabs": 13, "num_slabs": 14, "sharedavail": 15,
}
SCALARS = ("MIS", "ERR")
KEYS = ("run", "sample_idx", "ts")


def _split(raw: DataFrame) -> DataFrame:
    return lines(raw).withColumn("p", F.split(trimmed(F.col("line")), r"\s+"))


def _at(k: int) -> Column:
    return F.get("p", F.lit(k))


def interrupts(raw: DataFrame) -> DataFrame:
    """A line for each interrupt under a line of CPUs; a metric for each, a series for each CPU, one series for MIS and ERR.

    A numbered interrupt is named after its description in brackets, empty ones if it has none, any other by its name and description.
    """
    rows = _split(raw)
    cpus = F.size(F.split(trimmed(F.split("payload", "\n")[0]), r"\s+"))
    rows = rows.join(raw.select("run", "sample_idx", cpus.alias("cpus")), ["run", "sample_idx"]).where((F.col("line_no") > 0) & (trimmed(F.col("line")) != ""))
    rows = rows.withColumns({"name": F.regexp_replace(_at(0), ":+$", ""), "info": F.array_join(F.slice("p", F.col("cpus") + 2, F.greatest(F.size("p"), F.lit(1))), " ")})
    scalar = F.upper("name").isin(*SCALARS)
    described = F.when(F.col("info") != "", F.concat(F.lit("("), "info", F.lit(")")))
    metric = F.when(F.col("name").rlike(r"^\d+$"), F.coalesce(described, F.lit("()"))).otherwise(F.concat_ws(" ", "name", described))
    counts = F.filter(F.transform(F.slice("p", 2, F.col("cpus")), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    rows = rows.select(*KEYS, metric.alias("metric"), scalar.alias("scalar"), F.posexplode(F.when(scalar, F.slice(counts, 1, 1)).otherwise(counts)).alias("k", "value"))
    return rows.withColumn("series", F.when(F.col("scalar"), F.col("metric")).otherwise(F.concat(F.lit("CPU"), "k"))).select(*OUT)


def processes(raw: DataFrame, page_size: int = 0) -> DataFrame:
    """Lines ``pid (name) state …`` with 22 figures or more; series ``pid_name``. With a page size, resident_bytes too."""
    parts = [F.regexp_extract("line", r"^(\d+) \(([^)]*)\) (.*)$", k) for k in (1, 2, 3)]
    rows = lines(raw).withColumns({"series": F.concat_ws("_", *parts[:2]), "p": F.split(trimmed(parts[2]), r"\s+")}).where(F.size("p") >= 22)
    figures = {m: _at(k).try_cast("double") for m, k in PROCESS_FIELDS.items()}
    if page_size:
        figures["resident_bytes"] = figures["resident_pages"] * page_size
    rows = rows.where(figures["user_time"].isNotNull() & figures["kernel_time"].isNotNull())
    found = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in figures.items()])
    return rows.select(*KEYS, "series", F.inline(found)).where("value is not null").select(*OUT)


def _words(payload: str) -> Column:
    """The parts of each line of a payload."""
    return F.transform(F.split(payload, "\n"), lambda line: F.split(trimmed(line), r"\s+"))


ENTRY = "array<struct<metric:string,series:string,value:double>>"


def _entries(some: Column, entries: Column) -> Column:
    return F.when(some, entries).otherwise(F.array().cast(ENTRY))


def _entry(metric: Column, series: Column, value: Column) -> Column:
    return F.struct(metric.alias("metric"), series.alias("series"), value.try_cast("double").alias("value"))


def _numbered(p: Column, first: int, metric: Callable[[Column], Column], series: Column) -> Column:
    """Entries of the parts from ``first`` on, named by their place."""
    return F.transform(F.slice(p, first + 1, F.greatest(F.size(p) - first, F.lit(0))), lambda x, k: _entry(metric(k), series, x))


def _node_zone(p: Column) -> Column:
    return F.concat(F.lit("node_"), F.regexp_replace(F.get(p, 1), ",+$", ""), F.lit("_zone_"), F.regexp_replace(F.get(p, 3), ",+$", ""))


def _buddies(p: Column) -> Column:
    return _entries(F.size(p) >= 5, _numbered(p, 4, lambda k: F.concat(F.lit("buddyinfo_order_"), k), _node_zone(p)))


def _page_types(p: Column) -> Column:
    node = F.get(p, 0) == "Node"
    free = _entries(node & (F.size(p) >= 6) & (F.get(p, 4) == "type"), _numbered(p, 6, lambda k: F.concat(F.lit("pagetype_order_"), k, F.lit("_type_"), F.get(p, 5)), _node_zone(p)))
    names, zone = F.array(*map(F.lit, MIGRATE_TYPES)), F.concat(F.lit("zone_"), F.regexp_replace(F.get(p, 3), ",+$", ""))
    blocks = _numbered(F.slice(p, 1, 4 + len(MIGRATE_TYPES)), 4, lambda k: F.concat(F.lit("pageblocks_type_"), F.get(names, k)), zone)
    return F.concat(free, _entries(node & (F.size(p) >= 8) & (F.get(p, 2) == "zone"), blocks))


def _slabs(p: Column) -> Column:
    return _entries(F.size(p) >= 16, F.array(*[_entry(F.lit(f"slabinfo_{m}"), F.get(p, 0), F.get(p, k)) for m, k in SLAB_FIELDS.items()]))


def _below_head(payload: str) -> Column:
    """The parts of the lines below the first one that begins with ``# name``; none without one."""
    head = F.array_position(F.transform(F.split(payload, "\n"), lambda x: x.startswith("# name")), True)
    return F.when(head > 0, F.slice(_words(payload), F.greatest(head, F.lit(1)).cast("int") + 1, F.size(F.split(payload, "\n"))))


def _found(raw: DataFrame, *entries: Column) -> DataFrame:
    every = F.concat(*[F.coalesce(F.flatten(e), F.array().cast(ENTRY)) for e in entries])
    return raw.select(*KEYS, F.inline(F.filter(every, lambda x: x["value"].isNotNull()))).select(*OUT)


def buddies(raw: DataFrame) -> DataFrame:
    """Lines ``Node n, zone z c0 c1 …``: free blocks of each order."""
    return _found(raw, F.transform(_words("payload"), _buddies))


def page_types(raw: DataFrame) -> DataFrame:
    """Free pages of each order and migrate type, and page blocks of each migrate type."""
    return _found(raw, F.transform(_words("payload"), _page_types))


def slabs(raw: DataFrame) -> DataFrame:
    """Lines of 16 parts or more below the line ``# name``; a series for each slab."""
    return _found(raw, F.transform(_below_head("payload"), _slabs))


def memory(raw: DataFrame) -> DataFrame:
    """All three in one pass: payloads buddyinfo, pagetypeinfo and slabinfo side by side; a null one has no points."""
    return _found(raw, F.transform(_words("buddyinfo"), _buddies), F.transform(_words("pagetypeinfo"), _page_types), F.transform(_below_head("slabinfo"), _slabs))


def counters(raw: DataFrame) -> DataFrame:
    """Lines ``cpu;event;v1;…;enabled;running``: run, sample_idx, ts, cpu, event, counts, enabled, running. A line with a bad number is left out."""
    rows = lines(raw).withColumn("p", F.split("line", ";")).where(F.size("p") >= 5)
    counts = F.transform(F.slice("p", 3, F.size("p") - 4), lambda x: x.try_cast("long").try_cast("double"))
    tail = [F.element_at("p", k).try_cast("double") for k in (-2, -1)]
    rows = rows.select(*KEYS, _at(0).try_cast("int").alias("cpu"), _at(1).alias("event"), counts.alias("counts"), tail[0].alias("enabled"), tail[1].alias("running"))
    return rows.where("cpu is not null and enabled is not null and running is not null and forall(counts, x -> x is not null)")


def settings(raw: DataFrame) -> DataFrame:
    """Snapshots with a map ``entries`` as run, grp, key, value; the latest of repeated keys holds."""
    rows = raw.select("run", "sample_idx", F.explode("entries").alias("key", "value"))
    return rows.groupBy("run", "key").agg(F.max_by("value", "sample_idx").alias("value")).select("run", F.lit("").alias("grp"), "key", "value")
