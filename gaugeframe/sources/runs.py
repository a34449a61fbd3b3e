"""Where runs come from: folders, archives and earlier reports; their metadata, files and lines."""

from __future__ import annotations

import calendar
import io
import json
import os
import re
import struct
import tarfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "run string, file string, content binary"
META = "time_now string, start_time long, end_time long, page_size long, pmu_mode string, collector_pid long, subprocess_pids array<long>"


def unique_names(names: list[str]) -> list[str]:
    """Names of runs, later ones of a name numbered _1, _2 … past those that are taken."""
    out: list[str] = []
    for name in names:
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def is_archive(path: str) -> bool:
    return path.endswith((".tar.gz", ".tgz"))


def run_name(path: str) -> str:
    return re.sub(r"\.(tar\.gz|tgz)$", "", os.path.basename(path.rstrip("/")))


def files_of(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """run, file, content of all files of runs given as folders or .tar.gz archives, one task an archive or file; the first path is the base run. Empty files are left out."""
    parts = []
    for path, name in zip(paths, unique_names([run_name(p) for p in paths]), strict=True):
        if is_archive(path):
            parts.append(spark.read.format("binaryFile").load(path).select(F.lit(name).alias("run"), "content").mapInPandas(_unpacked, FILES))
        else:
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
            file = F.regexp_replace(F.col("path"), "^.*?" + re.escape(path.rstrip("/").removeprefix("file:")) + "/", "")
            parts.append(rows.select(F.lit(name).alias("run"), file.alias("file"), "content"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where(F.length("content") > 0)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for run, content in zip(b["run"], b["content"], strict=True):
            if content[:2] != b"\x1f\x8b":
                raise ValueError(f"{run} is not a gzip archive")
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for member in tar:
                    if member.isfile():
                        yield pd.DataFrame({"run": [run], "file": [member.name.partition("/")[2] or member.name], "content": [tar.extractfile(member).read()]})


def data_file(file: Column, name: str, legacy: tuple[str, ...] = ()) -> Column:
    """Whether a file holds the source ``name``: ``name.bin``, ``name_….bin``, or one of its older names."""
    base = F.regexp_replace(file, "^.*/", "")
    return base.rlike(rf"^{re.escape(name)}(_.*)?\.bin$") | base.isin(*legacy) if legacy else base.rlike(rf"^{re.escape(name)}(_.*)?\.bin$")


def metadata(files: DataFrame, file: str = "meta_data.json") -> DataFrame:
    """run, start_ms, end_ms, page_size, pmu_mode, pids (of the collector and its subprocesses) from each run's JSON."""
    rows = files.where(F.regexp_replace("file", "^.*/", "") == file).select("run", F.from_json(F.decode("content", "utf-8"), META).alias("m"))
    pids = F.array_union(F.array("m.collector_pid"), F.coalesce("m.subprocess_pids", F.array().cast("array<long>")))
    return rows.select("run", F.col("m.start_time").alias("start_ms"), F.col("m.end_time").alias("end_ms"), F.col("m.page_size").alias("page_size"), F.col("m.pmu_mode").alias("pmu_mode"), F.filter(pids, lambda p: p.isNotNull()).alias("pids"))


def records(files: DataFrame, name: str) -> DataFrame:
    """run, sample_idx, ts, payload of a source's log: framed records of a 64-bit time in milliseconds, a 32-bit length and a UTF-8 payload, little-endian. Reading stops silently at
    a record that is cut short, as the last one of a killed recorder is. One task reads one file, record by record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name_, content in zip(b["run"], b["content"], strict=True):
                at, k, rows = 0, 0, []
                while at + 12 <= len(content):
                    ts, size = int.from_bytes(content[at : at + 8], "little", signed=True), int.from_bytes(content[at + 8 : at + 12], "little")
                    if at + 12 + size > len(content):
                        break
                    rows.append((name_, k, ts, content[at + 12 : at + 12 + size].decode("utf-8", "replace")))
                    at, k = at + 12 + size, k + 1
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["run", "sample_idx", "ts", "payload"])
                        rows = []
                yield pd.DataFrame(rows, columns=["run", "sample_idx", "ts", "payload"])

    return files.where(data_file(F.col("file"), name)).select("run", "content").mapInPandas(run, "run string, sample_idx long, ts long, payload string")


#: What stands in a record of a source's log behind its kind and time, in order; sources that are not listed have one text.
SHAPES = {
    "processes": {"ticks_per_second": "u64", "payload": "text"},
    "memalloc": {"buddyinfo": "text", "pagetypeinfo": "text", "slabinfo": "text"},
    "self_stats": {"stats": "stats"},
    "legacy_self_stats": {"name": "text", "counts": "counts"},
}
#: Sources whose records have no number of their kind.
KINDLESS = ("self_stats", "legacy_self_stats")
COLUMN = {"u64": "long", "text": "string", "stats": "map<string,map<string,double>>", "counts": "map<string,long>"}


class _Cursor:
    """Reads little-endian fields one after the other; at the end of the bytes it raises EOFError."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0

    def take(self, n: int) -> bytes:
        if n > len(self.content) - self.at:
            raise EOFError
        self.at += n
        return self.content[self.at - n : self.at]

    def number(self, size: int = 8) -> int:
        return int.from_bytes(self.take(size), "little")

    def text(self) -> str:
        return self.take(self.number()).decode("utf-8")

    def stats(self) -> dict[str, dict[str, float]]:
        return {self.text(): {self.text(): struct.unpack("<d", self.take(8))[0] for _ in range(self.number())} for _ in range(self.number())}

    def counts(self) -> dict[str, int]:
        return {self.text(): self.number() for _ in range(self.number())}

    def time(self) -> int:
        """Milliseconds since 1970: a kind of 0 stands for the text of a moment, 1 for seconds."""
        kind = self.number(4)
        if kind > 1:
            raise ValueError(f"no kind of time: {kind}")
        return self.number() * 1000 if kind else _milliseconds(self.text())


def _milliseconds(moment: str) -> int:
    """Of a moment in UTC, with any number of digits behind the seconds."""
    whole, _, part = moment.rstrip("Z").partition(".")
    return calendar.timegm(time.strptime(whole, "%Y-%m-%dT%H:%M:%S")) * 1000 + int(part[:3].ljust(3, "0"))


def log_records(files: DataFrame, name: str, shape_of: str | None = None, kinds: int = 256) -> DataFrame:
    """run, sample_idx, ts (milliseconds) and the fields of a source's shape (``payload`` for most), of its logs as the recorder writes them: for each record a 32-bit number of its kind (below
    ``kinds``; not for KINDLESS sources), the time, and the fields; texts and maps have a 64-bit length before them. ``name`` is that of the files, ``shape_of`` the source's if that differs. Reading stops silently at a record that is cut short or can't be read. One task
    reads one file, record by record."""
    source = shape_of or name
    shape, kindless = SHAPES.get(source, {"payload": "text"}), source in KINDLESS
    columns = ["run", "sample_idx", "ts", *shape]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name_, content in zip(b["run"], b["content"], strict=True):
                cursor, k, rows = _Cursor(content), 0, []
                read = {"u64": cursor.number, "text": cursor.text, "stats": cursor.stats, "counts": cursor.counts}
                try:
                    while kindless or cursor.number(4) < kinds:
                        rows.append((name_, k, cursor.time(), *[read[t]() for t in shape.values()]))
                        k += 1
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (EOFError, ValueError):
                    pass
                yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(["run string, sample_idx long, ts long", *[f"{c} {COLUMN[t]}" for c, t in shape.items()]])
    return files.where(data_file(F.col("file"), name)).select("run", "content").mapInPandas(run, schema)


def since_first(records_: DataFrame) -> DataFrame:
    """Records with ``ts`` in whole seconds since the first one of their run, as sources take them."""
    first = records_.groupBy("run").agg(F.min("ts").alias("_first"))
    return records_.join(F.broadcast(first), "run").withColumn("ts", F.floor((F.col("ts") - F.col("_first")) / 1000).cast("long")).drop("_first")  # a row for each run


def valid_runs(files: DataFrame, names: list[str]) -> DataFrame:
    """run and the number of readable sources; a run without any is left out."""
    hits = [F.bool_or(data_file(F.col("file"), n) & (F.length("content") > 0)).cast("int") for n in names]
    return files.groupBy("run").agg(sum(hits[1:], hits[0]).alias("sources")).where("sources > 0")


def pmu_configuration(base: str, model: str | None = None) -> dict[str, dict[str, str]]:
    """Events and metrics of a JSON text, extended and overridden by those of the CPU model."""
    out = json.loads(base)
    for kind, entries in (json.loads(model) if model else {}).items():
        out.setdefault(kind, {}).update(entries)
    return out


def variables(texts: DataFrame) -> DataFrame:
    """(name, json) of report files (value): what stands before the first ``=`` and the JSON behind it."""
    name = F.regexp_extract("value", r"^\s*(?:var\s+|const\s+|let\s+)?(\w+)\s*=", 1)
    return texts.select(name.alias("name"), F.regexp_replace("value", r"^\s*(?:var\s+|const\s+|let\s+)?\w+\s*=\s*|;?\s*$", "").alias("json")).where("name <> ''")


SERIES = "struct<metric_name:string,series:array<struct<series_name:string,time_diff:array<long>,values:array<double>,is_aggregate:boolean>>>"


def points_of(reports: DataFrame) -> DataFrame:
    """Points of reports' ``processed_X_data`` variables (name, json)."""
    data = F.from_json("json", f"struct<data_name:string,data_format:string,runs:map<string,struct<metrics:map<string,{SERIES}>>>>")
    rows = reports.where(F.col("name").rlike("^processed_.*_data$")).select(data.alias("d")).where("d.data_format = 'time_series'")
    rows = rows.select("d.data_name", F.explode("d.runs").alias("run", "r")).select("data_name", "run", F.explode("r.metrics").alias("metric", "m")).select("data_name", "run", "metric", F.explode("m.series").alias("s"))
    rows = rows.select("data_name", "run", "metric", F.col("s.series_name").alias("series"), F.coalesce("s.is_aggregate", F.lit(False)).alias("is_aggregate"), F.posexplode(F.arrays_zip("s.time_diff", "s.values")).alias("sample_idx", "p"))
    return rows.select("data_name", "run", "metric", "series", F.col("sample_idx").cast("long").alias("sample_idx"), F.col("p.time_diff").alias("time_diff"), F.col("p.values").alias("value"), "is_aggregate").where("value is not null")


def findings_of(reports: DataFrame) -> DataFrame:
    """data_name, run, key, rule_name, score, description, message of reports' ``X_findings`` variables."""
    one = "struct<rule_name:string,score:double,description:string,message:string>"
    data = F.from_json("json", f"struct<per_run_findings:map<string,struct<findings:map<string,array<{one}>>>>>")
    rows = reports.where(F.col("name").endswith("_findings")).select(F.regexp_replace("name", "_findings$", "").alias("data_name"), F.explode(data["per_run_findings"]).alias("run", "f"))
    return rows.select("data_name", "run", F.explode("f.findings").alias("key", "list")).select("data_name", "run", "key", F.inline("list"))


def runs_of(reports: DataFrame) -> DataFrame:
    """run, place, start_ms, end_ms of the variable ``runs_raw``: a list of names (the older shape) or of objects."""
    rows = reports.where(F.col("name") == "runs_raw")
    names = rows.select(F.posexplode(F.from_json("json", "array<string>")).alias("place", "x"))
    at = "struct<name:string,collection_start_ms:long,collection_end_ms:long>"
    parsed = names.withColumn("o", F.when(F.col("x").startswith("{"), F.from_json("x", at)))
    return parsed.select(F.coalesce("o.name", "x").alias("run"), "place", F.col("o.collection_start_ms").alias("start_ms"), F.col("o.collection_end_ms").alias("end_ms"))


def catalog(points: DataFrame) -> DataFrame:
    """data_name and the metrics of the first run by name."""
    first = points.groupBy("data_name").agg(F.min("run").alias("run"))
    return points.join(first, ["data_name", "run"], "left_semi").select("data_name", "metric").distinct()


def check_report(names: list[str]) -> None:
    """A report has its runs, its version and three files of data or more."""
    if not {"runs_raw", "version_info"} <= set(names) or sum(n.startswith("processed_") for n in names) < 3:
        raise ValueError("not a report")


def flame_frames(svgs: DataFrame) -> DataFrame:
    """run, name, samples, pct, x, depth, w of flame graphs (run, svg); the frame of all is left out."""
    number = r'"(-?[0-9.]+)"'
    part = r"<title>(.*?) \(([0-9,]+) samples?, ([0-9.]+)%\)</title>\s*<rect x=" + number + r"\s+y=" + number + r"\s+width=" + number
    take = lambda k: F.regexp_extract_all("svg", F.lit(part), F.lit(k))
    rows = svgs.select("run", F.explode(F.arrays_zip(*[take(k).alias(c) for k, c in enumerate(("name", "samples", "pct", "x", "depth", "w"), 1)])).alias("f")).select("run", "f.*")
    return rows.where("name <> 'all'").select("run", "name", F.replace("samples", F.lit(","), F.lit("")).cast("long").alias("samples"), *[F.col(c).cast("double").alias(c) for c in ("pct", "x", "depth", "w")])


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _symbol_lines(texts: DataFrame, second: str) -> DataFrame:
    rows = texts.select("run", F.explode(F.split("payload", "\n")).alias("line"))
    part = lambda k: F.regexp_extract("line", rf"^\s*(?:0x)?([0-9A-Fa-f]+)\s+{second}\s+(.+?)\s*$", k)
    return rows.select("run", F.conv(part(1), 16, 10).try_cast("long").alias("start"), part(2).alias("second"), part(3).alias("name")).where("name <> '' and start is not null")


def jit_symbols(texts: DataFrame) -> DataFrame:
    """run, start, size, name from lines ``start size name`` with hexadecimal numbers."""
    return _symbol_lines(texts, "(?:0x)?([0-9A-Fa-f]+)").select("run", "start", F.conv("second", 16, 10).try_cast("long").alias("size"), "name")


def kernel_symbols(texts: DataFrame) -> DataFrame:
    """run, start, size (0: unknown), name of functions (types t, T, w, W) from lines ``start type name [module]``."""
    rows = _symbol_lines(texts, "([A-Za-z])").where(F.lower("second").isin("t", "w"))
    return rows.select("run", "start", F.lit(0).cast("long").alias("size"), F.regexp_replace("name", r"\s.*$", "").alias("name"))
