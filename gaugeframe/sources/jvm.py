"""Events of Java virtual machines: frames from constant pools, kinds of events, settings and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Events by the kinds of profile that they belong to, frame types and the endings of their names, types of arrays in descriptors.
KINDS = {"jdk.ExecutionSample": "cpu", "jdk.NativeMethodSample": "wall", "profiler.WallClockSample": "wall", "profiler.ExecutionSample": "cpu", "jdk.ObjectAllocationInNewTLAB": "alloc", "jdk.ObjectAllocationOutsideTLAB": "alloc"}
ENDINGS = {"Interpreted": "_[0]", "JIT compiled": "_[j]", "Inlined": "_[i]", "Kernel": "_[k]", "C1 compiled": "_[1]"}
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}


def profile_kind(event: Column) -> Column:
    """cpu, wall or alloc; null for events of no profile."""
    return F.coalesce(*[F.when(event == e, F.lit(k)) for e, k in KINDS.items()])


def class_name(descriptor: Column) -> Column:
    """A class as it is written: dots, primitives and arrays spelt out."""
    depth = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))
    inner = F.regexp_replace(descriptor, r"^\[+", "")
    primitive = F.coalesce(*[F.when(inner == c, F.lit(n)) for c, n in PRIMITIVES.items()])
    plain = F.replace(F.regexp_replace(inner, "^L(.*);$", "$1"), F.lit("/"), F.lit("."))
    return F.concat(F.when(depth > 0, F.coalesce(primitive, plain)).otherwise(plain), F.repeat(F.lit("[]"), depth))


def frame_name(class_: Column, method: Column, kind: Column) -> Column:
    """class.method with the ending of its kind of code; a frame of an unknown method is ``unknown``."""
    name = F.when(F.coalesce(class_, F.lit("")) == "", method).otherwise(F.concat(F.replace(class_, F.lit("/"), F.lit(".")), F.lit("."), method))
    return F.concat(F.coalesce(name, F.lit("unknown")), F.coalesce(*[F.when(kind == k, F.lit(e)) for k, e in ENDINGS.items()], F.lit("")))


def milliseconds(ticks: Column, start: Column, per_second: Column) -> Column:
    return F.floor((ticks - start) * 1000 / per_second).cast("long")


def since_boot(ns: Column, boot_ms: Column) -> Column:
    """A sample's clock as wall-clock milliseconds."""
    return F.floor(ns / 1_000_000).cast("long") + boot_ms


def stacks(events: DataFrame, traces: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Events (run, event, trace, ticks, …) with ``path``, outermost frame first: traces(run, trace, frames of (method, kind), innermost first), methods(run,
    method, class, name), classes(run, class, name). Names are looked up once for each trace; a trace that is missing has no frames."""
    rows = traces.select("run", "trace", F.posexplode("frames").alias("depth", "f")).select("run", "trace", "depth", F.col("f.method").alias("method"), F.col("f.kind").alias("kind"))
    rows = rows.join(methods.select("run", "method", "class", F.col("name").alias("m")), ["run", "method"], "left").join(classes.select("run", "class", F.col("name").alias("c")), ["run", "class"], "left")
    named = rows.withColumn("frame", frame_name(F.col("c"), F.col("m"), F.col("kind"))).groupBy("run", "trace").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("depth", "frame"))), lambda x: x["frame"])).alias("path"))
    return events.join(named, ["run", "trace"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>"))).withColumn("kind", profile_kind(F.col("event")))


def numbered_names(processes: DataFrame) -> DataFrame:
    """run, pid, name: the second process of a name is ``name (1)``, and so on, by pid."""
    k = F.row_number().over(Window.partitionBy("run", "name").orderBy("pid")) - 1
    return processes.withColumn("_k", k).select("run", "pid", F.when(F.col("_k") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "_k", F.lit(")"))).alias("name"))


def process_names(maps: DataFrame) -> DataFrame:
    """JSON texts (run, payload) of pid -> [names] as run, pid, name of the first name."""
    rows = maps.select("run", F.explode(F.from_json("payload", "map<string,array<string>>")).alias("pid", "names"))
    return rows.select("run", F.col("pid").try_cast("long").alias("pid"), F.get("names", F.lit(0)).alias("name")).where("pid is not null and name is not null")


def settings(rows: DataFrame) -> DataFrame:
    """run, event, value: the settings (name, value) of each event, a line each, in order of their names."""
    line = F.concat_ws(": ", "name", "value")
    return rows.groupBy("run", "event").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))


def metadata(texts: DataFrame, groups: tuple[str, ...] = ("jdk.JVMInformation", "jdk.OSInformation", "jdk.CPUInformation")) -> DataFrame:
    """JSON texts (run, profiler, payload) of event -> field -> value as run, profiler, grp, key, value, for the given events."""
    rows = texts.select("run", "profiler", F.explode(F.from_json("payload", "map<string,map<string,string>>")).alias("grp", "fields"))
    return rows.where(F.col("grp").isin(*groups)).select("run", "profiler", "grp", F.explode("fields").alias("key", "value"))


def callchains(samples: DataFrame) -> DataFrame:
    """Samples (id, run, pid, ms, chain) as one row a frame: id, run, pid, ms, depth, address. Marks of a change of context (the top of the address range) are no frames."""
    rows = samples.select("id", "run", "pid", "ms", F.posexplode("chain").alias("depth", "address"))
    return rows.where((F.col("address") >= 0) | (F.col("address") < -4096))
