"""Profiles as paths: samples(run, block, thread_state, path ARRAY<STRING>, count). Tree questions become prefix aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stacks(samples: DataFrame, backward: bool = False) -> DataFrame:
    """run, stack (its hash), path, count: each stack with frames once."""
    path = F.reverse("path") if backward else F.col("path")
    return samples.where(F.size("path") > 0).groupBy("run", path.alias("path")).agg(F.sum("count").alias("count")).withColumn("stack", F.xxhash64("path"))


def in_range(samples: DataFrame, begin: int, end: int) -> DataFrame:
    """Blocks begin <= block < end."""
    return samples.where((F.col("block") >= begin) & (F.col("block") < end))


def nodes(samples: DataFrame, backward: bool = False) -> DataFrame:
    """Self and total count of every node of the call tree (of callers, if backward), with its path."""
    from gaugeframe.operators import calltree

    return calltree.with_paths(calltree.tree(samples, backward), samples, backward).select("run", "node", "total", "self")


def frames(samples: DataFrame) -> DataFrame:
    """Self and total of every function; a recursive one counts once a stack."""
    rows = samples.groupBy("run", "path").agg(F.sum("count").alias("count")).withColumn("frame", F.explode(F.array_distinct("path")))
    leaf = F.when(F.col("frame") == F.element_at("path", -1), F.col("count")).otherwise(0)
    return rows.groupBy("run", "frame").agg(F.sum("count").alias("total"), F.sum(leaf).alias("self"))


def collapsed(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run", F.concat_ws(";", "path").alias("stack")).agg(F.sum("count").alias("count"))


def anchored(patterns: list[str], frame_type: str | None = None) -> list[str]:
    """Regular expressions of whole frames: each pattern with the ending of any kind of code or none; the last with that of ``frame_type``, if one is given."""
    any_ = r"(_\[(0|j|i|k|1|v)\])?"
    own = any_ if frame_type is None else ENDINGS.get(frame_type, "").replace("[", r"\[").replace("]", r"\]")
    return [f"^{p}{any_}$" for p in patterns[:-1]] + [f"^{patterns[-1]}{own}$"]


def matches(samples: DataFrame, patterns: list[str], frame_type: str | None = None, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Counts of stacks that hold whole frames by the patterns in this order: ``total``, and ``self`` where the last one is the leaf. Each distinct stack is matched once."""
    step = lambda pats, path: F.aggregate(path, F.lit(0), lambda k, f: k + F.coalesce(*[F.when((k == i) & f.rlike(p), 1) for i, p in enumerate(pats)], F.lit(0)))
    wanted, n = anchored(patterns, frame_type), len(patterns)
    rows = samples.groupBy(*by, "path").agg(F.sum("count").alias("count"))
    whole = step(wanted, F.col("path")) == n
    head = F.lit(True) if n == 1 else step(wanted[:-1], F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))) == n - 1
    last = F.try_element_at("path", F.lit(-1)).rlike(wanted[-1]) & head
    return rows.groupBy(*by).agg(F.sum(F.when(whole, F.col("count")).otherwise(0)).alias("total"), F.sum(F.when(last, F.col("count")).otherwise(0)).alias("self"))


def flame(samples: DataFrame) -> DataFrame:
    """Nodes with their place among siblings: ``x`` is the running total of the larger ones."""
    rows = nodes(samples).withColumn("parent", F.slice("node", 1, F.size("node") - 1))
    order = Window.partitionBy("run", "parent").orderBy(F.desc("total"), F.element_at("node", -1)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("x", F.coalesce(F.sum("total").over(order), F.lit(0)))


def difference(frames_: DataFrame, base_run: str) -> DataFrame:
    """Share of self samples of each function in every run against the base run; a function that a run or the base lacks has share 0 there."""
    whole = frames_.groupBy("run").agg(F.sum("self").alias("_all"))
    shares = frames_.join(whole, "run").withColumn("share", F.coalesce(F.try_divide(F.col("self") * 100.0, F.col("_all")), F.lit(0.0)))
    others = [r["run"] for r in whole.where(F.col("run") != base_run).select("run").collect()]  # a row for each run
    base = shares.where(F.col("run") == base_run).select(F.explode(F.array(*map(F.lit, others)).cast("array<string>")).alias("run"), "frame", F.col("share").alias("base_share"))
    out = shares.where(F.col("run") != base_run).select("run", "frame", "share").join(base, ["run", "frame"], "full").na.fill(0.0, ["share", "base_share"])
    return out.withColumn("delta", F.col("share") - F.col("base_share"))


def largest_differences(difference_: DataFrame, n: int) -> DataFrame:
    return difference_.orderBy(F.abs("delta").desc(), "run", "frame").limit(n)


#: Endings of frame names by kind of code, and the states of threads.
ENDINGS = {"interpreted": "_[0]", "compiled": "_[j]", "inlined": "_[i]", "kernel": "_[k]", "c1": "_[1]", "vdso": "_[v]"}
STATES = {"default": 0, "running": 1, "sleeping": 2, "waiting": 3}


def frame_kind(frame: Column) -> Column:
    """The kind of code that a frame's last four characters name, else native."""
    return F.coalesce(*[F.when(F.right(frame, F.lit(4)) == e, F.lit(k)) for k, e in ENDINGS.items()], F.lit("native"))


def plain_name(frame: Column) -> Column:
    """A frame without the ending that names its kind."""
    return F.when(F.right(frame, F.lit(4)).isin(*ENDINGS.values()), F.left(frame, F.length(frame) - 4)).otherwise(frame)


def in_states(samples: DataFrame, states: tuple[int, ...] = ()) -> DataFrame:
    """Samples in the given states of threads; none given stands for all but the default one."""
    return samples.where(F.col("thread_state").isin(*(states or (1, 2, 3))))


def total_samples(samples: DataFrame, states: tuple[int, ...] = ()) -> DataFrame:
    """Samples of each run in the given states; runs without any have 0."""
    runs = samples.select("run").distinct()
    return runs.join(in_states(samples, states).groupBy("run").agg(F.sum("count").alias("samples")), "run", "left").na.fill(0, ["samples"])


def block_of(ms: Column, start_ms: Column, width: int = 20) -> Column:
    """The block of time that a moment falls into; blocks are aligned to their width."""
    return F.floor(F.greatest(ms - (start_ms - F.pmod(start_ms, F.lit(width))), F.lit(0)) / width).cast("long")


def block_range(begin_ms: int, end_ms: int, width: int = 20) -> tuple[int, int]:
    """Blocks (from, to) that a half-open range of milliseconds since the start spans."""
    return max(0, begin_ms) // width, max(0, end_ms) // width


def heat(samples: DataFrame, blocks: int) -> DataFrame:
    """Samples by run in cells of so many blocks, and as a share of the run's fullest cell."""
    cells = samples.groupBy("run", F.expr(f"block div {blocks}").alias("cell")).agg(F.sum("count").alias("samples"))
    most = cells.groupBy(F.col("run").alias("_run")).agg(F.max("samples").alias("_most"))
    return cells.join(most, F.col("run").eqNullSafe(F.col("_run"))).select("run", "cell", "samples", F.try_divide("samples", "_most").alias("heat"))


def top_functions(samples: DataFrame, n: int) -> DataFrame:
    """The ``n`` functions of each run with the most self samples, with their shares of all samples in percent."""
    every = samples.groupBy("run").agg(F.sum("count").alias("_all"))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("self"), "frame"))
    rows = frames(samples).withColumn("_k", rank).where(F.col("_k") <= n).join(every, "run")
    return rows.select("run", "frame", "self", "total", (F.col("self") * 100.0 / F.col("_all")).alias("self_percent"), (F.col("total") * 100.0 / F.col("_all")).alias("total_percent"))


def search(nodes_: DataFrame, pattern: str) -> DataFrame:
    """Nodes of each run whose function matches, and their self samples."""
    return nodes_.where(F.element_at("node", -1).rlike(pattern)).groupBy("run").agg(F.count("*").alias("nodes"), F.sum("self").alias("samples"))


def flame_top(flame_: DataFrame, n: int, least_percent: float = 0.0, pattern: str | None = None) -> DataFrame:
    """The largest ``n`` nodes over all runs by their share of the run's samples, with their depth and parent."""
    every = flame_.where(F.size("node") == 1).groupBy("run").agg(F.sum("total").alias("_all"))
    rows = flame_.join(every, "run").withColumns({"percent": F.col("total") * 100.0 / F.col("_all"), "name": F.element_at("node", -1), "depth": F.size("node") - 1})
    rows = rows.withColumn("parent", F.coalesce(F.try_element_at("node", F.greatest(F.col("depth"), F.lit(1))), F.lit("-"))).where(F.col("percent") >= least_percent)
    rows = rows.withColumn("parent", F.when(F.col("depth") == 0, "-").otherwise(F.col("parent")))
    rows = rows if pattern is None else rows.where(F.col("name").rlike(pattern))
    return rows.orderBy(F.desc("percent"), "run", F.concat_ws(";", "node")).limit(n).select("run", "name", F.col("total").alias("samples"), "percent", "depth", "parent")


#: Fixed value: percentage points under which a function counts as unchanged.
UNCHANGED = 0.01


def function_deltas(samples: DataFrame, base_run: str) -> DataFrame:
    """Functions of the other runs against the base run's: share of all samples with the function on the stack in percent, ``delta`` to the base (0 there if it lacks the
    function), and ``normal``, the delta over the greatest one of the run; deltas under UNCHANGED in size count as none."""
    every = samples.groupBy("run").agg(F.sum("count").alias("_all"))
    shares = frames(samples).join(every, "run").select("run", "frame", "total", (F.col("total") * 100.0 / F.col("_all")).alias("percent"))
    base = shares.where(F.col("run") == base_run).select("frame", F.col("percent").alias("base_percent"))
    out = shares.where(F.col("run") != base_run).join(base, "frame", "left").na.fill(0.0, ["base_percent"]).withColumn("delta", F.col("percent") - F.col("base_percent"))
    moved = F.when(F.abs("delta") >= UNCHANGED, F.col("delta")).otherwise(0.0)
    most = out.groupBy("run").agg(F.max(F.abs(moved)).alias("_most"))
    return out.join(most, "run").withColumn("normal", F.coalesce(F.try_divide(moved, "_most"), F.lit(0.0))).select("run", "frame", "percent", "base_percent", "delta", "normal")


def against_base(nodes_: DataFrame, base_run: str) -> DataFrame:
    """Nodes of the other runs against the base run's by path: change in samples and in percentage points of all, and that change over the greatest one of its run."""
    all_ = nodes_.where(F.size("node") == 1).groupBy("run").agg(F.sum("total").alias("_all"))
    rows = nodes_.join(all_, "run").select("run", "node", "total", (F.col("total") * 100.0 / F.col("_all")).alias("percent"))
    base = rows.where(F.col("run") == base_run).select("node", F.col("total").alias("b_total"), F.col("percent").alias("b_percent"))
    out = rows.where(F.col("run") != base_run).join(base, "node", "left").na.fill(0, ["b_total", "b_percent"])
    out = out.select("run", "node", (F.col("total") - F.col("b_total")).alias("samples"), (F.col("percent") - F.col("b_percent")).alias("points"))
    most = out.groupBy("run").agg(F.max(F.abs("points")).alias("_most"))
    small = F.col("_most") < 2.220446049250313e-16
    return out.join(most, "run").withColumn("normal", F.when(small, 0.0).otherwise(F.try_divide("points", "_most"))).drop("_most")


def stack_text(samples: DataFrame) -> DataFrame:
    """One line a sample: ``ms|pid|a;b;c``."""
    return samples.select(F.concat_ws("|", F.col("ms").cast("string"), F.col("pid").cast("string"), F.concat_ws(";", "path")).alias("line"))
