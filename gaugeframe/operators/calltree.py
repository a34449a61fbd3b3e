"""Call trees with interned nodes: (run, id, parent, frame, depth, total, self), no paths.

A node's id is a hash of its whole path, made from the frames by doubling: after step k, each place of a stack knows a hash of the last 2**k frames up to
it. So a stack of depth d gives d rows of fixed size, where prefixes would give d of up to d frames, and one aggregation makes the tree. What depends on all
ancestors (place in the layout, state of a pattern, path of a stored tree) is combined along parent pointers by pointer jumping: as many joins as
the logarithm of the depth, each over one row a node, the lineage cut after each. Ids have 64 bits, told apart by parent, frame and depth besides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.operators.profile import anchored, stacks
from gaugeframe.operators.shared import kept


def tree(samples: DataFrame, backward: bool = False) -> DataFrame:
    """The call tree of each run (of callers, if backward): run, id, parent (null at the top), frame, depth (from 1), total, self, and ``stack``, the hash of one
    of the stacks that have the node. Empty stacks have no nodes."""
    rows = stacks(samples, backward)
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 1
    ids, span = F.transform("path", lambda f: F.xxhash64(f)), 1
    rows = rows.withColumn("ids", ids)
    while span < deepest:  # a projection for each doubling, so expressions stay small
        shifted = F.slice(F.concat(F.array_repeat(F.lit(None).cast("long"), span), F.col("ids")), 1, F.size("ids"))
        rows = rows.withColumn("ids", F.zip_with("ids", shifted, lambda x, far: F.when(far.isNull(), x).otherwise(F.xxhash64(far, x))))
        span *= 2
    rows = rows.withColumn("ids", F.transform("ids", lambda x, i: F.xxhash64(i, x)))
    places = F.transform("path", lambda f, i: F.struct(F.get("ids", i).alias("id"), F.when(i > 0, F.get("ids", i - 1)).alias("parent"), f.alias("frame"), (i + 1).alias("depth")))
    each = rows.select("run", "stack", "count", F.size("path").alias("n"), F.explode(places).alias("p")).select("run", "stack", "count", "n", "p.*")
    own = F.when(F.col("depth") == F.col("n"), F.col("count")).otherwise(0)
    return each.groupBy("run", "id", "parent", "frame", "depth").agg(F.sum("count").alias("total"), F.sum(own).alias("self"), F.min("stack").alias("stack"))


def with_paths(tree_: DataFrame, samples: DataFrame, backward: bool = False) -> DataFrame:
    """``tree_`` with ``node``, the frames from the top: a stack of each node is looked up, one slice a node."""
    known = stacks(samples, backward).select("run", "stack", "path")
    return tree_.join(known, ["run", "stack"]).withColumn("node", F.slice("path", 1, F.col("depth"))).drop("path")


def along(nodes: DataFrame, value: str, combine: Callable[[Column, Column], Column], by: tuple[str, ...] = ("run",)) -> DataFrame:
    """``by``, id and ``value`` combined over all nodes from the top to each: combine(what lies above, what lies below), associative. nodes(by, id, parent, value)."""
    now = kept(nodes.select(*by, "id", F.col("parent").alias("up"), value))
    for _ in range(now.count().bit_length() + 1):  # a way is no longer than there are nodes
        if now.where("up is not null").isEmpty():
            return now.drop("up")
        far = now.select(*by, F.col("id").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_far"))
        now = kept(now.join(far, [*by, "up"], "left").select(*by, "id", F.col("_up").alias("up"), F.when(F.col("up").isNull() | F.col("_far").isNull(), F.col(value)).otherwise(combine(F.col("_far"), F.col(value))).alias(value)))
    raise ValueError("parents run in a circle")


def laid_out(tree_: DataFrame) -> DataFrame:
    """``tree_`` with ``x``, where a node begins in a layout that draws the larger of siblings first (by name among equals) from where their parent begins, as wide as its total."""
    before = Window.partitionBy("run", "parent").orderBy(F.desc("total"), "frame").rowsBetween(Window.unboundedPreceding, -1)
    rows = tree_.withColumn("_x", F.coalesce(F.sum("total").over(before), F.lit(0)))
    return tree_.join(along(rows, "_x", lambda far, x: far + x).withColumnRenamed("_x", "x"), ["run", "id"])


def paths(nodes: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """by, id, path: the frames from the top to each node of a stored tree nodes(by, id, parent, frame)."""
    return along(nodes.withColumn("path", F.array("frame")), "path", F.concat, by)


def from_stored(nodes: DataFrame, frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """samples(run, profiler, profile_type, block, thread_state, path, count) of stored profiles: nodes(run, profiler, profile_type, node_id, parent, frame_id), where node 0 is the
    root without a parent, frames(run, profiler, profile_type, frame_id, name), blocks(run, profiler, profile_type, block, thread_state, node_id, count).
    Counts of the root are stacks without frames."""
    by = ["run", "profiler", "profile_type"]
    real = nodes.where("parent is not null").join(frames, [*by, "frame_id"]).select(*by, F.col("node_id").alias("id"), F.when(F.col("parent") != 0, F.col("parent")).alias("parent"), F.col("name").alias("frame"))
    found = paths(real, tuple(by)).withColumnRenamed("id", "node_id")
    return blocks.join(found, [*by, "node_id"], "left").select(*by, "block", "thread_state", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "count")


def matches(tree_: DataFrame, patterns: list[str], frame_type: str | None = None) -> DataFrame:
    """run, total, self of the nodes that complete the patterns on the way from the top, in this order: total samples of the first such node on each way, own samples of every
    node that matches the last pattern once the others are met. The state after a node is a function of the state before it, and such functions are
    combined down the tree."""
    n, wanted = len(patterns), anchored(patterns, frame_type)
    hit = [F.col("frame").rlike(p).cast("int") for p in wanted]
    step = F.array(*[F.lit(s) + (hit[s] if s < n else 0) for s in range(n + 1)])
    rows = tree_.withColumns({"_f": step, "_hit": hit[-1]})
    state = along(rows, "_f", lambda above, below: F.transform(above, lambda s: F.get(below, s))).select("run", "id", F.get("_f", F.lit(0)).alias("_after"))
    rows = rows.join(state, ["run", "id"]).select("run", "id", "parent", "total", "self", "_hit", "_after")
    above = state.select("run", F.col("id").alias("parent"), F.col("_after").alias("_before"))
    rows = rows.join(above, ["run", "parent"], "left").na.fill(0, ["_before"])
    first = (F.col("_after") == n) & (F.col("_before") < n)
    last = (F.col("_before") >= n - 1) & (F.col("_hit") == 1)
    count = lambda some, c: F.sum(F.when(some, F.col(c)).otherwise(0)).alias(c)
    return rows.groupBy("run").agg(count(first, "total"), count(last, "self"))
