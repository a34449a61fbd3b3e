"""Call trees with interned nodes against a tree of dictionaries: totals, callers, layout, patterns, stored shape."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import calltree, profile

SAMPLES = "run string, block long, thread_state int, path array<string>, count long"
gen = random.Random(9)
NAMES = ["a", "b", "main_[j]", "run", "x.y_[0]", "k_[k]"]
STACKS = [([gen.choice(NAMES) for _ in range(gen.randint(0, 11))], gen.randint(1, 9), gen.choice(["r", "q"])) for _ in range(150)] + [(["a"] * 40, 3, "r"), (["deep"] + ["f"] * 33, 2, "q")]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(r, k % 7, 0, p, n) for k, (p, n, r) in enumerate(STACKS)], SAMPLES).cache()


def plain_tree(run, backward):
    nodes = {}
    for path, n, r in STACKS:
        path = path[::-1] if backward else path
        for k in range(len(path) if r == run else 0):
            t = nodes.setdefault(tuple(path[: k + 1]), [0, 0])
            t[0] += n
            t[1] += n * (k + 1 == len(path))
    return nodes


def layout(nodes):
    at = {}

    def put(parent, x):
        for p in sorted((p for p in nodes if p[:-1] == parent), key=lambda p: (-nodes[p][0], p[-1])):
            at[p] = x
            put(p, x)
            x += nodes[p][0]

    put((), 0)
    return at


@pytest.mark.parametrize("backward", [False, True])
def test_tree_and_layout(samples, backward):
    tree = calltree.tree(samples, backward)
    got = calltree.with_paths(calltree.laid_out(tree), samples, backward).collect()
    for run in ("r", "q"):
        want = plain_tree(run, backward)
        assert {tuple(x["node"]): [x["total"], x["self"]] for x in got if x["run"] == run} == want
        assert {tuple(x["node"]): x["x"] for x in got if x["run"] == run} == layout(want)
    by = {(x["run"], x["id"]): tuple(x["node"]) for x in got}
    assert len(by) == len(got) and all(by.get((x["run"], x["parent"]), ()) == tuple(x["node"])[:-1] for x in got)
    assert sorted((x["run"], tuple(x["node"]), x["total"]) for x in profile.nodes(samples, backward).collect()) == sorted((x["run"], tuple(x["node"]), x["total"]) for x in got)


def counted(run, patterns):
    """By a walk over the tree: totals stop at a full match, own samples go on below it."""
    nodes = plain_tree(run, False)

    def walk(parent, k, totals):
        out = 0
        for p in (p for p in nodes if p[:-1] == parent):
            nxt = k + bool(re.match(patterns[k], p[-1]))
            if nxt == len(patterns):
                out += nodes[p][0] if totals else nodes[p][1] + walk(p, k, False)
            else:
                out += walk(p, nxt, totals)
        return out

    return walk((), 0, True), walk((), 0, False)


@pytest.mark.parametrize(("patterns", "kind"), [(["a"], None), (["b", "a"], None), (["a", "a", "a"], None), (["run", "main"], "compiled"), (["main", r"x\.y"], "interpreted"), (["a|b", "k"], "kernel"), (["a", "run"], "native"), (["none"], None)])
def test_patterns(samples, patterns, kind):
    want = {run: counted(run, profile.anchored(patterns, kind)) for run in ("r", "q")}
    for found in (profile.matches(samples, patterns, kind), calltree.matches(calltree.tree(samples), patterns, kind)):
        assert {x["run"]: (x["total"], x["self"]) for x in found.collect()} == want


def test_patterns_are_whole_names(spark):
    df = spark.createDataFrame([("r", 0, 0, [f], 1) for f in ("A", "AB", "xAy", "A_[j]", "A_[k]")], SAMPLES)
    assert profile.matches(df, ["A"]).first()["total"] == 3 and profile.matches(df, ["A"], "compiled").first()["total"] == 1 and profile.matches(df, ["A"], "native").first()["total"] == 1


def test_stored_tree(spark):
    parents = {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 3, 6: 5, 7: 6}
    nodes = spark.createDataFrame([("r", "p", "cpu", k, p, k % 4) for k, p in parents.items()], "run string, profiler string, profile_type string, node_id long, parent long, frame_id long")
    frames = spark.createDataFrame([("r", "p", "cpu", k, f"f{k}") for k in range(4)], "run string, profiler string, profile_type string, frame_id long, name string")
    blocks = spark.createDataFrame([("r", "p", "cpu", b, 0, k, 10 * k + b) for b, k in ((0, 7), (1, 4), (1, 2), (2, 0))], "run string, profiler string, profile_type string, block long, thread_state int, node_id long, count long")
    got = {(x["block"], x["count"]): x["path"] for x in calltree.from_stored(nodes, frames, blocks).collect()}
    assert got == {(0, 70): ["f1", "f2", "f3", "f1", "f2", "f3"], (1, 41): ["f0"], (1, 21): ["f1", "f2"], (2, 2): []}
    circle = nodes.where("node_id > 0").select("run", F.col("node_id").alias("id"), F.when(F.col("node_id") == 1, 7).otherwise(F.col("parent")).alias("parent"), F.lit("f").alias("frame"))
    with pytest.raises(ValueError, match="circle"):
        calltree.paths(circle)


def test_function_deltas(spark):
    rows = [("a", ["f", "g"], 99_990), ("a", ["h"], 10), ("b", ["f", "g"], 50_000), ("b", ["h"], 5), ("b", ["new"], 49_995)]
    df = spark.createDataFrame([(r, 0, 0, p, n) for r, p, n in rows], SAMPLES)
    got = {x["frame"]: x for x in profile.function_deltas(df, "a").collect()}
    assert got["h"]["normal"] == 0 and abs(got["h"]["delta"]) < 0.01 and got["new"]["normal"] == 1 and -1 < got["f"]["normal"] < -0.99 and got["new"]["base_percent"] == 0
