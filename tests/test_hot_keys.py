"""As-of joins, symbols and enclosing frames against loops, with keys that are cut over several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import joins

gen = random.Random(3)


@pytest.mark.parametrize("key_rows", [1 << 20, 25])
def test_as_of(spark, key_rows):
    keys = ["hot"] * 20 + ["a", None]
    left = [(gen.choice(keys), gen.randint(0, 90), k) for k in range(400)]
    right = {(gen.choice(keys), gen.randint(0, 90)): gen.choice([None, *range(50)]) for _ in range(150)}
    right |= {("late", 95): 1}
    one, two = spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame([(*x, v) for x, v in right.items()], "k string, t long, v int")
    got = {r["id"]: r["b"] for r in joins.as_of(one, two, ["k"], "t", "v", "b", key_rows).collect()}
    for k, t, i in left:
        before = [(u, v) for (j, u), v in right.items() if j == k and u <= t and v is not None]
        assert got[i] == (max(before)[1] if before else None)


def test_one_key_goes_to_several_tasks(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * F.col("id")).alias("t"))
    parts = joins.in_parts(rows, ["k"], "t", 100).groupBy("_part").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_part").collect()
    assert len(parts) >= 9 and max(r["n"] for r in parts) <= 130 and all(x["hi"] < y["lo"] for x, y in zip(parts, parts[1:], strict=False))


def test_symbols_without_size_reach_to_the_next(spark):
    symbols = spark.createDataFrame([("m", 10, 0, "a"), ("m", 20, 5, "b"), ("m", 40, 0, "c")], "m string, start long, size long, name string")
    at = spark.createDataFrame([("m", a) for a in (5, 10, 19, 20, 24, 25, 39, 40, 1 << 50)], "m string, address long")
    got = {r["address"]: r["symbol"] for r in joins.symbolized(at, symbols, ["m"]).collect()}
    assert got == {5: None, 10: "a", 19: "a", 20: "b", 24: "b", 25: None, 39: None, 40: "c", 1 << 50: "c"}


def test_enclosing(spark):
    frames = [(gen.choice("rq"), 15 * gen.randint(0, 3), float(gen.randint(0, 20)), float(gen.randint(0, 9)), gen.choice("abcd")) for _ in range(300)]
    df = spark.createDataFrame([(*f, k) for k, f in enumerate(frames)], "run string, depth int, x double, w double, name string, id int")
    got = {r["id"]: r["parent"] for r in joins.enclosing(df).collect()}
    for k, (run, depth, x, w, _) in enumerate(frames):
        up = depth - 15 if depth >= 15 else depth + 15
        above = [(y, n) for r, d, y, v, n in frames if r == run and d == up and y <= x and y + v >= x + w]
        assert got[k] == (min(above)[1] if above else "-")


@pytest.mark.parametrize("longest", [25, 4000])
@pytest.mark.parametrize("once", [False, True])
def test_points_in_ranges_are_dealt_by_their_number(spark, monkeypatch, once, longest):
    """Beyond a task's worth of rows, the tasks of the join and of the choice after it follow the rows, not Spark's number of partitions."""
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    points = [(k % 3, k * 7 % 500 * 10 + 2, k % 900) for k in range(1000)]
    ranges = [(k % 3, k * 10, longest if k % 50 == 0 else 25) for k in range(500)]
    at, of = spark.createDataFrame(points, "grp long, at long, id long"), spark.createDataFrame(ranges, "grp long, start long, len long")
    found = joins.containing(at, of, ["grp"], "at", "start", "len", 50, once)
    rows = [(g, a, i, max((s, n) for h, s, n in ranges if h == g and s <= a < s + n)) for g, a, i in (set(points) if once else points) if any(h == g and s <= a < s + n for h, s, n in ranges)]
    assert sorted((r["grp"], r["at"], r["id"], (r["start"], r["len"])) for r in found.collect()) == sorted(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 11 and "hashpartitioning(grp" in plan and ", 3), ENSURE_REQUIREMENTS" not in plan
