"""Live excursions and findings: what a stream gives out is what a batch finds."""

import random

import pytest
from gaugeframe.operators import rules
from gaugeframe.operators import timeseries as ts
from gaugeframe.streaming import live

POINTS = "run string, metric string, series string, sample_idx long, time_diff long, value double"
gen = random.Random(6)


@pytest.fixture
def recorded(spark, tmp_path):
    """Points of two series in five files, as five triggers bring them; the base run's statistics."""
    rows = [("r", "m", s, k, 10 * k, float(gen.choice([10, 11, 12, 90, 95, 0, 1]) if k % 5 == 0 else gen.choice([40, 41, 42]))) for s in "ab" for k in range(100)]
    for part in range(5):
        spark.createDataFrame([r for r in rows if r[3] // 20 == part], POINTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    base = spark.createDataFrame([("base", "m", "a", k, k, float(v)) for k, v in enumerate([35, 45, 40, 50, 30] * 9)], POINTS)
    return spark.createDataFrame(rows, POINTS), str(tmp_path / "in"), live.bounds_of(ts.statistics(base, ["metric"]))


def drained(spark, frame, tmp_path, mode):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timeouts of processing time go on for ever
    q = frame.writeStream.format("memory").queryName("live_out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{mode}")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()
    return [tuple(r) for r in spark.table("live_out").collect()]


def test_excursions(spark, tmp_path, recorded):
    points, folder, bounds = recorded
    (row,) = bounds.collect()
    bounds = spark.createDataFrame([row], bounds.schema)
    want = sorted(tuple(r) for r in live.excursions(live.bounded(points, bounds)).collect())
    assert {x[3] for x in want} == {"spike", "drop"} and len(want) > 20
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).json(folder)
    got = drained(spark, live.live_excursions(live.bounded(stream, bounds)), tmp_path, "append")
    assert sorted(got) == want


def test_bounds(spark):
    stats = spark.createDataFrame([("a", 10.0, 2.0), ("b", 1.0, 5.0), ("c", 3.0, 0.0)], "metric string, avg double, std double")
    assert {r["metric"]: (r["high"], r["low"]) for r in live.bounds_of(stats).collect()} == {"a": (14.0, 6.0), "b": (11.0, 0.0), "c": (3.0, None)}


def test_rules_on_a_stream(spark, tmp_path, recorded):
    points, folder, _ = recorded
    rule = rules.PointThreshold("Large", "m", ">", 50, -2)
    want = [tuple(r) for r in rule.findings(points).collect()]
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).json(folder)
    assert drained(spark, rule.findings(stream), tmp_path, "complete") == want
