"""Scans in blocks give the rows of plain windows and spread one series over tasks; summary rules; exact statistics from digests."""

import math
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import blocks
from gaugeframe.operators import timeseries as ts

POINTS = "run string, metric string, series string, sample_idx long, time_diff long, value double"
gen = random.Random(4)
VALUES = [gen.choice([0, 5, 5, 7, 100]) + gen.random() * 3 // 1 for _ in range(101)]


def points(spark, values, series="s", gap=1, **more):
    return spark.createDataFrame([(more.get("run", "r"), "m", series, 3 * k, gap * k, float(v)) for k, v in enumerate(values)], POINTS)


SCANS = {
    "rates": ts.rates,
    "decreases": ts.decreases,
    "trend": ts.trend,
    "spikes": ts.spikes,
    "drops": ts.drops,
    "anomalies": ts.anomalies,
    "delta_runs": ts.delta_runs,
    "run_length_text": ts.run_length_text,
    "downsample": lambda p: ts.downsample(p, 7),
    "positional_average": ts.positional_average,
    "between": lambda p: ts.between(p, -40, -3),
    "last_of_each_second": lambda p: ts.last_of_each_second(p.withColumn("ms", F.col("time_diff") * 300)),
}


@pytest.mark.parametrize("name", list(SCANS))
def test_blocks_change_nothing(spark, monkeypatch, name):
    some = points(spark, VALUES).union(points(spark, VALUES[:10], "t")).union(points(spark, [3], "u")).union(points(spark, [-v for v in VALUES], "v", run="q")).cache()
    say = lambda rows: sorted(str(r.asDict()) if not any(isinstance(v, float) for v in r) else str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in rows.collect())
    whole = say(SCANS[name](some))
    for width in (1, 10, 64):
        monkeypatch.setattr(blocks, "WIDTH", width)
        assert say(SCANS[name](some)) == whole


def test_one_series_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "WIDTH", 20)
    monkeypatch.setattr(ts, "WIDTH", 20)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scan = blocks.Scan(points(spark, range(100))).running(total=F.col("value")).rows
        assert scan.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert [r["total"] for r in scan.orderBy("sample_idx").collect()] == [k * (k + 1) / 2 for k in range(100)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize(("values", "percent", "name"), [
    ([-10, -5], -50, "falling"),
    ([0.0005, 5], 0, "stable"),
    ([100, 102], 2, "rising"),
    ([100, 101.9], 1.9, "stable"),
    ([100, 98], -2, "falling"),
    ([7], 0, "stable"),
])
def test_trend(spark, values, percent, name):
    row = ts.trend(points(spark, values)).first()
    assert row["trend"] == name and math.isclose(row["percent"], percent, abs_tol=1e-9)


def excursions(values, times):
    """The anomalies of a summary, by a loop over the points."""
    avg, std = plain.fmean(values), plain.pstdev(values)
    out = []
    for kind, beyond, worse in (("spike", lambda v: v > avg + 2 * std, max), ("drop", lambda v: std > 0.001 and v < max(avg - 2 * std, 0.0), min)):
        start = None
        for t, v in zip(times, values, strict=True):
            if beyond(v):
                start, peak = (t, v) if start is None else (start, worse(peak, v))
            elif start is not None:
                out.append((kind, start, t, peak))
                start = None
    return out


def test_anomalies(spark):
    series = {
        "a": [10] * 30 + [50, 60, 55] + [10] * 5 + [70],  # the last one is still open
        "b": [v for _ in range(8) for v in [10] * 20 + [90]] + [10],  # eight spikes
        "c": [100] * 40 + [0, 1] + [100] * 3 + [2] + [100],
        "d": [5, 5, 5],
        "e": [10, 500] + [100] * 60 + [300] + [100] * 9 + [-40, -50] + [100],
    }
    rows = None
    for name, values in series.items():
        own = points(spark, values, name, gap=2)
        rows = own if rows is None else rows.union(own)
    got = {n: [tuple(r)[4:] for r in sorted((x for x in ts.anomalies(rows).collect() if x["series"] == n), key=lambda x: x["place"])] for n in series}
    for name, values in series.items():
        assert got[name] == [tuple(x) for x in excursions(values, [2 * k for k in range(len(values))])[:5]]
    said = {r["series"]: r for r in ts.summary(rows).collect()}
    assert said["a"]["anomalies"] == "spike t=60s-66s (peak 60.0)" and (said["b"]["spikes"], said["d"]["anomalies"]) == (5, "")
    assert (said["c"]["spikes"], said["c"]["drops"]) == (0, 2)


def test_statistics_from_digests(spark):
    r = random.Random(1)
    groups = {
        "mixed": [r.gauss(0, 1e3) for _ in range(700)] + [0.0, -0.0, 1e-300, -1e-300, 5e300],
        "near": [1e9 + r.random() for _ in range(400)],
        "few": [1.0, 2.0, 2.0, 2.0, 3.0],
        "one": [-4.5],
        "small": [r.random() * 1e-9 for _ in range(333)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None), (None, 1.0), (None, 2.0)], "run string, value double").repartition(3)
    halves = [ts.digest(rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == k), ["run"]) for k in (0, 1)]
    for got in (ts.statistics(rows, ["run"]), ts.statistics_of(ts.merged(halves, ["run"]), ["run"])):
        got = {x["run"]: x for x in got.collect()}
        assert set(got) == {*groups, "none", None} and got["none"]["avg"] is None and got["none"]["p50"] is None and got[None]["p50"] == 2.0
        for name, vs in groups.items():
            x, ordered = got[name], sorted(vs)
            assert (x["min"], x["max"]) == (ordered[0], ordered[-1])
            assert [x[p] for p in ts.QUANTILES] == [ordered[math.floor(q * len(vs))] for q in ts.QUANTILES.values()]
            if name != "mixed":
                assert math.isclose(x["avg"], plain.fmean(vs), rel_tol=1e-12) and math.isclose(x["std"], plain.pstdev(vs), rel_tol=1e-6, abs_tol=1e-15)
