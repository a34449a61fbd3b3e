import math

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import expr
from gaugeframe.operators import joins, profile, rules
from gaugeframe.operators import timeseries as ts
from gaugeframe.sources import text
from gaugeframe.streaming.rates import stream_rates

POINTS = "run string, metric string, series string, sample_idx long, time_diff long, value double"


def points(spark, values, metric="m", series="s", run="r"):
    return spark.createDataFrame([(run, metric, series, k, k, float(v)) for k, v in enumerate(values)], POINTS)


@pytest.mark.parametrize(("values", "times", "rates"), [
    ([100, 250, 500], [0, 1, 2], [0, 150, 250]),
    ([1000, 400, 1600], [0, 2], [0, 1200]),
    ([1000, 200, 500, 900, 1200, 1500], [0, 2, 3, 4, 5], [0, 300, 400, 300, 300]),
])
def test_rates_and_resets(spark, values, times, rates):
    got = ts.rates(points(spark, values)).orderBy("time_diff").collect()
    assert [r["time_diff"] for r in got] == times
    assert [r["value"] for r in got] == rates


def test_average_aggregate(spark):
    three = points(spark, [10, 40], series="a").union(points(spark, [20, 50], series="b")).union(points(spark, [30, 60], series="c"))
    got = ts.with_aggregate(three).where("is_aggregate").orderBy("sample_idx").collect()
    assert [r["value"] for r in got] == [20, 50]
    assert ts.with_aggregate(points(spark, [1, 2])).where("is_aggregate").count() == 0


def test_nearest_rank(spark):
    row = ts.statistics(points(spark, range(1, 11)), ["run", "metric"]).first()
    assert (row["p50"], row["p99"], row["min"], row["max"]) == (6, 10, 1, 10)
    assert math.isclose(row["std"], 2.8722813232690143)


@pytest.mark.parametrize(("v", "t", "s", "want"), [(10, 5, 3, 6), (2, 10, 3, 15), (0, 10, 5, 10), (5, 0, 3, 12), (0.5, 0, 3, 3)])
def test_score(spark, v, t, s, want):
    got = spark.range(1).select(expr.finding_score(F.lit(float(v)), F.lit(float(t)), F.lit(float(s)))).first()[0]
    assert got == pytest.approx(want)


def test_threshold_rule(spark):
    for values, hits in (([10, 20, 30], 0), ([50, 60, 70], 1)):
        stats = ts.statistics(points(spark, values), ["run", "metric"])
        assert rules.StatThreshold("x", "m", "avg", ">", 50, -1).findings(stats).count() == hits


def test_preemption(spark):
    kv = [("a", "Kernel Version", "7.0.1"), ("a", "CONFIG_PREEMPT_LAZY", "y"), ("b", "Kernel Version", "6.12.0"), ("b", "CONFIG_PREEMPT_LAZY", "y"), ("c", "Kernel Version", "7.1")]
    df = spark.createDataFrame([(r, "", k, v) for r, k, v in kv], "run string, grp string, key string, value string")
    assert [r["run"] for r in rules.PreemptionRule().findings(df).collect()] == ["a"]


def test_stack_pattern(spark):
    stacks = [(["f1", "f2"], 100), (["f1", "f2", "f3"], 110), (["f4", "f5", "f6"], 75), (["f1", "f7"], 90)]
    df = spark.createDataFrame([("r", 0, 0, p, n) for p, n in stacks], "run string, block long, thread_state int, path array<string>, count long")
    row = profile.matches(df, ["f1", "f2"]).first()
    assert (row["total"], row["self"]) == (210, 100)
    assert {r["frame"]: r["total"] for r in profile.frames(df).collect()}["f1"] == 300


def test_time_range_counts_back(spark):
    got = ts.between(points(spark, range(10)), -3, None).orderBy("time_diff").collect()
    assert [r["time_diff"] for r in got] == [6, 7, 8, 9]
    assert ts.between(points(spark, range(10)), 7, 3).count() == 0


def test_squeeze_zeros(spark):
    assert ts.squeeze_zeros(points(spark, [0] * 9)).count() == 2
    assert ts.squeeze_zeros(points(spark, [0, 1, 0])).count() == 3


def test_text_numbers(spark):
    row = spark.range(1).select(expr.trunc2(F.lit(-1.239)).alias("t"), expr.percent_text(F.lit(0.5)).alias("p"), expr.number_text(F.lit(2500.0)).alias("n"), expr.natural_key(F.lit("CPU10")).alias("k")).first()
    assert (row["t"], row["p"], row["n"]) == (-1.23, "50% greater than", "2.5K")
    assert row["k"] == ["CPU", "10".zfill(20)]


def raw(spark, payload):
    return spark.createDataFrame([("r", 0, 0, payload)], "run string, sample_idx long, ts long, payload string")


def test_parsers(spark):
    got = {(r["metric"], r["series"]): r["value"] for r in text.cpu(raw(spark, "cpu 1 2 3 4 5 6 7 8\ncpu0 1 1 1 1 1 1 1 1\ncpu4 2 2 2 2 2 2 2 2\nintr 5")).collect()}
    assert got[("user", "Aggregate")] == 1 and got[("steal", "CPU1")] == 2 and len(got) == 24
    got = {r["metric"]: r["value"] for r in text.memory(raw(spark, "MemTotal:  2 kB\nHuge: 7")).collect()}
    assert got == {"MemTotal": 2048, "Huge": 7}
    got = {r["metric"]: r["value"] for r in text.network(raw(spark, "Ip: A B\nIp: 1 2")).collect()}
    assert got == {"Ip:A": 1, "Ip:B": 2}
    assert text.network(raw(spark, "Ip: A B\nIp: 1")).count() == 0
    got = {(r["metric"], r["series"]): r["value"] for r in text.components(raw(spark, "n0:\nhit 5\nhit 6\nbad x\nn1:\nhit 7")).collect()}
    assert got == {("hit", "n0"): 6, ("hit", "n1"): 7}
    assert text.disks(raw(spark, "8 0 sda " + " ".join(map(str, range(11))))).where("metric = 'flushes'").first()["value"] == 0
    assert text.pairs(raw(spark, "a 1\n\nb 2")).count() == 2


def test_as_of_and_containing(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y")], "k string, t long, v string")
    assert {r["id"]: r["b"] for r in joins.as_of(left, right, ["k"], "t", "v", "b").collect()} == {1: "y", 2: None}
    ranges = spark.createDataFrame([("a", 0, 10), ("a", 4, 3)], "k string, start long, len long")
    at = spark.createDataFrame([("a", 5), ("a", 8), ("a", 30)], "k string, at long")
    assert {r["at"]: r["start"] for r in joins.containing(at, ranges, ["k"], "at", "start", "len", 4).collect()} == {5: 4, 8: 0}


def test_stream_rates(spark, tmp_path):
    spark.createDataFrame([("r", "m", "s", k, float(v)) for k, v in enumerate([100, 250, 50, 80])], "run string, metric string, series string, time_diff long, value double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, metric string, series string, time_diff long, value double").json(str(tmp_path / "in"))
    q = stream_rates(stream).writeStream.format("memory").queryName("live_rates").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["time_diff"], r["value"]) for r in spark.table("live_rates").collect()) == [(0, 0.0), (1, 150.0), (3, 30.0)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {"ts_rates", "profile_flame"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["profile_collapsed_whole", "profile_pattern_whole"])
def test_profiles_of_whole_tables(spark, tmp_path, name):
    import duckdb

    from gaugeframe.plans import queries

    put = lambda rows, columns, table: spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    put([(0, "AFRICA"), (1, "EUROPE")], "r_regionkey long, r_name string", "region")
    put([(0, "BENIN", 0), (1, "CHAD", 0), (2, "AUSTRIA", 1), (3, "BELGIUM", 1)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    put([(k, k % 4, ["BUILDING", "MACHINERY"][k // 4 % 2]) for k in range(1200)], "c_custkey long, c_nationkey long, c_mktsegment string", "customer")
    con = duckdb.connect()
    for t in ("region", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(queries.SQL[name]).fetchall())
    if name == "profile_collapsed_whole":
        assert sum(r[2] for r in got) == 1200
    else:
        assert any(total > own > 0 for _, total, own in got)  # run0 has matches in the middle frame


@pytest.mark.parametrize("name", ["profile_collapsed", "profile_heat"])
def test_profiles_count_every_block(spark, tmp_path, name):
    """Also those of a null key and of keys below 0."""
    import duckdb

    from gaugeframe.plans import queries, tools  # noqa: F401, it registers its queries

    put = lambda rows, columns, table: spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    put([(0, "AFRICA")], "r_regionkey long, r_name string", "region")
    put([(0, "BENIN", 0)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    put([(k, 0, "BUILDING") for k in (None, None, -45, -1, 0, 3, 7, 28, 900)], "c_custkey long, c_nationkey long, c_mktsegment string", "customer")
    con = duckdb.connect()
    for t in ("region", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, con.execute(queries.SQL[name]).fetchall()))
