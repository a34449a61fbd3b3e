"""Descriptions and messages of findings, rules of one series, of a profile type and of a kind of frame."""

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import expr
from gaugeframe.operators import catalogue, rules

STATS = "run string, metric string, avg double, std double, min double, max double, p50 double, p90 double, p99 double, p99_9 double"


def stats(spark, rows):
    return spark.createDataFrame([(r, m, *[float(v)] * 8) for r, m, v in rows], STATS)


@pytest.mark.parametrize(("x", "text"), [(0.0, "0"), (50.0, "50"), (2500.0, "2.5K"), (1999.999, "1.99K"), (3e6, "3M"), (-4567.891, "-4567.89"), (float("nan"), "NaN"), (1e12, "1T"), (100.1, "100.1")])
def test_numbers(spark, x, text):
    assert spark.range(1).select(expr.number_text(F.lit(x))).first()[0] == text


def said(frame):
    return {(r["run"], r["key"]): r["description"] for r in frame.collect()}


def test_descriptions(spark):
    s = stats(spark, [("a", "m", 1000), ("b", "m", 1500), ("a", "n", 0), ("b", "n", 3)])
    assert said(rules.StatThreshold("x", "m", "p99_9", ">", 1200, 1).findings(s)) == {("b", "m"): "The p99_9 in b is 1.5K."}
    assert said(rules.RunComparison("x", "m", "avg", ">=", 0.1, 1).findings(s, "a")) == {("b", "m"): "The average in b (1.5K) is 50% greater than a (1K)."}
    assert said(rules.RunComparison("x", "n", "avg", ">=", 0.1, 1).findings(s, "a")) == {("b", "n"): "The average in b (3) is 100% greater than a (0)."}
    assert said(rules.MetricComparison("x", "m", "n", "avg", "<=", 0, 1).findings(s)) == {("a", "n"): "The average in n (0) is 100% less than m (1K).", ("b", "n"): "The average in n (3) is 99.8% less than m (1.5K)."}
    p = spark.createDataFrame([("a", "mx", "s", 0, 7.25), ("a", "mx", "s", 1, 9.0)], "run string, metric string, series string, time_diff long, value double")
    assert said(rules.PointThreshold("x", "^m", ">=", 0.5, 1).findings(p)) == {("a", "mx"): "At least one data point in a is 9 (greater than or equal to the threshold of 0.5)."}
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    kv = spark.createDataFrame([("a", "", "k", "1"), ("b", "", "k", "2")], "run string, grp string, key string, value string")
    assert said(rules.KeyExpected("x", "k", "1", 1).findings(runs, kv)) == {("b", "k"): 'The value of k in b is "2", instead of "1".', ("c", "k"): "The key k in c is missing, instead of being set to 1"}
    assert said(rules.KeyComparison("x", "k", 1).findings(runs, kv, "a")) == {("b", "k"): 'The value of k in b ("2") is different from a ("1").', ("c", "k"): 'The key k does not exist in c, while its value in a is "1".'}


def test_series_of_a_metric(spark):
    s = stats(spark, [("a", "process_user_space_time", 0.5)])
    of_series = s.withColumn("series", F.lit("own")).unionByName(s.withColumns({"series": F.lit("other"), "run": F.lit("b")}))
    facts = rules.Facts(s.select("run"), "a", stats=s, series_stats=of_series)
    assert {(r["run"], r["rule_name"]) for r in rules.run_rules(catalogue.rules_of("self_stats", "own"), facts).collect()} == {("a", "High Recorder Userspace CPU Time")}
    assert rules.run_rules(catalogue.rules_of("self_stats", "own"), rules.Facts(s.select("run"), "a", stats=s)) is None
    assert rules.run_rules(catalogue.rules_of("self_stats"), rules.Facts(s.select("run"), "a", stats=s)).count() == 1


def test_profile_type_and_frame_type(spark):
    rows = [("cpu", ["main", "x.MyException.<init>_[j]"], 6), ("cpu", ["main"], 94), ("wall", ["x.MyException.<init>"], 1000), ("alloc", ["y"], 5)]
    s = spark.createDataFrame([("r", "7", t, 0, 0, p, n) for t, p, n in rows], "run string, profiler string, profile_type string, block long, thread_state int, path array<string>, count long")
    rule = next(r for r in catalogue.rules_of("java_profile") if r.name == "Excessive Exceptions")
    found = rule.findings(s).first()
    assert found["description"].endswith("] accounts for 6.00% of samples in cpu (threshold: 5.00%)") and found["message"] == catalogue.MESSAGES["Excessive Exceptions"]
    one = lambda **more: rules.StackThreshold("x", (("main", ".*init>"),), 1.0, 1, (0,), **more).findings(s).count()
    assert (one(profile_type="cpu", frame_type="compiled"), one(profile_type="cpu", frame_type="kernel"), one(profile_type="alloc")) == (1, 0, 0)
    each = rules.StackThreshold("x", (("none",), ("main",), ("x.*",)), 1.0, 1, (0,), add_up=False, profile_type="cpu").findings(s).first()
    assert each["description"].startswith("Stack pattern [main] accounts for 100.00%")


def test_every_rule_has_a_message():
    every = [r for s in catalogue.SOURCES for r in catalogue.rules_of(s)]
    assert len(every) == 53 and all(r.message for r in every)
