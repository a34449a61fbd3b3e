import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import catalogue, joins, profile, rules
from gaugeframe.operators import timeseries as ts
from gaugeframe.sinks import report
from gaugeframe.sources import runs, text
from gaugeframe.streaming.rates import stream_rates


def framed(*records):
    return b"".join(t.to_bytes(8, "little") + len(p).to_bytes(4, "little") + p.encode() for t, p in records)


@pytest.fixture
def recorded(tmp_path):
    """A folder and an archive of runs of one name."""
    for k, place in enumerate((tmp_path / "a" / "web", tmp_path / "b" / "web")):
        os.makedirs(place)
        (place / "meta_data.json").write_text(json.dumps({"start_time": 1000, "end_time": 9000, "page_size": 4096, "pmu_mode": "x", "collector_pid": 7, "subprocess_pids": [7, 8 + k]}))
        (place / "vmstat_1.bin").write_bytes(framed((1000, "pgfault 1"), (2000, "pgfault 5")) + b"\x01cut")
        (place / "other.bin").write_bytes(b"")
    with tarfile.open(tmp_path / "b" / "web.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "b" / "web", "web")
    return [str(tmp_path / "a" / "web"), str(tmp_path / "b" / "web.tar.gz")]


def test_runs(spark, recorded):
    files = runs.files_of(spark, recorded)
    assert {(r["run"], r["file"]) for r in files.select("run", "file").collect()} == {(n, f) for n in ("web", "web_1") for f in ("meta_data.json", "vmstat_1.bin")}
    assert {r["run"]: (r["start_ms"], r["pids"]) for r in runs.metadata(files).collect()} == {"web": (1000, [7, 8]), "web_1": (1000, [7, 9])}
    assert sorted(tuple(r) for r in runs.records(files, "vmstat").collect()) == sorted((n, k, 1000 * (k + 1), p) for n in ("web", "web_1") for k, p in enumerate(["pgfault 1", "pgfault 5"]))
    assert {r["run"]: r["sources"] for r in runs.valid_runs(files, ["vmstat", "other", "none"]).collect()} == {"web": 1, "web_1": 1}
    assert runs.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_1", "a_1_1", "a_2"]


def test_ranges():
    assert ts.parse_range("a=b=5:") == ("a=b", 5, None) and ts.parse_range("r=-9:-2") == ("r", -9, -2)
    assert ts.check_ranges([("r", 1, None)], ["r"]) == {"r": (1, None)}
    for bad in ([("x", 1, 2)], [("r", 2, 1)], [("r", 1, 2), ("r", 3, 4)]):
        with pytest.raises(ValueError):
            ts.check_ranges(bad, ["r"])
    with pytest.raises(ValueError):
        ts.parse_range("r=5")


def test_merged_order():
    assert ts.merged_order([["a", "b"], ["b", "c"]]) == ["a", "b", "c"]
    assert ts.merged_order([["b", "a"], ["a", "b"]]) == ["b", "a"]


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", "r", "m", s, k, k, v, s == "average") for s in ("CPU10", "CPU2", "average") for k, v in enumerate([1.239, -1.239, float("inf")])], "data_name string, run string, metric string, series string, sample_idx long, time_diff long, value double, is_aggregate boolean")
    stats = ts.statistics(rows.where("value < 9"), ["data_name", "run", "metric"])
    got = json.loads(report.to_json("time_series", rows, stats).first()["json"])
    assert [s["series_name"] for s in got["series"]] == ["CPU2", "CPU10", "average"] and got["series"][0]["values"] == [1.23, -1.23, None] and got["stats"]["max"] == 1.23
    kv = spark.createDataFrame([("d", "r", "g", "k", "v"), ("d", "r", "g", "l", "w")], "data_name string, run string, grp string, key string, value string")
    assert json.loads(report.to_json("key_value", kv).first()["json"]) == {"g": {"k": "v", "l": "w"}}
    assert json.loads(report.to_json("text", spark.createDataFrame([("d", "r", 1, "b"), ("d", "r", 0, "a")], "data_name string, run string, line_no long, line string")).first()["json"]) == {"lines": ["a", "b"]}
    found = {"per_run_findings": {"r": {"findings": {"k": [{"rule_name": "n", "score": -2.0, "description": "d", "message": "m"}]}}}}
    report.write_variables(spark.createDataFrame([("x_findings", json.dumps(found)), ("runs_raw", '[{"name":"r","collection_start_ms":5,"collection_end_ms":9}]')], "name string, json string"), str(tmp_path / "report"))
    back = runs.variables(spark.read.text(str(tmp_path / "report"), wholetext=True, recursiveFileLookup=True))
    assert [tuple(r) for r in runs.findings_of(back).collect()] == [("x", "r", "k", "n", -2.0, "d", "m")]
    assert [tuple(r) for r in runs.runs_of(back).collect()] == [("r", 0, 5, 9)]
    assert [r["run"] for r in runs.runs_of(spark.createDataFrame([("runs_raw", '["a","b"]')], "name string, json string")).orderBy("place").collect()] == ["a", "b"]
    report.archive(str(tmp_path / "report"), str(tmp_path / "report.tar.gz"))
    assert tarfile.open(tmp_path / "report.tar.gz").getnames()[0] == "report"
    assert report.html_page(spark.createDataFrame([("<a>", None)], "x string, y string")) == "<table><tr><th>x</th><th>y</th></tr><tr><td>&lt;a&gt;</td><td></td></tr></table>"
    assert json.loads(report.answer(spark.range(2))) == [{"id": 0}, {"id": 1}]
    report.write_csv({"t": spark.range(2).withColumn("h", F.array(F.lit(1)))}, str(tmp_path / "csv"))
    assert runs.csv_table(spark, str(tmp_path / "csv" / "t")).count() == 2
    report.append_raw(spark.createDataFrame([("r", "d", 1)], "run string, data_name string, x int"), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 1
    with pytest.raises(ValueError):
        runs.check_report(["runs_raw", "processed_a_data"])


def test_catalogue(spark):
    assert sum(len(catalogue.rules_of(s)) for s in catalogue.SOURCES) == 53
    stats = spark.createDataFrame([("a", "user", 10.0), ("b", "user", 20.0), ("a", "idle", 60.0), ("b", "idle", 5.0)], "run string, metric string, avg double")
    facts = rules.Facts(stats.select("run").distinct(), "a", stats=stats)
    got = {(r["run"], r["rule_name"]) for r in rules.run_rules(catalogue.rules_of("cpu_utilization"), facts).collect()}
    assert got == {("a", "Underutilized CPU"), ("b", "Increased User-Space CPU Utilization")}
    assert rules.run_rules(catalogue.rules_of("systeminfo"), facts) is None


def test_differences_of_three_runs(spark):
    frames = spark.createDataFrame([("a", "f", 10, 10), ("b", "f", 5, 5), ("b", "g", 5, 5), ("c", "h", 1, 1)], "run string, frame string, total long, self long")
    got = {(r["run"], r["frame"]): (r["share"], r["base_share"]) for r in profile.difference(frames, "a").collect()}
    assert got == {("b", "f"): (50, 100), ("b", "g"): (50, 0), ("c", "f"): (0, 100), ("c", "h"): (100, 0)}


def test_missing_and_empty_values_are_one(spark):
    kv = spark.createDataFrame([("a", "", "k", ""), ("a", "", "l", "x"), ("a", "", "m", None), ("b", "", "m", "y")], "run string, grp string, key string, value string")
    got = joins.differing_keys(kv, spark.createDataFrame([("a",), ("b",)], "run string"))
    assert {r["key"] for r in got.collect()} == {"l", "m"}


def test_long_ranges(spark):
    ranges = spark.createDataFrame([("a", 0, 10_000_000, "long"), ("a", 500, 3, "short"), ("a", 900, 40, "mid")], "k string, start long, len long, name string")
    at = spark.createDataFrame([("a", x) for x in (501, 700, 910, 910, 9_999_999, 10_000_000)], "k string, at long")
    got = sorted((r["at"], r["name"]) for r in joins.containing(at, ranges, ["k"], "at", "start", "len", 2).collect())
    assert got == [(501, "short"), (700, "long"), (910, "mid"), (910, "mid"), (9_999_999, "long")]


def test_statistics_of_many_ties(spark):
    rows = spark.range(30000).select((F.col("id") % 2).alias("g"), F.floor(F.sqrt(F.col("id") % 997)).cast("double").alias("value"))
    for r in ts.statistics(rows, ["g"]).collect():
        own = sorted(int((k % 997) ** 0.5) for k in range(30000) if k % 2 == r["g"])
        assert [r[p] for p in ts.QUANTILES] == [own[int(q * len(own))] for q in ts.QUANTILES.values()]
    assert ts.statistics(rows.where("g > 5"), ["g"]).count() == 0


def test_white_space_of_any_kind(spark):
    raw = spark.createDataFrame([("r", 0, 0, "n0:\r\nhit 5\r\n\thit 6 \r\n")], "run string, sample_idx long, ts long, payload string")
    assert [(r["metric"], r["value"]) for r in text.components(raw).collect()] == [("hit", 6.0)]
    raw = spark.createDataFrame([("r", 0, 0, "\ta 1\r\n  b\t2  ")], "run string, sample_idx long, ts long, payload string")
    assert {r["metric"]: r["value"] for r in text.pairs(raw).collect()} == {"a": 1, "b": 2}


def test_late_rows_do_not_turn_time_back(spark, tmp_path):
    schema = "run string, metric string, series string, time_diff long, value double"
    os.makedirs(tmp_path / "in")
    for k, rows in enumerate([[(0, 0), (10, 100)], [(5, 40), (20, 300)]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"run": "r", "metric": "m", "series": "s", "time_diff": t, "value": float(v)}) for t, v in rows))
        os.utime(tmp_path / "in" / f"{k}.json", (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_rates(stream).writeStream.format("memory").queryName("late_rates").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["time_diff"], r["value"]) for r in spark.table("late_rates").collect()) == [(0, 0.0), (10, 10.0), (20, 20.0)]


def test_round_trip_keeps_events_of_one_second_by_id(spark, tmp_path):
    from datetime import datetime, timedelta

    from gaugeframe.plans import queries, tools  # noqa: F401

    start = datetime(2024, 1, 1)
    rows = [(n, start + timedelta(seconds=n // 50, milliseconds=n % 5), 1, "view", float(n * 7919 % 200)) for n in range(200)]
    for turn in (1, -1):  # however they lie in the table
        at = str(tmp_path / str(turn))
        spark.createDataFrame(rows[::turn], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{at}/events.parquet")
        got = queries.QUERIES["report_round_trip"](spark, at).orderBy("sample_idx").select("sample_idx", "time_diff", "value").collect()
        assert [tuple(r) for r in got] == [(n, n // 50, float(n * 7919 % 200)) for n in range(200)]
