"""Logs as the recorder writes them: every shape, cut and broken records, and the way to points."""

import struct

import pytest

from gaugeframe.sources import pipelines, runs

FILES = "run string, file string, content binary"


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def moment(s):
    return struct.pack("<I", 0) + text(s)


def record(kind, at, *fields):
    return (struct.pack("<I", kind) if kind is not None else b"") + moment(at) + b"".join(fields)


def nested(stats):
    return struct.pack("<Q", len(stats)) + b"".join(text(k) + (struct.pack("<Q", len(v)) + b"".join(text(x) + struct.pack("<d", y) for x, y in v.items()) if isinstance(v, dict) else struct.pack("<Q", v)) for k, v in stats.items())


def files(spark, **contents):
    return spark.createDataFrame([("r", f"{n}_1.bin", bytearray(c)) for n, c in contents.items()], FILES)


def test_text_records_to_points(spark):
    log = record(3, "2024-02-29T10:00:00Z", text("pgfault 10\nnr_x 1")) + record(3, "2024-02-29T10:00:02.750123456Z", text("pgfault 35\nnr_x 2"))
    got = runs.log_records(files(spark, vmstat=log), "vmstat")
    assert [(r["sample_idx"], r["ts"]) for r in got.orderBy("sample_idx").collect()] == [(0, 1709200800000), (1, 1709200802750)]
    points = {(r["metric"], r["time_diff"]): r["value"] for r in pipelines.vmstat(runs.since_first(got)).collect()}
    assert points == {("pgfault", 0): 0.0, ("pgfault", 2): 12.5, ("nr_x", 0): 1.0, ("nr_x", 2): 2.0}


@pytest.mark.parametrize("tail", [b"", b"\x03", struct.pack("<I", 3) + moment("2024-01-01T00:00:02Z") + struct.pack("<Q", 50) + b"short", struct.pack("<I", 999), struct.pack("<II", 3, 7), record(3, "yesterday", text("a 1"))])
def test_reading_stops_at_what_cannot_be_read(spark, tail):
    good = record(3, "2024-01-01T00:00:00Z", text("ä 1"))
    got = runs.log_records(files(spark, vmstat=good + tail + (good if tail else b"")), "vmstat").collect()
    assert [(r["sample_idx"], r["payload"]) for r in got] == [(0, "ä 1")]


def test_other_shapes(spark):
    at = "2024-01-01T00:00:01Z"
    got = runs.log_records(files(spark, processes=record(5, at, struct.pack("<Q", 100), text("1 (a) S"))), "processes").first()
    assert (got["ticks_per_second"], got["payload"]) == (100, "1 (a) S")
    got = runs.log_records(files(spark, memalloc=record(6, at, text("b"), text("p"), text("s"))), "memalloc").first()
    assert (got["buddyinfo"], got["pagetypeinfo"], got["slabinfo"]) == ("b", "p", "s")
    seconds = struct.pack("<IIQ", 1, 1, 5) + text("a 1")
    assert runs.log_records(files(spark, vmstat=seconds), "vmstat").first()["ts"] == 5000


def test_own_log(spark):
    log = b"".join(record(None, f"2024-01-01T00:00:0{k}Z", nested({"collect": {"cpu": 1.5 + k, "disk": 2.0}, "finish": {"cpu": 4.0}})) for k in (0, 3))
    points = {(r["metric"], r["series"], r["time_diff"]): (r["value"], r["is_aggregate"]) for r in pipelines.self_stats_of_log(runs.since_first(runs.log_records(files(spark, own=log), "own", "self_stats"))).collect()}
    assert points["collect", "cpu", 3] == (4.5, False) and points["collect", "total", 0] == (3.5, True) and ("finish", "total", 0) not in points
    old = record(None, "2024-01-01T00:00:00Z", text("x"), nested({"vmstat-print": 7, "vmstat-collect": 2, "whole": 9}))
    points = {(r["metric"], r["series"]): r["value"] for r in pipelines.self_stats_of_log(runs.since_first(runs.log_records(files(spark, own=old), "own", "legacy_self_stats"))).collect()}
    assert points == {("vmstat", "write"): 7.0, ("vmstat", "collect"): 2.0, ("vmstat", "total"): 9.0, ("whole", "whole"): 9.0}
