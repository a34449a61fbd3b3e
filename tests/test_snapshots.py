import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import counters
from gaugeframe.sources import kernel_config, snapshots


def raw(spark, *payloads):
    return spark.createDataFrame([("r", k, k, p) for k, p in enumerate(payloads)], "run string, sample_idx long, ts long, payload string")


def points(df):
    return {(r["metric"], r["series"]): r["value"] for r in df.collect()}


def test_interrupts(spark):
    got = points(snapshots.interrupts(raw(spark, "  CPU0 CPU1\n 7: 1 2 chip timer\nNMI: 3 4 Non-maskable\nLOC: 5 6\nMIS: 9\n")))
    assert got == {
        ("(chip timer)", "CPU0"): 1, ("(chip timer)", "CPU1"): 2, ("NMI (Non-maskable)", "CPU0"): 3, ("NMI (Non-maskable)", "CPU1"): 4,
        ("LOC", "CPU0"): 5, ("LOC", "CPU1"): 6, ("MIS", "MIS"): 9,
    }
    assert snapshots.interrupts(raw(spark, "", None)).count() == 0


def test_processes(spark):
    figures = " ".join(["S", *map(str, range(1, 30))])
    rows = snapshots.processes(raw(spark, f"12 (a b) {figures}\n13 (short) S 1 2\nnothing"), page_size=4096)
    assert points(rows) == {("user_time", "12_a b"): 11, ("kernel_time", "12_a b"): 12, ("threads", "12_a b"): 17, ("virtual_bytes", "12_a b"): 20, ("resident_pages", "12_a b"): 21, ("resident_bytes", "12_a b"): 21 * 4096}
    assert counters.process_counts(rows).first()["value"] == 1


def test_busiest(spark):
    rows = spark.createDataFrame([("r", f"{k}_p", m, float(k)) for k in range(20) for m in ("user_time", "kernel_time", "threads")], "run string, series string, metric string, value double")
    kept = {r["series"] for r in counters.busiest(rows, 3, ("1",)).collect()}
    assert kept == {"19_p", "18_p", "17_p", "1_p"}


def test_memory_allocator(spark):
    assert points(snapshots.buddies(raw(spark, "Node 0, zone DMA 1 0 x 3\nNode 0"))) == {("buddyinfo_order_0", "node_0_zone_DMA"): 1, ("buddyinfo_order_1", "node_0_zone_DMA"): 0, ("buddyinfo_order_3", "node_0_zone_DMA"): 3}
    got = points(snapshots.page_types(raw(spark, "Page block order: 9\nNode 0, zone DMA, type Movable 5 6\nNode 0, zone Normal 1 2 3 4 5 6 7")))
    assert got[("pagetype_order_1_type_Movable", "node_0_zone_DMA")] == 6 and got[("pageblocks_type_Isolate", "zone_Normal")] == 6
    slab = "ext4 1 2 3 4 5 : tunables 8 9 10 : slabdata 13 14 15"
    got = points(snapshots.slabs(raw(spark, f"{slab}\n# name\n{slab}", slab)))
    assert len(got) == 11 and got[("slabinfo_limit", "ext4")] == 8 and got[("slabinfo_sharedavail", "ext4")] == 15


def test_counters(spark):
    lines = ["0;a;10;100;50\n1;a;30;100;100\n0;b;5;100;100\n1;b;0;100;100\n0;b;x;1;1\n0;b;1", "0;a;10;200;150"]
    rows = counters.scheduled(snapshots.counters(raw(spark, *lines)))
    values = counters.scaled(rows)
    assert sorted((r["cpu"], r["event"], r["sample_idx"], r["value"]) for r in values.collect()) == [(0, "a", 0, 20), (0, "a", 1, 10), (0, "b", 0, 5), (1, "a", 0, 30), (1, "b", 0, 0)]
    assert points(counters.metric(values, "m", "a / b * (1 + 1)", ["a", "b"])) == {("m", "CPU0"): 8, ("m", "Aggregate"): 20}
    assert {r["cpu"]: r["percent"] for r in counters.schedule_rates(rows).where("sample_idx = 0").collect()} == {0: 75, 1: 100, None: 87.5}
    with pytest.raises(ValueError, match="not a formula"):
        counters.formula("a ** 2", ["a"])


def test_legacy_counters(spark):
    rows = spark.createDataFrame([("r", 0, 0, "ipc", 4.0, 2.0, 10.0), ("r", 0, 0, "ipc", 2.0, 1.0, 10.0), ("r", 0, 0, "none", 2.0, 0.0, 1.0)], "run string, sample_idx long, ts long, stat string, numerator double, denominator double, scale double")
    assert points(counters.legacy_ratio(rows)) == {("ipc", "values"): 20}


def test_settings(spark):
    rows = spark.createDataFrame([("r", 0, {"a": "1", "b": "2"}), ("r", 1, {"a": "3"})], "run string, sample_idx long, entries map<string,string>")
    assert {r["key"]: r["value"] for r in snapshots.settings(rows).where(F.col("grp") == "").collect()} == {"a": "3", "b": "2"}


def test_kernel_config(spark):
    text = """#
# Automatically generated file; DO NOT EDIT.
# Linux Configuration
#
CONFIG_A=y

#
# General setup
#
CONFIG_B="x=1"
# CONFIG_C is not set

#
# IRQ subsystem
#
CONFIG_D=y
# end of IRQ subsystem

#
# Timers
#
CONFIG_E=m
# end of General setup
CONFIG_F=y
"""
    df = spark.createDataFrame([("r", text), ("s", None), ("t", "")], "run string, payload string")
    got = {(r["run"], r["grp"], r["key"]): r["value"] for r in kernel_config.kernel_config(df).collect()}
    assert got == {
        ("r", "", "CONFIG_A"): "y", ("r", "General setup", "CONFIG_B"): '"x=1"', ("r", "General setup", "CONFIG_C"): "not set",
        ("r", "General setup:IRQ subsystem", "CONFIG_D"): "y", ("r", "General setup:Timers", "CONFIG_E"): "m", ("r", "General setup", "CONFIG_F"): "y",
    }
