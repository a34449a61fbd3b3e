"""Sources evaluated in one row a snapshot: quotients, averages by grouping sets, memory payloads in one pass, and how often a plan reads its table."""

import pytest
from pyspark.sql import functions as F

from gaugeframe.sources import pipelines, snapshots

RAW = "run string, sample_idx long, ts long, payload string"


def text(devices):
    return "\n".join(f"{name}:\n" + "\n".join(f"{m} {v}" for m, v in metrics.items()) for name, metrics in devices.items())


def rows(frame):
    return {(r["run"], r["metric"], r["series"], r["sample_idx"]): (r["time_diff"], r["value"], r["is_aggregate"]) for r in frame.collect()}


def test_quotients_and_averages(spark):
    snaps = [
        {"e0": {"send_bytes": 10, "send_wrs": 1, "recv_wrs": 4}, "e1": {"send_bytes": 7}},
        {"e0": {"send_bytes": 110, "send_wrs": 6, "recv_wrs": 4}, "e1": {"send_bytes": 17}},
        {"e0": {"send_wrs": 7, "recv_wrs": 5}, "e1": {"send_bytes": 9}},  # send_bytes of e0 is missing, that of e1 fell
        {"e0": {"send_bytes": 150, "send_wrs": 7, "recv_wrs": 6}, "e1": {"send_bytes": 29}},
    ]
    raw = spark.createDataFrame([("r", k, 10 * k, text(s)) for k, s in enumerate(snaps)], RAW)
    got = rows(pipelines.efa_stat(raw))
    name = "avg_bytes_per_send_wr"
    assert got["r", "send_bytes", "e0", 3] == (30, 2.0, False)  # against the second snapshot
    assert ("r", "send_bytes", "e1", 2) not in got and got["r", "send_bytes", "e1", 3][1] == 2.0
    assert got["r", name, "e0", 1][1] == 20.0 and got["r", name, "e0", 2][1] == 0.0 and got["r", name, "e0", 3][1] == 0.0 and got["r", name, "e1", 1][1] == 0.0
    assert got["r", name, "average", 1] == (10, 10.0, True) and got["r", "send_bytes", "average", 1] == (10, (10.0 + 1.0) / 2, True)
    assert not any(m in ("send_wrs", "recv_wrs", "avg_bytes_per_recv_wr") and s == "average" for _, m, s, _ in got)
    assert got["r", "avg_bytes_per_recv_wr", "e0", 1][1] == 0.0 and not any(m == "avg_bytes_per_recv_wr" and s == "e1" for _, m, s, _ in got)


BUDDY = "Node 0, zone DMA 1 2 x 4\nNode 1, zone  Normal, 5\nshort 1"
TYPES = "Page block order: 9\nNode 0, zone DMA, type Movable 3 4\nNode 0, zone DMA 1 2 3 4 5 6 7 8"
SLAB = "slabinfo - version: 2.1\n# name <objs>\next4 1 2 3 4 5 : tunables 8 9 10 : slabdata 13 14 15\nshort 1 2"


def test_memory_in_one_pass(spark):
    raw = spark.createDataFrame([("r", 0, 0, BUDDY, TYPES, SLAB), ("r", 1, 10, BUDDY, None, "no head\n" + SLAB.split("\n")[2]), ("q", 0, 0, None, None, None)], "run string, sample_idx long, ts long, buddyinfo string, pagetypeinfo string, slabinfo string")
    parts = [f(raw.withColumnRenamed(c, "payload")) for c, f in (("buddyinfo", snapshots.buddies), ("pagetypeinfo", snapshots.page_types), ("slabinfo", snapshots.slabs))]
    want = sorted(tuple(r) for part in parts for r in part.collect())
    got = sorted(tuple(r) for r in snapshots.memory(raw).collect())
    assert got == want and ("r", 0, 0, "buddyinfo_order_3", "node_0_zone_DMA", 4.0) in got and ("r", 0, 0, "slabinfo_num_slabs", "ext4", 14.0) in got
    assert not any(r[3] == "buddyinfo_order_2" or r[3].startswith("slab") and r[1] == 1 for r in got)
    assert {r[5] for r in got if r[3].startswith("pageblocks_type_") and r[4] == "zone_DMA"} >= {1.0, 2.0, 3.0, 4.0, 5.0, 6.0}


@pytest.mark.parametrize(("name", "most"), [("efa_stat", 3), ("ena_stat", 3), ("numastat", 3), ("interrupts", 6), ("memalloc", 2)])
def test_reads_of_a_table(spark, tmp_path, name, most):
    cells = {c: F.lit(BUDDY if c == "buddyinfo" else TYPES if c == "pagetypeinfo" else SLAB) for c in ("buddyinfo", "pagetypeinfo", "slabinfo")}
    spark.createDataFrame([("r", 0, 0, text({"e0": {"send_bytes": 1}}))], RAW).withColumns(cells).write.parquet(str(tmp_path / "raw"))
    plan = pipelines.SOURCES[name](spark.read.parquet(str(tmp_path / "raw")))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("parquet") <= most
