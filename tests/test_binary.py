import struct

import pytest

from gaugeframe.sources import binary, perf


def record(kind, body):
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<IHH", kind, 0, 8 + len(body)) + body


def recording(*records, sample_type=1 | 2 | 4 | 32):
    attr = struct.pack("<IIQQQ", 0, 64, 0, 0, sample_type).ljust(64, b"\0")
    data = b"".join(records)
    head = b"PERFILE2" + struct.pack("<QQ", 104, 64 + 16) + struct.pack("<4Q", 104, 80, 184, len(data)) + b"\0" * 48
    return head[:104] + attr + b"\0" * 16 + data


def mapped(pid, start, size, offset, name):
    return record(perf.MMAP, struct.pack("<IIQQQ", pid, pid, start, size, offset) + name + b"\0")


def sample(pid, ns, *chain):
    return record(perf.SAMPLE, struct.pack("<QIIQQ", chain[0], pid, pid, ns, len(chain)) + struct.pack(f"<{len(chain)}Q", *chain))


def test_recordings(spark):
    context = (1 << 64) - 512
    content = recording(
        mapped(1, 1000, 500, 0, b"/bin/a"), record(perf.MMAP2, struct.pack("<IIQQQ", 1, 1, 5000, 100, 50) + b"\0" * 32 + b"/lib/b\0"), record(perf.COMM, struct.pack("<II", 1, 1) + b"a\0"),
        record(perf.FORK, struct.pack("<IIIIQ", 2, 1, 2, 1, 9)), mapped(1, 9000, 10, 0, b"later"), sample(1, 5_000_000, context, 5010, 1100), sample(2, 6_000_000, 1210, 9005, 77),
    ) + b"\x01"
    rows = perf.events(spark.createDataFrame([("r", content), ("s", recording())], "run string, content binary"))
    assert [r["kind"] for r in rows.orderBy("seq").collect()] == ["map", "map", "name", "fork", "map", "sample", "sample"]
    symbols = spark.createDataFrame([("/bin/a", 100, 50, "main"), ("/bin/a", 200, 0, "tail"), ("/lib/b", 0, 100, "read")], "file string, start long, size long, name string")
    got = {r["pid"]: (r["ms"], r["path"]) for r in perf.stacks(rows, symbols, 10).collect()}
    assert got == {1: (15, ["main", "read"]), 2: (16, ["[unknown]", "[unknown]", "tail"])}  # the fork has what was mapped before it
    builds = spark.createDataFrame([("x1", "/bin/a", "/debug/a")], "build_id string, file string, path string")
    assert {r["file"] for r in perf.files_by_build(perf.mappings(rows), builds).collect()} == {"/debug/a", "/lib/b", "later"}
    with pytest.raises(ValueError, match="not a recording"):
        list(perf.parse(b"x" * 200))


def test_fixed_width(spark):
    content = b"head" + struct.pack("<QiQiQi", 1, -2, 3, 4, 1 << 40, 6) + b"cut"
    files = spark.createDataFrame([("r", content), ("s", b""), ("t", b"head")], "run string, content binary")
    assert sorted(tuple(r) for r in binary.fixed_width(files, {"ino": "u8", "n": "i4"}, 4).collect()) == [("r", 1, -2), ("r", 3, 4), ("r", 1 << 40, 6)]
