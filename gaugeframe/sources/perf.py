"""Recordings of the kernel's sampler: files of typed records to events, and events with symbols to stacks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import joins

#: Types of records, and the bits of a sample's fields in the order in which they are stored, with their layout.
MMAP, COMM, FORK, SAMPLE, MMAP2 = 1, 3, 7, 9, 10
FIELDS = ((1 << 16, "Q", "identifier"), (1, "Q", "ip"), (2, "II", "tid"), (4, "Q", "time"), (8, "Q", "addr"), (64, "Q", "id"), (512, "Q", "stream"), (128, "II", "cpu"), (256, "Q", "period"))
CALLCHAIN, READ = 32, 16
EVENTS = "run string, seq long, kind string, pid long, tid long, ns long, start long, length long, offset long, file string, chain array<long>"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(content: bytes) -> Iterator[tuple]:
    """(kind, pid, tid, ns, start, length, offset, file, chain) of the records of a file that samples by its first attribute; a record cut short ends it."""
    if content[:8] != b"PERFILE2":
        raise ValueError("not a recording")
    attrs, _, data, size = struct.unpack_from("<4Q", content, 24)
    kinds = struct.unpack_from("<Q", content, attrs + 24)[0]
    at, end = data, min(data + size, len(content))
    while at + 8 <= end:
        type_, _, length = struct.unpack_from("<IHH", content, at)
        if length < 8 or at + length > end:
            return
        body = content[at + 8 : at + length]
        at += length
        if type_ in (MMAP, MMAP2):
            pid, tid, start, size, offset = struct.unpack_from("<IIQQQ", body)
            yield "map", pid, tid, None, signed(start), signed(size), signed(offset), _text(body[32 if type_ == MMAP else 64 :]), None
        elif type_ == COMM:
            yield "name", *struct.unpack_from("<II", body), None, None, None, None, _text(body[8:]), None
        elif type_ == FORK:
            pid, parent, tid, _, ns = struct.unpack_from("<IIIIQ", body)
            yield "fork", pid, tid, ns, parent, None, None, None, None
        elif type_ == SAMPLE and not kinds & READ:
            k, found = 0, {}
            for bit, layout, name in FIELDS:
                if kinds & bit:
                    found[name] = struct.unpack_from("<" + layout, body, k)
                    k += struct.calcsize("<" + layout)
            chain = []
            if kinds & CALLCHAIN:
                n = struct.unpack_from("<Q", body, k)[0]
                chain = [signed(x) for x in struct.unpack_from(f"<{n}Q", body, k + 8)]
            pid, tid = found.get("tid", (None, None))
            yield "sample", pid, tid, found.get("time", (None,))[0], None, None, None, None, chain


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def events(files: DataFrame) -> DataFrame:
    """EVENTS of recordings (run, content), numbered as they stand; a fork's ``start`` is its parent's pid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for b in batches:
            for name, content in zip(b["run"], b["content"], strict=True):
                rows = []
                for seq, row in enumerate(parse(bytes(content))):
                    rows.append((name, seq, *row))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("run", "content").mapInPandas(run, EVENTS)


def mappings(events_: DataFrame) -> DataFrame:
    """run, pid, start, length, offset, file: what each process has mapped; one that was forked has its parent's mappings too."""
    maps = events_.where("kind = 'map'").select("run", "pid", "start", "length", "offset", "file", "seq")
    forks = events_.where("kind = 'fork' and pid <> start").select("run", F.col("pid").alias("child"), F.col("start").alias("pid"), F.col("seq").alias("fork_seq"))
    inherited = maps.join(forks, ["run", "pid"]).where("seq < fork_seq").select("run", F.col("child").alias("pid"), "start", "length", "offset", "file", "seq")
    every = maps.unionByName(inherited)
    return every.groupBy("run", "pid", "start").agg(F.max_by(F.struct("length", "offset", "file"), "seq").alias("m")).select("run", "pid", "start", "m.length", "m.offset", "m.file")


def stacks(events_: DataFrame, symbols: DataFrame, boot_ms: int = 0) -> DataFrame:
    """run, id, pid, ms, path of the samples: symbols(file, start, size, name) by place in their file. Marks of a change of context are no frames; an address that nothing
    maps is ``[unknown]``, one without a symbol the name of its file in brackets."""
    rows = events_.where("kind = 'sample'").select("run", F.col("seq").alias("id"), "pid", (F.floor(F.col("ns") / 1_000_000) + boot_ms).alias("ms"), F.posexplode("chain").alias("depth", "address"))
    rows = rows.where((F.col("address") >= 0) | (F.col("address") < -4096))
    mapped = joins.containing(rows, mappings(events_), ["run", "pid"], "address", "start", "length")
    mapped = mapped.select("run", "id", "depth", "file", (F.col("address") - F.col("start") + F.col("offset")).alias("address"))
    named = joins.symbolized(mapped, symbols, ["file"]).select("run", "id", "depth", F.coalesce("symbol", F.concat(F.lit("["), "file", F.lit("]"))).alias("frame"))
    frames = rows.join(named, ["run", "id", "depth"], "left").withColumn("frame", F.coalesce("frame", F.lit("[unknown]")))
    path = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("depth", "frame"))), lambda x: x["frame"]))
    return frames.groupBy("run", "id", "pid", "ms").agg(path.alias("path"))


def files_by_build(events_: DataFrame, builds: DataFrame) -> DataFrame:
    """Mappings with the file that builds(build_id, file, path) names for theirs, where one does."""
    return events_.join(builds.select("file", "path", "build_id"), "file", "left").withColumn("file", F.coalesce("path", "file")).drop("path")
