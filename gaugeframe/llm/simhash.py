"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of the XXH64 hashes of a text's word shingles (repeats included) have it. Two fingerprints that differ in at
most ``reach`` bits have a midpoint: a value that differs from each in at most ``reach / 2`` bits. So every distinct fingerprint stands for all its
variants within that half, variants are shuffled by their leading bits, and equal variants of different fingerprints are the links, verified by their
own distance.

What crosses the network is not the variants (2081 of 64 bits at reach 4) but a row for each slice of them: a slice is all values with the same leading bits, and
a fingerprint sends itself to the slices that hold any of its variants (1 + B + B(B-1)/2 of 2**B), where exactly those are written out. The number of leading
bits follows from the number of fingerprints; a slice that still holds more than ``SLICE`` variants is divided by its next bits, until it fits
or its bits are used up. A slice of one value holds at most as many fingerprints as it has variants itself, so no task grows with a hot
group. Equal fingerprints are one row before that, and the fingerprints around one variant are chained, not paired: all of them differ in at most
``reach`` bits from each other. A slice says each component by its least fingerprint.

Defined results: null, empty or wordless text: fingerprint zero, linked like any other. Fewer words than the shingle: the whole sequence is one shingle. Very
long texts: whole, in pieces of ``PIECE`` shingles. Null doc_id: takes part in links, names a component (null) only if no member has an id. Repeated rows:
each is returned. Ties: exactly half of the hashes leave a bit 0. Empty table: no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import components, if_few, lowered, materialize, stars
from gaugeframe.llm.near_dedup import grouped

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once, variants that a slice may hold, leading bits that a full slice is divided by.
PIECE, SLICE, STEP = 1 << 16, 1 << 21, 4
#: How many times the mean slice's variants a slice may hold, at least: few slices are divided again.
ROOM = 4
#: Tasks for the slices: beyond that many, a task takes more slices, one after the other.
MOST_TASKS = 20_000
#: Of all rows, the share from which on a fingerprint counts as hot; so there are at most 1 / HOT hot ones.
HOT = 1e-3


def fingerprint(words: list[bytes], width: int) -> int:
    """The bits that over half of the shingles' hashes have."""
    n = max(1, len(words) - width + 1) if words else 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        joined = [b" ".join(words[k : k + width]) for k in range(at, min(n, at + PIECE))]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(lowered(t), width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> int:
    """How many values of ``bits`` bits differ from one in at most ``radius`` bits."""
    return sum(math.comb(bits, k) for k in range(radius + 1))


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in c) for r in range(min(bits, radius) + 1) for c in combinations(range(bits), r)], np.uint64)


def dealt(rows: DataFrame, depth: int, step: int, radius: int) -> DataFrame:
    """Rows (prefix of ``depth`` bits, left, fp), each sent to the slices with ``step`` further bits; ``left`` (``radius`` at most) is how many more bits may differ."""
    own = F.shiftrightunsigned("fp", BITS - depth - step).bitwiseAND(F.lit((1 << step) - 1))
    flips = F.array(*[F.lit(m) for m in masks(step, radius).tolist()])
    out = rows.select("prefix", "left", own.alias("own"), "fp", F.explode(flips).alias("flip")).where(F.bit_count("flip") <= F.col("left"))
    return out.select((F.shiftleft("prefix", step) + F.col("own").bitwiseXOR(F.col("flip"))).alias("prefix"), (F.col("left") - F.bit_count("flip")).alias("left"), "fp")


def slices(classes: DataFrame, radius: int, size: int) -> list[tuple[int, DataFrame]]:
    """(leading bits, rows prefix, left, fp): every variant of the fingerprints ``fp`` lies in exactly one slice, at most ``size`` in each unless its bits are used up."""
    depth = min(40, (classes.count() * ball(BITS, radius) * ROOM // size).bit_length())
    rows = dealt(classes.select(F.lit(0).cast("long").alias("prefix"), F.lit(radius).alias("left"), "fp"), 0, depth, radius)
    out = []
    while True:
        rows = materialize(rows)
        held = F.element_at(F.array(*[F.lit(ball(BITS - depth, r)) for r in range(radius + 1)]), F.col("left") + 1)
        full = rows.groupBy("prefix").agg(F.sum(held).alias("held")).where(F.col("held") > size).select("prefix")
        if depth == BITS or full.isEmpty():
            return [*out, (depth, rows)]
        full = if_few(materialize(full))
        out.append((depth, rows.join(full, "prefix", "left_anti")))
        step = min(STEP, BITS - depth)
        rows, depth = dealt(rows.join(full, "prefix", "left_semi"), depth, step, radius), depth + step


def links(fp: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of places in ``fp`` that chain those with a common variant in a slice with ``bits`` free bits."""
    low = fp & np.uint64((1 << bits) - 1)
    each = [(place := np.flatnonzero(left == r), low[place][:, None] ^ masks(bits, r)[None, :]) for r in range(int(left.max()) + 1)]
    every = np.sort(np.concatenate([v.ravel() for _, v in each]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return np.zeros((0, 2), np.int64)
    sieve, cell = np.zeros(1 << 20, bool), lambda v: v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
    sieve[cell(twice)] = True
    found = []
    for place, v in each:
        x, y = np.nonzero(sieve[cell(v)])
        v = v[x, y]
        i = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        same = twice[i] == v
        found.append(np.stack([i[same], place[x[same]]], axis=1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    chain = found[1:, 0] == found[:-1, 0]
    return np.unique(np.stack([found[:-1, 1][chain], found[1:, 1][chain]], axis=1), axis=0)


def linked(rows: DataFrame, depth: int, reach: int, tasks: int) -> DataFrame:
    """(a, b): in every slice of ``depth`` leading bits, each fingerprint that shares a variant with another, and the least one of its component there. So the many slices that
    a dense group has in common say the same pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["prefix"]):
            for _, g in frame.groupby("prefix", sort=False):
                g = g.sort_values("fp")
                fp = g["fp"].to_numpy()
                pair = links(fp.view(np.uint64), g["left"].to_numpy(), BITS - depth)
                near = np.bitwise_count((fp[pair[:, 0]] ^ fp[pair[:, 1]]).view(np.uint64)) <= reach
                star = stars(pair[near])
                yield pd.DataFrame({"a": fp[star[:, 0]], "b": fp[star[:, 1]]})

    return rows.repartition(tasks, "prefix").sortWithinPartitions("prefix").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, reach: int = 4, size: int = SLICE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row; fingerprints are linked at ``reach`` (even) or fewer differing bits."""
    if reach % 2:
        raise ValueError("reach must be even")
    prints = materialize(fingerprints(docs, width))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count("*").alias("members")))
    total, distinct = classes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.count("*")).first()
    tasks = min(MOST_TASKS, 1 + distinct * ball(BITS, reach // 2) // (2 * size))
    pairs = [linked(rows, depth, reach, tasks) for depth, rows in slices(classes, reach // 2, size)]
    comps = components(reduce(DataFrame.unionByName, pairs)).withColumnRenamed("node", "fp")
    named = classes.join(comps, "fp")
    moved = named.select("fp", "root").join(named.groupBy("root").agg(F.min("own").alias("low")), "root").select("fp", F.lit(True).alias("moved"), "low")
    labels = classes.join(moved, "fp", "left").select("fp", "members", F.when(F.col("moved"), F.col("low")).otherwise(F.col("own")).alias("component_id"))
    labels = materialize(labels)
    often = F.col("members") >= HOT * total
    hot = F.broadcast(labels.where(often).select("fp", "component_id", F.lit(True).alias("hot")))  # 1 / HOT rows at most
    out = ("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    rows = prints.join(hot, "fp", "left")
    rest = rows.where("hot is null").drop("component_id").join(labels.where(~often), "fp").select(*out)
    return rows.where("hot").select(*out).unionByName(rest)
