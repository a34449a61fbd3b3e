"""Near-duplicate detection by b-bit MinHash.

1. Each text becomes its set of word shingles (64-bit hashes), 128 minima of it, band keys of four
   minima each, and a signature that keeps two low bits of every minimum: 256 bits in all.
2. Equal sets collapse to one class, so copies by the thousand cost one row from here on.
3. Classes that share a band key are candidates. Bit counts of their packed signatures give the share of
   equal low bits; freed of chance agreement (a quarter) it estimates the similarity. Candidates whose estimate a pair
   at the threshold falls below in one case of ``1 / MISS`` at most are left out, the others form families; of their links
   only a spanning forest leaves a task.
4. Every pair inside a family is held against the full sets, and the linked ones form the components.

The number of bands follows from the threshold: a pair at it shares no band with probability ``MISS`` at most. Buckets
and families above a block's size are cut into blocks; each pair of blocks is a row group of its own,
so no task grows with a hot group and no pair is left out. Their sizes are counted before texts or signatures are attached.

Defined results: null or empty text: empty set, linked with nothing, its own component. Fewer words than the shingle:
the whole sequence is one shingle. Very long texts: whole, all their shingles. Null doc_id: takes part in links, never names a component unless
all its members have none; then the one with the least text_hash is kept. Repeated rows: each is returned, with the same component;
``deduplicate`` keeps one row of each component, and all rows without words. Ties in the least doc_id: the least text_hash stays. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names; ``deduplicate`` returns them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import components, forest, hashes, lowered, materialize, mixed, released, rolled

MINIMA, BITS, ROWS = 128, 2, 4
MISS = 1e-6
BUCKET_BLOCK, FAMILY_BLOCK = 1024, 384
#: Texts whose sets a task holds at once.
AT_ONCE = 1000


def bands_for(threshold: float) -> int:
    """So many bands that a pair at the threshold shares none with probability MISS at most (all minima's, if they don't suffice)."""
    return min(MINIMA // ROWS, max(1, math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS))))) if threshold < 1 else 1


def least_estimate(threshold: float) -> float:
    """The estimate below which a pair at the threshold falls with probability MISS at most, by the binomial distribution of equal low bits."""
    p, below, k = threshold + (1 - threshold) * 0.5**BITS, 0.0, 0
    while k < MINIMA and (below := below + math.comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)) <= MISS:
        k += 1
    return (k / MINIMA - 0.5**BITS) / (1 - 0.5**BITS)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = hashes(lowered(text))
    return np.unique(rolled(h, min(width, len(h)))) if len(h) else h


def _family_of_hashes() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, MINIMA + 1, dtype=np.uint64)
    return mixed(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mixed(k + np.uint64(1 << 40))


def signatures(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 words of packed low bits, n x bands keys) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mul, add = _family_of_hashes()
    low = np.empty((len(sets), MINIMA), np.uint32)
    step = np.empty_like(flat)
    for j in range(MINIMA):
        np.multiply(flat, mul[j], out=step)
        np.add(step, add[j], out=step)
        low[:, j] = np.minimum.reduceat(step, at) >> np.uint64(32)
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(sets), -1, 64 // BITS)
    packed = np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    keys = np.full((len(sets), bands), 7, np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r : bands * ROWS : ROWS])
    return packed, keys.view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (n x 4 each): share of equal low bits, freed of chance agreement."""
    diff = x ^ y
    diff = (diff | (diff >> np.uint64(1))) & np.uint64(0x5555555555555555)
    equal = 1 - np.bitwise_count(diff).sum(axis=1) / MINIMA
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def fingerprints(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cid (class of equal sets, null for an empty one), sig, bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[k : k + AT_ONCE] for b in released(batches) for k in range(0, len(b), AT_ONCE)):
            sets = [shingles(t, width) for t in b["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            cid, sig, key = [None] * len(b), [None] * len(b), [None] * len(b)
            if full:
                packed, keys = signatures([sets[i] for i in full], bands)
                for k, i in enumerate(full):
                    cid[i], sig[i], key[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), packed[k].tobytes(), keys[k]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_shingles": [len(s) for s in sets], "cid": cid, "sig": sig, "bands": key})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, n_shingles long, cid binary, sig binary, bands array<long>")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of the batches of a sorted partition, as frames of one or more complete groups."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = np.logical_and.reduce([b[k].to_numpy() == b[k].iloc[-1] for k in keys])
        cut = int(len(b) - np.argmin(last[::-1])) if not last.all() else 0
        if cut or (held and not np.logical_and.reduce([held[-1][k].iloc[-1] == b[k].iloc[0] for k in keys])):
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True) if held else b.iloc[:cut].reset_index(drop=True)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Deals the rows of each ``key`` (with its count ``members``) into pairs of blocks p <= q; ``own`` is a row's block."""
    n = F.ceil(F.col("members") / size).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("cid"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select("*", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).drop("members", "other")


def families(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, root): families of classes that are linked by estimated similarity inside band buckets."""

    least = least_estimate(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in grouped(batches, ["key", "p", "q"]):
            key, p, q, own, n = (b[k].to_numpy() for k in ("key", "p", "q", "own", "n_shingles"))
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            left = np.repeat(np.r_[start[1:], len(b)], np.diff(np.r_[start, len(b)])) - np.arange(len(b))  # rows up to the group's end
            sig = np.frombuffer(b"".join(b["sig"]), np.uint64).reshape(len(b), -1)
            cids, node = np.unique(np.array([c.hex() for c in b["cid"]]), return_inverse=True)
            links = []
            for lag in range(1, int(left.max())):
                x = np.flatnonzero(left > lag)
                y = x + lag
                near = (p[x] == q[x]) | (own[x] != own[y])
                near &= np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
                x, y = x[near], y[near]
                good = estimate(sig[x], sig[y]) >= least
                links.append(np.stack([node[x[good]], node[y[good]]], axis=1))
            if links:
                found = forest(np.unique(np.concatenate(links), axis=0))
                yield pd.DataFrame({"a": [bytes.fromhex(c) for c in cids[found[:, 0]]], "b": [bytes.fromhex(c) for c in cids[found[:, 1]]]})

    keys = classes.select("cid", "sig", "n_shingles", F.explode("bands").alias("key"))
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key")
    dealt = _blocks(shared, "key", BUCKET_BLOCK).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return components(dealt.mapInPandas(run, "a binary, b binary"))


def _linked(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> np.ndarray:
    """Pairs of sets with 100 * intersection >= percent * union; with sides, only pairs of different sides."""
    sizes = np.array([len(s) for s in sets])
    words, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(code)[code] > 1
    row, code = row[often], code[often]
    _, code = np.unique(code, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(256, (1 << 22) // len(sets))
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], code[lo:hi] - first] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common
    good = np.triu(100 * common >= percent * both, 1)
    if sides is not None:
        good &= sides[:, None] != sides[None, :]
    return np.argwhere(good)


def confirmed(members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the true links between the members (root, cid, text) of each family."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in grouped(released(batches), ["root", "p", "q"]):
            for (_, p, q), g in b.groupby(["root", "p", "q"], sort=False):
                g = g.drop_duplicates("cid")
                cids, own = g["cid"].tolist(), g["own"].to_numpy()
                found = forest(_linked([shingles(t, width) for t in g["text"]], None if p == q else own, percent)) if len(g) > 1 else []
                if len(found):
                    yield pd.DataFrame({"a": [cids[i] for i in found[:, 0]], "b": [cids[i] for i in found[:, 1]]})

    return members.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInPandas(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component (its name in bytes, null without words), keeper (doc_id and text_hash of
    the row that stands for it), component_id and kept for every row of ``docs``.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    prints = materialize(fingerprints(docs, width, bands_for(percent / 100)))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = prints.where("cid is not null").groupBy("cid").agg(F.min(row).alias("row"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes)
    family = families(classes, percent / 100)
    wanted = family.join(family.groupBy("root").agg(F.count("*").alias("members")), "root").withColumnRenamed("node", "cid")
    wanted = _blocks(wanted, "root", FAMILY_BLOCK).join(classes.select("cid", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash")), "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    members = texts.join(wanted, texts["text_hash"].eqNullSafe(wanted["hash"]) & texts["doc_id"].eqNullSafe(wanted["id"]))
    links = confirmed(members.select("root", "p", "q", "own", "cid", "text"), width, percent)
    comps = components(links).withColumnRenamed("node", "cid")
    named = materialize(classes.select("cid", "row").join(comps, "cid"))
    moved = named.drop("row").join(named.groupBy("root").agg(F.min("row").alias("low")), "root")
    label = classes.select("cid", F.col("row").alias("own")).join(moved, "cid", "left").select("cid", F.coalesce("low", "own").alias("keeper"), F.coalesce("root", "cid").alias("component"))
    out = prints.select("doc_id", "text_hash", "n_shingles", "cid").join(label, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    kept = F.when(component.isNull() & F.col("cid").isNotNull(), F.col("text_hash").eqNullSafe(F.col("keeper.text_hash"))).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.col("keeper").dropFields("no_id").alias("keeper"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each component, and all without words."""
    found = near_duplicates(docs, width, percent).where("component is not null")
    stays = found.select(F.col("keeper.doc_id").alias("__id"), F.col("keeper.text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    worded = rows.join(stays, rows["doc_id"].cast("long").eqNullSafe(stays["__id"]) & rows["__text_hash"].eqNullSafe(stays["__hash"])).dropDuplicates(["__id", "__hash"])
    wordless = docs.where(~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return worded.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(wordless)


def oracle(width: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id, kept: all pairs that share a shingle, and reachability. For tables of some thousand texts."""
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capital}', '{small}'), '[^ 	-
]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + {width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS j FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
    c AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) m USING (doc_id)"""
