"""Exact substring deduplication by seed and extend.

Seeds: of the hashes of all runs of ``SEED`` words, the least one in every window of ``length`` words is an anchor
(winnowing), so equal windows hold equal anchors at equal places. Documents are joined on anchors that occur
more than once; every other window is unique and is never shuffled. Extend: around each shared anchor the
match is followed to both sides, window by window, as long as the words agree with those of an
earlier place; joined together, the windows that agree give the maximal repeats, and their words go.

Documents are dealt into blocks by a hash, and a block says each anchor or window once, so a passage
that a third of all documents share costs one row for each block. The text crosses the network once: the
three passes read the same exchange.

The earlier place is the one with the smaller doc_id, or the earlier start in the same document. Defined results:
null or empty text: no words. Null doc_id: comes before all others. Rows with the same doc_id: those in the lower block
come first, in a block those with the smaller xxhash64 of their text; equal ones in the order of arrival. Very long texts: whole, in one block. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.llm.common import hashes, rolled, with_block, words

SEED = 8
BLOCK_BYTES = 6 << 20
NO_ID = -(1 << 63)


class Windows:
    """All windows of a block: hash, anchor, and the place (row, start)."""

    def __init__(self, block: pd.DataFrame, length: int):
        self.rows = block.sort_values(["doc_id", "text_hash"], kind="stable", na_position="first").reset_index(drop=True)
        self.length = length
        ids = self.rows["doc_id"]
        self.ids = ids.fillna(NO_ID).astype("int64").to_numpy() if ids.isna().any() else ids.astype("int64").to_numpy()
        h = [hashes(words(t)) for t in self.rows["text"]]
        self.sizes = np.array([len(x) for x in h], np.int64)
        flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(h)), self.sizes)
        begin = np.cumsum(self.sizes) - self.sizes
        seed = min(SEED, length)
        self.seeds, self.reach = rolled(flat, seed), length - seed
        whole, anchor = rolled(flat, length), least(self.seeds, length - seed + 1)
        inside = row[: len(whole)] == row[length - 1 :]
        self.at = np.flatnonzero(inside)  # place in the block's run of words
        self.row = row[self.at]
        self.start = self.at - begin[self.row]
        self.hash, self.anchor = whole[self.at].view(np.int64), anchor[self.at].view(np.int64)

    @property
    def twins(self) -> np.ndarray:
        """Seeds that come again inside one window or in its neighbour, which keeps the anchor's value when it takes the twin in."""
        x = self.seeds
        return np.concatenate([np.zeros(0, np.int64), *(x[k:][x[k:] == x[:-k]].view(np.int64) for k in range(1, self.reach + 2) if len(x) > k)])


def least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values, by doubling."""
    have = 1
    while have * 2 <= k:
        x, have = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0], have * 2
    rest = k - have
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def repeats(docs: DataFrame, length: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, spans (maximal repeats: begin, end in words) for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_block(rows, block_bytes).withColumn("text_hash", F.xxhash64("text"))

    def anchors(block: pd.DataFrame) -> pd.DataFrame:
        w = Windows(block, length)
        if not len(w.at):
            return pd.DataFrame({"block": [], "anchor": [], "n": []})
        change = np.flatnonzero(np.r_[True, (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1])])  # a run of windows with one anchor
        # two equal seeds inside one window or two neighbours look like one run: they are said once more
        anchor, n = np.unique(np.concatenate([w.anchor[change], w.twins]), return_counts=True)
        return pd.DataFrame({"block": block["block"].iloc[0], "anchor": anchor, "n": n})

    def seeded(key: tuple, block: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(seeds):
            return pd.DataFrame({"hash": [], "doc_id": [], "place": []})
        w = Windows(block, length)
        pick = np.flatnonzero(np.isin(w.anchor, seeds["anchor"].to_numpy()))
        hash_, first, n = np.unique(w.hash[pick], return_index=True, return_counts=True)  # rows are in order, so the first is the earliest
        at = pick[first]
        return pd.DataFrame({"hash": hash_, "doc_id": w.ids[w.row[at]], "place": (int(key[0]) << 40) + 2 * w.start[at] + (n > 1)})

    def cut(key: tuple, block: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans")})
        w = Windows(block, length)
        gone = np.zeros(int(w.sizes.sum()) + 1, np.int64)
        if len(shared):
            shared = shared.sort_values("hash")
            known, mine = shared["hash"].to_numpy(), shared["mine"].to_numpy(bool)
            i = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
            hit = np.flatnonzero(known[i] == w.hash)
            _, earliest = np.unique(w.hash[hit], return_index=True)
            stays = np.zeros(len(hit), bool)
            stays[earliest] = mine[i[hit[earliest]]]
            at = w.at[hit[~stays]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + length, -1)
        gone = np.cumsum(gone[:-1]) > 0
        out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept_text", "spans")}
        begin = 0
        for text, size in zip(w.rows["text"], w.sizes.tolist(), strict=True):
            mask = gone[begin : begin + size]
            begin += size
            split = words(text)
            kept = b" ".join([x for x, g in zip(split, mask.tolist(), strict=True) if not g] if mask.any() else split)
            edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
            for c, v in (("n_words", size), ("n_removed", int(mask.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept_text", kept.decode("utf-8", "replace")), ("spans", [{"begin": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])):
                out[c].append(v)
        return pd.DataFrame({"doc_id": w.rows["doc_id"]} | out)

    blocks = rows.groupBy("block")
    seeds = blocks.applyInPandas(anchors, "block int, anchor long, n long")
    seeds = seeds.withColumn("all", F.sum("n").over(Window.partitionBy("anchor"))).where("all > 1").select("block", "anchor")
    # place: block, start, and whether the block has the window more than once; mine: the earliest place of all is this block's
    found = blocks.cogroup(seeds.groupBy("block")).applyInPandas(seeded, "hash long, doc_id long, place long")
    by_hash = Window.partitionBy("hash")
    found = found.withColumns({"low": F.min(F.struct("doc_id", "place")).over(by_hash), "blocks": F.count("*").over(by_hash)}).where("blocks > 1 or place % 2 = 1")
    shared = found.select((F.shiftright("place", 40)).cast("int").alias("block"), "hash", (F.col("low.place") == F.col("place")).alias("mine"))
    return blocks.cogroup(shared.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<begin:long,end:long>>")


def oracle(length: int = 20) -> str:
    """DuckDB SQL for doc_id, n_words, n_removed, kept_sha256, by all windows."""
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, j, md5(array_to_string(w[j:j + {length - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS j FROM w WHERE len(w) >= {length})),
    again AS (SELECT doc_id, j FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + {length})) AS j FROM again),
    each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
    kept AS (SELECT e.doc_id, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN x END, ' ' ORDER BY e.j) AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
