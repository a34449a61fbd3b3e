"""Periodic runs of words by the runs theorem.

A run is a stretch of words with a smallest period q that no neighbour extends. Every run holds a Lyndon root of its period that is, at its place, the
longest Lyndon word under the order of the words or under the opposite one. So there are at most two candidates for each place:

1. The suffix array of the words comes from prefix doubling: only suffixes still tied are sorted again. Its inverse is the rank of each suffix.
2. The longest Lyndon word from i ends before the next smaller value of the rank: minima of blocks, doubled, and a scan inside one block find it.
3. The root is extended by the longest common extension of i and i + q to the right, and of the places before them to the left: a
   minimum over the LCP array (of the words, and of the words backwards), by a sparse table.

All documents of a batch share one array: a place's first key is its document, so no suffix is tied with one of another document, and the end of a
document is smaller than any word under both orders. Work is n log n in the words of a batch; memory is about 60 bytes a word, and 4 more for each doubling of the longest
repeat inside one document.

Defined results: null, empty or wordless text: no runs, hashes of the empty string. Null doc_id: never edited (``with_tails``), otherwise as any row. Very long texts: whole, in a
batch of their own. Repeated rows: each is returned, equal. Ties for the greatest exponent: the smallest start, then the smallest period. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import CRC_TABLE, crc32_sql, words

LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Words in a batch, and values in a block of the table of minima.
BATCH_WORDS, BLOCK = 1 << 18, 16


class Minima:
    """Range minima: a sparse table over blocks, a scan inside them."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.x = np.concatenate([x, np.full(-len(x) % BLOCK + BLOCK, np.iinfo(x.dtype).max, x.dtype)])
        self.table = [self.x.reshape(-1, BLOCK).min(axis=1)]
        while (h := 1 << len(self.table) - 1) * 2 <= len(self.table[0]):
            self.table.append(np.minimum(self.table[-1][:-h], self.table[-1][h:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of x[a:b], for every a < b."""
        out = self.x[a].copy()
        near, far = np.minimum(b, -(-a // BLOCK) * BLOCK), np.maximum(a, b // BLOCK * BLOCK)
        for k in range(BLOCK):
            np.minimum(out, self.x[np.minimum(a + k, np.maximum(near - 1, a))], out=out)
            np.minimum(out, self.x[np.maximum(b - 1 - k, np.minimum(far, b - 1))], out=out)
        first, last = -(-a // BLOCK), b // BLOCK
        some = np.flatnonzero(first < last)
        first, last = first[some], last[some]
        level = np.frexp((last - first).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[some[at]] = np.minimum(out[some[at]], np.minimum(self.table[k][first[at]], self.table[k][last[at] - (1 << k)]))
        return out

    def next_smaller(self) -> np.ndarray:
        """For each i the least j > i with x[j] < x[i]; one must exist but for the last."""
        out = np.full(self.n, self.n, np.int64)
        wait, at = np.arange(self.n - 1), np.arange(1, self.n)
        for _ in range(BLOCK):  # most are near
            hit = self.x[at] < self.x[wait]
            out[wait[hit]] = at[hit]
            wait, at = wait[~hit], np.minimum(at[~hit] + 1, len(self.x) - 1)
        block = wait // BLOCK + 1  # the rest of their own block holds no smaller one
        for k in reversed(range(len(self.table))):
            t = self.table[k]
            inside = block + (1 << k) <= len(self.table[0])
            pass_ = inside & (t[np.minimum(block, len(t) - 1)] >= self.x[wait])
            block = block + (pass_ << k)
        at = np.minimum(block * BLOCK, len(self.x) - 1)
        while len(wait):
            hit = (self.x[at] < self.x[wait]) | (at >= self.n)
            out[wait[hit]] = np.minimum(at[hit], self.n)
            wait, at = wait[~hit], np.minimum(at[~hit] + 1, len(self.x) - 1)
        return out


class Suffixes:
    """Ranks of all suffixes of ``codes`` (a document's end: 0, words from 1), compared inside each document, and their LCP array if asked for."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, lcp: bool):
        n = len(codes)
        key = doc.astype(np.int64) << 32 | codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.levels = [rank := self._ranks(order, np.r_[True, key[1:] != key[:-1]])]
        k = 1
        while True:
            tied = np.r_[False, rank[order][1:] == rank[order][:-1]]
            tied[:-1] |= tied[1:]
            place = np.flatnonzero(tied)
            if not len(place):
                break
            at = order[place]
            first, second = rank[at].astype(np.int64), rank[np.minimum(at + k, n - 1)].astype(np.int64)
            again = np.lexsort((second, first))
            at, first, second = at[again], first[again], second[again]
            order[place] = at
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            rank = rank.copy()
            rank[at] = place[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            if lcp:
                self.levels.append(rank)
            k *= 2
        self.rank = rank
        self.lcp = Minima(self._adjacent(order)) if lcp else None
        self.levels = []

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int32)
        out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return out

    def _adjacent(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix and the one before it in order: at every level, equal ranks are 2**level equal words."""
        x, y = order[1:].copy(), order[:-1].copy()
        out = np.zeros(len(x), np.int32)
        for level in reversed(range(len(self.levels) - 1)):  # under the last one, all differ
            rank, k = self.levels[level], 1 << level
            top = len(rank) - 1
            same = rank[np.minimum(x, top)] == rank[np.minimum(y, top)]
            same &= (x <= top) & (y <= top)
            x, y, out = x + same * k, y + same * k, out + (same * k).astype(np.int32)
        return np.r_[np.int32(0), out]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common extension of the suffixes i and j (different ones, of the same document)."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.lcp.between(np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def runs(documents: list[np.ndarray], least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> list[np.ndarray]:
    """For each document (word codes from 0 on) its runs as rows (start, length, period), by start, then period: those of at least ``least`` words and ``times`` (2 or more) periods."""
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(documents)), sizes)
    codes = np.zeros(n, np.int64)
    word = np.ones(n, bool)
    word[begin + sizes - 1] = False
    codes[word] = np.concatenate(documents) + 1 if len(documents) else []
    forward = Suffixes(codes, doc, lcp=True)
    against = Suffixes(np.where(word, codes.max(initial=0) + 1 - codes, 0), doc, lcp=False)
    found = []
    for s in (forward, against):
        i = np.flatnonzero(word)
        q = Minima(s.rank).next_smaller()[i] - i
        for far in range(min(2, times - 1)):  # a root that comes again begins with the same words
            same = codes[np.minimum(i + q + far, n - 1)] == codes[i + far]
            i, q = i[same | (q == far)], q[same | (q == far)]
        right = forward.extension(i, i + q)
        enough = right > (times - 2) * q  # after the first root of a run
        found.append(np.stack([i, q, right])[:, enough])
    i, q, right = np.concatenate(found, axis=1)
    some = np.unique(doc[i])  # documents with a candidate
    out = np.zeros((0, 4), np.int64)
    if len(some):
        back = Suffixes(np.concatenate([np.r_[codes[begin[d] : begin[d] + sizes[d] - 1][::-1], 0] for d in some.tolist()]), np.repeat(some, sizes[some]), lcp=True)
        shift = np.zeros(len(documents), np.int64)
        shift[some] = np.cumsum(sizes[some]) - sizes[some]
        mirror = shift[doc[i]] + sizes[doc[i]] - 2 - (i - begin[doc[i]])  # where i is in the words backwards
        left = back.extension(mirror, mirror - q) - 1
        length = left + right + q
        good = (length >= least) & (length >= times * q)
        out = np.unique(np.stack([doc[i], i - left - begin[doc[i]], q, length], axis=1)[good], axis=0)
    ends = np.searchsorted(out[:, 0], np.arange(1, len(documents)))
    return [x[:, [1, 3, 2]] for x in np.split(out, ends)] if documents else []


def tailed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of the n words of a document that is edited to end in repeats (a tenth, by its id); else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def summary(text: list[bytes], found: np.ndarray) -> tuple:
    """n_runs, the run with the greatest exponent (start, length, period, exponent_milli), the hash of all, the words without repeats."""
    best = min(found.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    kept = b" ".join([text[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)] if len(found) else text)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist()).encode()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said).hexdigest(), kept)


NAMES = ("start", "length", "period", "exponent_milli")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_TIMES, with_tails: bool = False, with_text: bool = False) -> DataFrame:
    """For every row: doc_id, n_runs, start, length, period, exponent_milli of the run with the greatest length / period, runs_sha256, collapsed_sha256;
    with_text: also runs (start, length, period) and collapsed, the words without the repeats of runs. with_tails: a tenth of the documents is edited first."""

    def digest(ids: list, texts: list[list[bytes]], codes: list[np.ndarray]) -> pd.DataFrame:
        rows = []
        for doc_id, text, found in zip(ids, texts, runs(codes, least, times), strict=True):
            *values, kept = summary(text, found)
            more = [[{"start": s, "length": n, "period": q} for s, n, q in found.tolist()], kept.decode("utf-8", "replace")] if with_text else []
            rows.append((doc_id, *values, hashlib.sha256(kept).hexdigest(), *more))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")] + (["runs", "collapsed"] if with_text else []))
        return out.astype({c: "Int64" for c in ("doc_id", *NAMES)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, codes, size, known = [], [], [], 0, {}
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                split = words(text)
                code = np.array([known.setdefault(w, len(known)) for w in split], np.int64)
                place = tailed(doc_id, len(split)) if with_tails else None
                if place is not None:
                    split, code = [split[k] for k in place.tolist()], code[place]
                ids.append(doc_id)
                texts.append(split)
                codes.append(code)
                size += len(split) + 1
                if size >= BATCH_WORDS:
                    yield digest(ids, texts, codes)
                    ids, texts, codes, size, known = [], [], [], 0, {}
            if ids:
                yield digest(ids, texts, codes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, SCHEMA + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_text else ""))


def oracle() -> str:
    """DuckDB SQL for ``periodic_runs`` with tails. Of a run with period q in (g/2, g], the g words at any of its places come again q words later, not before."""
    levels = 20
    return rf"""WITH RECURSIVE {CRC_TABLE},
    o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
    a AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM o),
    p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
    x AS MATERIALIZED (SELECT doc_id, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
    g AS (SELECT doc_id, n, i, 1::BIGINT AS g, hash(x) AS x FROM x UNION ALL
        SELECT doc_id, n, i, 2 * g, hash(x, y) FROM (SELECT *, lead(x, g) OVER (PARTITION BY doc_id, g ORDER BY i) AS y FROM g) WHERE y IS NOT NULL AND g < {1 << levels} AND 2 * g <= n),
    e AS (SELECT doc_id, g, i, lead(i) OVER (PARTITION BY doc_id, g, x ORDER BY i) - i AS q FROM g),
    c AS (SELECT doc_id, g, i, q, i - row_number() OVER (PARTITION BY doc_id, g, q ORDER BY i) AS island FROM e WHERE q <= g AND 2 * q > g),
    r AS (SELECT doc_id, min(i) AS s, max(i) - min(i) + q + g AS m, q FROM c GROUP BY doc_id, g, q, island HAVING max(i) - min(i) + q + g >= greatest({LEAST_LENGTH}, {LEAST_TIMES} * q)),
    d AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
    k AS (SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN d ON d.doc_id = x.doc_id AND d.i = x.i GROUP BY x.doc_id),
    t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM r GROUP BY doc_id),
    b AS (SELECT y.doc_id, y.s, y.m, y.q FROM r y ANTI JOIN r z ON z.doc_id = y.doc_id AND (z.m * y.q > y.m * z.q OR z.m * y.q = y.m * z.q AND (z.s, z.q) < (y.s, y.q)))
    SELECT o.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, 1000 * b.m // b.q AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM o LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
