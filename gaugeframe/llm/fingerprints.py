"""Document fingerprints from prefix polynomial hashes.

``Prefix`` keeps sums c[j] * b**j (modulo two primes) of a text's code points, so any two spans are compared in constant
time, and the longest common extension of two places is found by binary search. A fingerprint is the
text's length and whole hash, and a sketch: the ``KEEP`` least mixed hashes of all spans of ``SPAN`` code
points. Likeness is 1 for equal texts, else the share of spans that two texts have in common (2 x common / all),
estimated from the sketches.

Documents are dealt into ranges of (doc_id, hash of the text); the first row of each range also goes to the range before it, so every row
meets its successor in its own task and the text crosses the network once. Bounds are quantiles of doc_id; an id that takes several quantiles, and null, is
split by the hash. A task holds two texts at a time, whatever the size of its range.

Defined results: null or empty text: empty, likeness 1 to another empty text and 0 to any other. A text shorter than a span is one span. Very long texts: whole.
Null doc_id: before all others. Repeated ids: by the hash of the text; equal rows follow each other. One row: its own successor. Empty table: no rows.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.llm.common import materialize, mixed, text_bytes

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, KEEP = 16, 128
#: Text in a range, and the most ranges: beyond 256 GB they grow, in time but not in memory.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 16

_POWERS: dict[int, list[np.ndarray]] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), and more, modulo prime."""
    have = _POWERS.setdefault(base, [np.ones(1, np.uint64)])
    while len(have[0]) < n:
        x = have[0]
        have[0] = np.concatenate([x, x * np.uint64(pow(base, len(x), prime)) % np.uint64(prime)])
    return have[0]


class Prefix:
    """Prefix hashes of a text."""

    def __init__(self, text: str):
        self._set(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), None, 0)

    def _set(self, codes: np.ndarray, head: Prefix | None, at: int) -> None:
        """Sums for the first ``at`` codes are those of ``head``."""
        self.n, self.codes, self.sums = len(codes), codes, []
        new = codes[at:].astype(np.uint64) + np.uint64(1)
        for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
            more = np.cumsum(new * powers(base, prime, self.n)[at : self.n] % np.uint64(prime))
            old = head.sums[k][: at + 1] if head else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([old, (more + old[-1]) % np.uint64(prime)]))

    def edited(self, keep: int, tail: Prefix, m: int) -> Prefix:
        """Of the text that follows the first ``keep`` codes with the first m of ``tail``."""
        out = Prefix.__new__(Prefix)
        out._set(np.concatenate([self.codes[:keep], tail.codes[:m]]), self, keep)
        return out

    def _hash(self, k: int, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        base, prime = BASES[k], np.uint64(PRIMES[k])
        inverse = powers(pow(base, -1, PRIMES[k]), PRIMES[k], self.n + 1)
        return (self.sums[k][j] + prime - self.sums[k][i]) % prime * inverse[i] % prime

    def span(self, i: int, j: int) -> int:
        """A 62-bit hash of codes i..j-1: equal for equal spans, wherever they are."""
        return int(self._hash(0, i, j)) << 31 | int(self._hash(1, i, j))

    def spans(self, first: int, last: int, length: int) -> np.ndarray:
        """Mixed 32-bit hashes of the spans that start at first..last-1."""
        i = slice(first, max(first, last))
        prime = np.uint64(PRIMES[0])
        inverse = powers(pow(BASES[0], -1, PRIMES[0]), PRIMES[0], self.n + 1)[i]
        x = (self.sums[0][first + length : first + length + len(inverse)] + prime - self.sums[0][i]) % prime * inverse % prime
        return mixed(x) >> np.uint64(32)


def same_span(x: Prefix, i: int, y: Prefix, j: int, length: int) -> bool:
    return i + length <= x.n and j + length <= y.n and x.span(i, i + length) == y.span(j, j + length)


def common_extension(x: Prefix, i: int, y: Prefix, j: int) -> int:
    """Length of the longest common prefix of x from i and y from j, by binary search."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same_span(x, i, y, j, mid) else (low, mid - 1)
    return low


def least_values(values: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` least distinct values."""
    if len(values) > 64 * keep:
        few = np.unique(values[values < np.uint64((1 << 32) * 8 * keep // len(values))])
        if len(few) >= keep:
            return few[:keep]
    return np.unique(values)[:keep]


class Fingerprint:
    def __init__(self, prefix: Prefix, hashes: np.ndarray):
        self.key = (prefix.n, prefix.span(0, prefix.n))
        self.sketch = least_values(hashes)

    def __str__(self) -> str:
        return f"{self.key[0]:x}:{self.key[1]:x}:" + "".join(f"{v:08x}" for v in self.sketch.tolist())


def likeness(x: Fingerprint, y: Fingerprint) -> float:
    if x.key == y.key:
        return 1.0
    both = np.union1d(x.sketch, y.sketch)[:KEEP]
    if not len(both):
        return 0.0
    common = int((np.isin(both, x.sketch) & np.isin(both, y.sketch)).sum())
    return 2 * common / (len(both) + common)


def span_hashes(p: Prefix) -> np.ndarray:
    length = min(SPAN, p.n)
    return p.spans(0, p.n - length + 1, length) if p.n else np.zeros(0, np.uint64)


def fingerprint(text: str | None) -> Fingerprint:
    p = Prefix(text or "")
    return Fingerprint(p, span_hashes(p))


def parse(text: str) -> Fingerprint:
    out = Fingerprint.__new__(Fingerprint)
    n, whole, sketch = text.split(":")
    out.key = (int(n, 16), int(whole, 16))
    out.sketch = np.array([int(sketch[k : k + 8], 16) for k in range(0, len(sketch), 8)], np.uint64)
    return out


def _row(doc_id: object, text: str, x: tuple, y: tuple) -> tuple:
    (p, h, f), (q, _, g) = x, y
    m = p.n // 4
    keep, m = p.n - m, min(m, q.n)
    e = p.edited(keep, q, m)
    length = min(SPAN, e.n)
    old = max(0, min(keep - length + 1, len(h))) if length == min(SPAN, p.n) else 0  # spans that end before the edit
    new = e.spans(old, e.n - length + 1, length) if e.n else h[:0]
    eh = np.concatenate([h[:old], new])
    ef = Fingerprint(e, eh)
    whole = e.codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return doc_id, p.n, hashlib.sha256(whole).hexdigest(), str(f), str(ef), likeness(f, ef), likeness(f, g), common_extension(p, 0, e, 0)


class Ranges:
    """Numbers the ranges of (doc_id, text_hash), nulls first, in ascending order."""

    def __init__(self, quantiles: list[float], nulls: int):
        self.nulls = nulls
        self.values, self.times = np.unique(np.array(quantiles, float), return_counts=True)
        self.hot = np.r_[self.times > 1, False]
        self.times = np.r_[self.times, 1]
        width = np.where(self.hot, 1 + self.times, 1)
        self.base = nulls + np.cumsum(width) - width

    def number(self, doc_id: pd.Series, text_hash: pd.Series) -> pd.Series:
        part = (text_hash.to_numpy(np.int64).astype(float) + 2.0**63) / 2.0**64  # where the hash lies, in [0, 1]
        d = doc_id.to_numpy(float, na_value=np.nan)
        i = np.searchsorted(self.values, d, "left")  # NaN: behind all
        same = self.hot[i] & (np.r_[self.values, np.nan][i] == d)
        out = self.base[i] + np.where(same, 1 + np.minimum(part * self.times[i], self.times[i] - 1).astype(np.int64), 0)
        return pd.Series(np.where(np.isnan(d), np.minimum(part * self.nulls, self.nulls - 1).astype(np.int64), out))


def ranges_of(rows: DataFrame, range_bytes: int) -> Ranges:
    n = min(MOST_RANGES, 1 + text_bytes(rows) // range_bytes)
    every, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    nulls = max(1, round(n * (every - known) / every)) if every > known else 0
    rest = max(1, n - nulls)
    return Ranges(rows.approxQuantile("doc_id", [k / rest for k in range(1, rest)], 0.1 / rest) if rest > 1 and known else [], nulls)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix (of text and edited text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ranges = ranges_of(rows, range_bytes)

    @F.pandas_udf("long")
    def number(doc_id: pd.Series, text_hash: pd.Series) -> pd.Series:
        return ranges.number(doc_id, text_hash)

    keys = rows.select("doc_id", "text_hash").withColumn("range", number("doc_id", "text_hash"))
    order = Window.orderBy("range")
    heads = keys.groupBy("range").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))  # a row for each range, about MOST_RANGES at most
    heads = materialize(heads.select("head", F.col("range").alias("of"), F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("before")))
    rows = rows.withColumn("range", number("doc_id", "text_hash")).join(F.broadcast(heads), F.col("range") == F.col("of"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    place = lambda r, copy: F.struct(F.col(r).alias("r"), F.lit(copy).alias("copy"))
    rows = rows.withColumn("place", F.explode(F.when(is_head, F.array(place("range", 0), place("before", 1))).otherwise(F.array(place("range", 0)))))
    rows = rows.select("place.r", "place.copy", "doc_id", "text_hash", "text")
    parts = max(1, len(ranges.base) + int(ranges.times[ranges.hot].sum()) + ranges.nulls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for r, copy, doc_id, text in zip(b["r"], b["copy"], b["doc_id"], b["text"], strict=True):
                if copy and (held is None or held[0] != r):
                    continue
                p = Prefix(text)
                h = span_hashes(p)
                now = (p, h, Fingerprint(p, h))
                if held is not None and held[0] == r:
                    out.append(_row(held[1], held[2], held[3], now))
                held = None if copy else (r, doc_id, text, now)
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return rows.repartitionByRange(parts, "r").sortWithinPartitions("r", "copy", "doc_id", "text_hash").mapInPandas(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
