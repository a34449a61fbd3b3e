"""Re-Pair compressed token files.

Documents are dealt by ranges of doc_id and cut into shards of about ``SHARD`` ids. In each shard the most frequent
pairs of neighbouring symbols are replaced by nonterminals, again and again, until no pair comes ``LEAST`` times. A round replaces all pairs that
are at least a quarter as frequent as the first, the more frequent one where two overlap. A shard's file part stores the rules, the length that each
nonterminal expands to, and what is left of the sequence, so any range of ids can be decoded on its own (``decode_range``).

A rule takes three numbers and each use of it saves one, so a pair that comes less than ``LEAST`` times would lengthen the file.

A shard is one row of a Parquet table (written by Spark, so a lost task leaves nothing behind, and any store will
do) with ``blob`` in this layout, little-endian: ``MAGIC``; six 32-bit counts (documents, ids, rules, symbols, the first nonterminal, bytes of a symbol); documents' ids (64 bit), a
byte for each that is 1 where the id is null, documents' lengths (32 bit), rules (two symbols each), expansion lengths (32 bit), symbols.
A symbol has 2, 3 or 4 bytes, as the largest asks for. Symbols below the first nonterminal are token ids, the others rules. Ids may be as large as 2**31.

Defined results: null or empty text: the end id alone. Null doc_id: before all others. Repeated ids: ordered by the hash of their text; equal rows each have their place. Very long
texts: whole, in one shard. Empty table: a file without rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.llm.common import text_bytes
from gaugeframe.llm.tokens import WORD_BPE, encoder, in_batches

END, SHARD, LEAST = 2, 1 << 18, 4
#: A round takes pairs down to this part of the first one's count.
SHARE = 4
#: Text of a task that writes shards.
PART_BYTES = 8 << 20
MAGIC = b"GFRP0002"
SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, blob binary"


CELLS = 1 << 17
#: Cells of places where no pair begins: behind an end, and those whose pair comes too rarely.
BEHIND, RARE = CELLS, CELLS + 1


def _cells(a: np.ndarray, at: np.ndarray | slice, end: int) -> np.ndarray:
    """Hashed cells of the pairs at some places; BEHIND an end no pair begins."""
    left = a[:-1][at]
    cell = ((left * np.uint32(0x9E3779B1) ^ (a[1:][at] * np.uint32(0x9E3779B1) >> np.uint32(7))) * np.uint32(0x85EBCA77) >> np.uint32(15)).astype(np.int64)
    cell[left == end] = BEHIND
    return cell


def _frequent(a: np.ndarray, n: int, cell: np.ndarray, bound: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pairs' ranks): where the pairs at least a ``1 / SHARE`` as frequent as the most frequent one stand; rank 0 is the most frequent.

    Pairs are counted exactly, but only where hashed cells, whose counts (``bound``) bound theirs from above, leave a chance. Of a run of equal symbols
    every other pair counts. A pair's newest symbol came into being in one round, so a pair never comes more often than now: one found too rare is RARE for good.
    """
    need = max(least, int(bound.max()) // SHARE)
    bits, low = n.bit_length(), len(a).bit_length()
    while True:
        at = np.flatnonzero((bound >= need).take(cell, mode="clip"))
        left, right = a.take(at), a.take(at + 1)
        twin = np.flatnonzero(left == right)
        if len(twin) > 1:
            begin = np.flatnonzero(np.diff(at[twin], prepend=-2) != 1)
            twin = twin[(np.arange(len(twin)) - np.repeat(begin, np.diff(begin, append=len(twin)))) % 2 == 1]
            at, left, right = np.delete(at, twin), np.delete(left, twin), np.delete(right, twin)
        key = left.astype(np.int64)
        if 2 * bits + low < 64:
            key <<= bits
            key |= right
        else:
            key = np.unique(key << 32 | right, return_inverse=True)[1]
        key <<= low
        key |= at
        key.sort()
        pair = key >> low
        head = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        count = np.diff(head, prepend=0, append=len(key)) if len(key) else head
        top = int(count.max(initial=0))
        if top >= need or need == least:
            break
        need = max(least, top)
    at = key & ((1 << low) - 1)
    rare = at[np.repeat(count < least, count)]
    rare = rare[a.take(rare) != a.take(rare + 1)]  # a run of equal symbols may count otherwise later on
    np.subtract.at(bound, cell[rare], 1)
    cell[rare] = RARE
    if need == least:
        less = bound < least
        less[BEHIND:] = False
        cell[less.take(cell, mode="clip")] = RARE
    pick = np.flatnonzero(count >= max(need, -(-top // SHARE)))
    pick = pick[np.argsort(-count[pick], kind="stable")]
    begin, size = (np.cumsum(count) - count)[pick], count[pick]
    rank = np.repeat(np.arange(len(pick)), size)
    key = at.take(np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(rank))) << 32 | rank
    key.sort()
    return key >> 32, key & 0xFFFFFFFF


def replace_pairs(ids: np.ndarray, end: int = END, least: int = LEAST, first: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first nonterminal): pairs replaced, the most frequent first, until none comes ``least`` times; no rule goes on behind an end.

    Symbols between rare pairs alone are set aside once they are most of the sequence: a new pair with one of them would be as rare.
    """
    first = int(ids.max(initial=end)) + 1 if first is None else first
    if len(ids) and int(ids.max()) >= first:
        raise ValueError(f"ids must be below {first}")
    a, rules, n = ids.astype(np.uint32), [], first
    cell = _cells(a, slice(None), end)
    bound = np.bincount(cell, minlength=CELLS + 2)
    aside: list[tuple[np.ndarray, ...]] = []  # sequences, the places of what went on, and where they stood themselves
    place = np.zeros(0, np.int64)
    spare, spare_cell = np.empty_like(a), np.empty_like(cell)  # what stays is copied from one to the other
    while len(a) > 1:
        bound[CELLS:] = 0
        at, rank = _frequent(a, n, cell, bound, least)
        if not len(at):
            break
        over = np.flatnonzero(at[1:] - at[:-1] == 1)
        best = np.ones(len(at), bool)
        best[over + (rank[over] < rank[over + 1])] = False
        good = np.bincount(rank[best]) >= least
        best &= good.take(rank, mode="clip")
        at, rank = at[best], (np.cumsum(good) - 1).take(rank[best])  # never empty: the first keeps all its places
        one = np.zeros(np.count_nonzero(good), np.int64)
        one[rank] = at  # a place of each pair
        rules.append(np.stack([a[one], a[one + 1]], axis=1))
        apart = (np.diff(at, prepend=-3) != 2) & (at > 0)  # no other pair ends just before
        right, left = cell.take(at + 1, mode="clip"), cell.take(at - 1, mode="clip")
        inside = at + 1 < len(cell)
        np.subtract.at(bound, np.concatenate([cell[at], right[inside], left[apart]]), 1)
        a[at] = n + rank
        now = at - np.arange(len(at))  # where the new symbols will be
        stay = np.ones(len(a) - len(at), np.int64)
        stay[0], stay[now[now < len(stay) - 1] + 1] = 0, 2
        np.cumsum(stay, out=stay)
        a, spare = a.take(stay, out=spare[: len(stay)], mode="clip"), a
        cell, spare_cell = cell.take(stay[:-1], out=spare_cell[: len(stay) - 1], mode="clip"), cell
        cell[now[inside]] = RARE
        near = np.concatenate([now[inside & (right != RARE)], now[apart & (left != RARE)] - 1])
        cell[near] = _cells(a, near, end)
        np.add.at(bound, cell[near], 1)
        n += len(one)
        if aside:
            place = place.take(stay)
        if 2 * np.count_nonzero(some := cell != RARE) < len(a):
            some = np.flatnonzero(np.r_[some, False] | np.r_[False, some])
            aside.append((a, some, place))
            a, cell, place = a.take(some), cell.take(some[:-1]), np.arange(len(some))
            spare, spare_cell = np.empty_like(a), np.empty_like(cell)
    while aside:
        whole, some, before = aside.pop()
        keep = np.ones(len(whole), bool)
        keep[some] = False
        keep[some[place]] = True
        whole[some[place]] = a
        a, place = whole[keep], before[keep] if aside else before
    return a, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


def sizes(rules: np.ndarray, first: int) -> np.ndarray:
    """The number of ids that each rule expands to."""
    n: list[int] = []
    for x, y in rules.tolist():
        n.append((n[x - first] if x >= first else 1) + (n[y - first] if y >= first else 1))
    return np.array(n, np.uint32)


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(symbols.reshape(-1).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4").reshape(-1)


def to_blob(doc_ids: list[int | None], lengths: list[int], ids: bytes, first: int | None = None) -> bytes:
    symbols, rules, first = replace_pairs(np.frombuffer(ids, "<u4"), first=first)
    width = max(2, -(-int(first + len(rules)).bit_length() // 8))
    head = struct.pack("<6I", len(doc_ids), len(ids) // 4, len(rules), len(symbols), first, width)
    null = np.array([d is None for d in doc_ids], np.uint8)
    number = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [number.tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(), _narrow(rules, width), sizes(rules, first).astype("<u4").tobytes(), _narrow(symbols, width)]
    return MAGIC + head + b"".join(parts)


@functools.lru_cache(maxsize=2)
def _terminals(first: int) -> list[bytes]:
    return [k.to_bytes(4, "little") for k in range(first)]


class Shard:
    """A shard's file part, opened."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, self.n, rules, symbols, self.first, width = struct.unpack_from("<6I", blob, 8)
        at = 32

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return blob[at - size : at]

        number, null = np.frombuffer(take(8 * docs), "<i8"), np.frombuffer(take(docs), "u1")
        self.doc_ids = [None if x else d for d, x in zip(number.tolist(), null.tolist(), strict=True)]
        self.lengths = np.frombuffer(take(4 * docs), "<u4").astype(np.int64)
        self.rules = _wide(take(2 * rules * width), width).reshape(-1, 2)
        self.expands = np.frombuffer(take(4 * rules), "<u4")
        self.symbols = _wide(take(symbols * width), width)
        if self.first <= 1 << 17:
            words = list(_terminals(self.first))
            for x, y in self.rules.tolist():
                words.append(words[x] + words[y])
            self.used, plain = None, np.arange(self.first, dtype="<u4")
        else:  # terminals that occur, renumbered
            self.used = np.unique(np.concatenate([x[x < self.first] for x in (self.symbols, self.rules.reshape(-1))]))
            words, plain = [int(k).to_bytes(4, "little") for k in self.used], self.used.astype("<u4")
            for x, y in zip(self._place(self.rules[:, 0]).tolist(), self._place(self.rules[:, 1]).tolist(), strict=True):
                words.append(words[x] + words[y])
        self.words = np.concatenate([plain, np.frombuffer(b"".join(words[len(plain) :]), "<u4")])  # what each symbol stands for, one after the other
        self.width = np.r_[np.ones(len(words) - rules, np.int64), self.expands.astype(np.int64)]
        self.where = np.cumsum(self.width) - self.width
        self.symbols = self._place(self.symbols)

    def _place(self, symbols: np.ndarray) -> np.ndarray:
        """Where a symbol stands in ``words``."""
        if self.used is None:
            return symbols
        return np.where(symbols < self.first, np.searchsorted(self.used, symbols), len(self.used) + symbols.astype(np.int64) - self.first)

    def _expand(self, symbols: np.ndarray) -> bytes:
        width = self.width[symbols]
        stop = np.cumsum(width)
        shift = np.repeat(self.where[symbols] - stop + width, width)
        shift += np.arange(len(shift))
        return self.words.take(shift, mode="clip").tobytes()

    def decode(self) -> bytes:
        return self._expand(self.symbols)

    def decode_range(self, begin: int, end: int) -> bytes:
        """Ids begin..end-1, from the symbols that cover them alone."""
        stop = np.cumsum(self.width[self.symbols])
        first, last = np.searchsorted(stop, begin, "right"), np.searchsorted(stop, end, "left")
        skip = begin - int(stop[first - 1] if first else 0)
        raw = self._expand(self.symbols[first : last + 1])
        return raw[4 * skip : 4 * (skip + end - begin)]


def shards(docs: DataFrame, path: str = WORD_BPE, end: int = END, partitions: int | None = None) -> DataFrame:
    """The rows of a token table (SHARD_SCHEMA) in ascending order of doc_id: by ``part``, then ``shard``."""
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, encode, first = TaskContext.get().partitionId(), 0, encoder(path).encode, encoder(path).tokenizer.get_vocab_size()
        doc_ids, lengths, held, size = [], [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(doc_ids)], "n_tokens": [size], "blob": [to_blob(doc_ids, lengths, b"".join(held), max(first, end + 1))]})

        for b in batches:
            texts = b["text"].tolist()
            for part_ in in_batches(texts):
                for doc_id, ids in zip(b["doc_id"].iloc[part_], encode(texts[part_]), strict=True):
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    held += [ids, tail]
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= SHARD:
                        yield row()
                        doc_ids, lengths, held, size, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    n = partitions or 1 + text_bytes(rows) // PART_BYTES
    return rows.repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash").mapInPandas(run, SHARD_SCHEMA)


def write_tokens(docs: DataFrame, to: str, path: str = WORD_BPE, end: int = END) -> None:
    shards(docs, path, end).write.parquet(to)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (if asked for) of a token table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, blob in zip(b["base"], b["blob"], strict=True):
                s = Shard(blob)
                ids, stop = s.decode(), np.cumsum(s.lengths)
                each = [ids[4 * (y - n) : 4 * y] for y, n in zip(stop.tolist(), s.lengths.tolist(), strict=True)]
                out = {"doc_id": pd.array(s.doc_ids, "Int64"), "start": base + stop - s.lengths, "n_tokens": s.lengths, "ids_crc32": [zlib.crc32(x) for x in each]}
                yield pd.DataFrame(out | ({"ids": each} if with_ids else {}))

    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    counts = table.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row for each task that wrote
    parts = parts.select("part", before(Window.orderBy("part")).alias("of_part"))
    base = counts.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("of_shard"))
    base = base.join(parts, "part").select("part", "shard", (F.col("of_part") + F.col("of_shard")).alias("base"))
    rows = table.join(base, ["part", "shard"]).select("base", "blob")
    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
