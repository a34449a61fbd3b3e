"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of the window's length and then, for the rest, into one piece for each bit of its length, longest
first. Each piece is a sequence of its own: no sequence crosses documents, none needs padding, and
sequences of one length form a bucket from which batches of equal shape are drawn. No row is
shuffled: a document is packed where it is read.

Defined results: null or empty text: the end id alone. Null doc_id and repeated rows are packed like any other row, each on its own. Very long
texts: whole, as many windows as they fill. Empty table: no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import released
from gaugeframe.llm.tokens import WORD_BPE, encoder, in_batches

END = 2


def lengths(n: int, window: int) -> list[int]:
    """Piece lengths of n ids: whole windows, then the powers of two in the rest; ``window`` is a power of two."""
    rest = n % window
    return [window] * (n // window) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, path: str = WORD_BPE, window: int = 4096, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids (little-endian 32-bit, if asked for).

    ``sequence_id`` is unique; sequences of one ``bucket`` have 2**bucket ids. Cached ids: see tokens.Encoder.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 33
        encode = encoder(path).encode
        for b in released(batches):
            for at in in_batches(b["text"].tolist()):
                part, rows = b.iloc[at], []
                for doc_id, ids in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids += tail
                    start, n = 0, len(ids) // 4
                    for k in lengths(n, window):
                        piece = ids[4 * start : 4 * (start + k)]
                        rows.append((doc_id, start, k, zlib.crc32(piece), n, sequence, 0, k.bit_length() - 1, *([piece] if with_ids else [])))
                        start += k
                        sequence += 1
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, schema)


def write_buckets(packed: DataFrame, path: str, part_bytes: int = 64 << 20) -> None:
    """Writes the pieces (with ids) with one folder for each bucket, dealt so that a file has about ``part_bytes``: batches of equal shape are read
    from one folder. The lengths are counted first; a bucket is split over as many tasks as its bytes ask for."""
    parts = packed.groupBy("bucket").agg(F.ceil(F.sum("length") * 4 / part_bytes).cast("int").alias("_parts"))
    dealt = packed.join(F.broadcast(parts), "bucket").withColumn("_part", F.pmod(F.xxhash64("sequence_id"), F.col("_parts")))  # one row for each power of two
    dealt.repartition("bucket", "_part").drop("_parts", "_part").write.partitionBy("bucket").parquet(path)
