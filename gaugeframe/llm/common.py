"""What the training-data operators share: the shared folder, blocks of documents, words, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gaugeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables written and not yet deleted: path by the id of the frame that reads it, and the session.
_TABLES: dict[int, tuple[str, DataFrame]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (path, out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that ``materialize`` returned, once nothing reads it any more."""
    path, _ = _TABLES.pop(id(df), ("", None))
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def discard_all() -> None:
    """Deletes what is left when the driver ends."""
    for _, df in list(_TABLES.values()):
        try:
            discard(df)
        except Exception:  # noqa: BLE001, the session is gone: so is the way to the folder
            _TABLES.clear()
            return


#: Rows up to which a table that was counted is broadcast.
FEW = 200_000


def if_few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count finds at most FEW rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def with_block(docs: DataFrame, block_bytes: int, total: int | None = None) -> DataFrame:
    """Adds ``block``: rows dealt by a hash into blocks of about ``block_bytes`` of text, whatever their source or length."""
    n = max(1, -(-(text_bytes(docs) if total is None else total) // block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def released(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a task; before each one, and at the end, Arrow gives back what it holds unused of earlier ones, as a worker outlives its task and
    stays beside those of later stages."""
    pool = pa.default_memory_pool()
    for b in batches:
        pool.release_unused()
        yield b
    pool.release_unused()


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``: what bytes.split() takes as words."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered(text: str | None) -> list[bytes]:
    """The same with A-Z (and nothing else) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    """A fixed 64-bit hash of each token."""
    if not tokens:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multiplier of the rolling hashes.
BASE = 0x9E3779B97F4A7C15


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all k consecutive values of ``h``, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out, have, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[have:]
            if out is None:
                out = part[:n]
            else:
                out = out * np.uint64(pow(BASE, width, 1 << 64)) + part[:n]
            have += width
        width *= 2
        if width > k:
            return mixed(out)
        power = power[: len(power) - width // 2] * np.uint64(pow(BASE, width // 2, 1 << 64)) + power[width // 2 :]


#: For DuckDB: crc, a row with the 256 remainders of CRC-32, in a WITH RECURSIVE.
CRC_TABLE = """crc_step AS (SELECT i::BIGINT AS b, i::BIGINT AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END, k + 1 FROM crc_step WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM crc_step WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, where its one row ``crc`` is joined."""
    each = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda j: ('0x' || substr(hex(encode({text})), 2 * j - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({each}, lambda c, y: xor(c >> 8, crc.t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT))"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Alternating large and small stars; each round is written to the shared folder, and ends up in
    one star per component. Nulls and loops are left out.
    """
    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = materialize(df)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, seen = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        before, last = seen, now
        now, seen = kept(small.distinct())
        discard(last)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
    discard(now)
    return out


def _joined(pairs: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """Which of the links join two components, and a step towards the least member for every other one."""
    parent: dict[int, int] = {}
    kept = []
    for k, (a, b) in enumerate(pairs.tolist()):
        x, y = _top(parent, a), _top(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept, parent


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = up = parent.get(up, up)
        x = up
    return x


def forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the links ``pairs`` (n x 2 small integers): the same components by fewer links."""
    return pairs[_joined(pairs)[0]]


def stars(pairs: np.ndarray) -> np.ndarray:
    """(member, least member) for every other member of the components of the links: equal components give equal rows, whatever their links."""
    _, parent = _joined(pairs)
    return np.array([(x, _top(parent, x)) for x in list(parent)], np.int64).reshape(-1, 2)
