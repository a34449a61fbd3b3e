"""Importance resampling towards a target distribution, with overlap chunking of long texts.

Features are all runs of 1 to ``longest`` consecutive words, hashed into buckets. A bucket's gain is 1000 times the logarithm of how much more often the
target has it than the raw documents, with one added to every count; a document's weight is the floored mean gain of its features; Gumbel noise from its id is
added, and the documents with the highest sums are a sample in proportion to the weights, without replacement.

Texts above ``chunk_bytes`` are split at word boundaries into chunks that are dealt over all tasks. A chunk carries the ``longest - 1`` words that follow it and
owns the runs that start in it, so every run is counted once; chunk counts and sums of gains are added up by document. Shorter texts are counted where they
are read. Counts of a batch are added up before they are shuffled: at most a row for each bucket, and the gains (one for each of ``buckets``, a
parameter) are all that every task gets.

The draw needs no sort of all rows: scores are integers in a range that logarithms bound (some 100,000 values, whatever the input), so the rows of each score are counted,
the counts of higher scores give where its ranks begin, and only the rows of the scores that are drawn are numbered, score by score; rows that are equal throughout
are one row with a count in that.

Defined results: null, empty or wordless text: no features, weight 0, never drawn (unless ``least_words`` is 0). Null doc_id: noise of the empty id, after all others among ties. Very
long texts: whole, by chunks. Repeated rows: each is returned, with a rank of its own. Ties: the smaller doc_id. Empty documents or target: counts are 0, so
gains are as the formula gives them; no rows for no documents. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.llm.common import CRC_TABLE, crc32_sql, materialize

BUCKETS, CHUNK_BYTES, LEAST_WORDS, PERCENT, SEED = 10_000, 1 << 18, 20, 10, 2024
#: Words, of the bytes of a text: letters and digits of ASCII (small ones, after lowering) and all else above it.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Runs that are hashed at once.
PIECE = 1 << 20


def cut(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, own): chunks of about ``size`` bytes, cut between words, each with the ``carry`` words that follow; runs that start in the first ``own`` bytes are its own."""
    at = 0
    while at < len(text) or not at:
        end = min(len(text), at + size)
        if end < len(text) and (rest := WORD.match(text, end)):
            end = rest.end()
        more, last = WORD.finditer(text, end), end
        for _ in range(carry):
            last = m.end() if (m := next(more, None)) else last
        yield text[at:last], end - at
        at = end
        if not text:
            return


def features(chunk: bytes, own: int | None, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets of runs, words that start them), piece by piece, of the runs that start in the first ``own`` bytes."""
    if own is None or own >= len(chunk):
        words = WORD.findall(chunk)
        mine = len(words)
    else:
        words = WORD.findall(chunk, 0, own)
        mine = len(words)
        words += WORD.findall(chunk, own)
    for at in range(0, mine, PIECE):
        end = min(mine, at + PIECE)
        now = list(map(zlib.crc32, words[at:end]))
        crcs = [now]
        for k in range(1, longest):
            now = [zlib.crc32(b" " + w, c) for w, c in zip(words[at + k : end + k], now, strict=False)]
            crcs.append(now)
        yield np.array([c for x in crcs for c in x], np.int64) % buckets, end - at


def _lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def chunked(docs: DataFrame, longest: int, size: int) -> DataFrame:
    """doc_id, text_hash, chunk, text (lower case), own of the texts above ``size`` bytes, dealt over all tasks by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, text_hash, text in zip(b["doc_id"].astype("Int64"), b["text_hash"], b["text"], strict=True):
                for k, (chunk, own) in enumerate(cut(_lowered(text), size, longest - 1)):
                    out = pd.DataFrame({"doc_id": pd.array([None if doc_id is pd.NA else doc_id], "Int64"), "text_hash": [text_hash], "chunk": [k], "text": [chunk], "own": [own]})
                    yield out

    long = docs.where(F.octet_length("text") > size)
    return long.mapInPandas(run, "doc_id long, text_hash long, chunk long, text binary, own long").repartition("text_hash", "chunk")


def _own_chunk(docs: DataFrame, size: int) -> DataFrame:
    """The same columns for the texts that are one chunk."""
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= size)
    return short.select("doc_id", "text_hash", F.lit(0).cast("long").alias("chunk"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(None).cast("long").alias("own"))


def counts(chunks: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: features of all chunks, a row for each bucket and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = np.zeros(buckets, np.int64)
            for text, own in zip(b["text"], b["own"], strict=True):
                for found, _ in features(text.lower(), None if pd.isna(own) else int(own), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"bucket": some, "n": total[some]})

    return chunks.mapInPandas(run, "bucket long, n long")


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from (bucket, n) of both sides: as many rows as there are buckets."""
    both = raw.withColumn("side", F.lit("s")).unionByName(target.withColumn("side", F.lit("t")))
    found = both.groupBy("bucket").pivot("side", ["s", "t"]).agg(F.sum("n")).fillna(0)
    s, t = F.sum("s").over(Window.partitionBy()), F.sum("t").over(Window.partitionBy())  # of a row for each bucket
    every = found.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(found, "bucket", "left").fillna(0)
    ratio = (F.col("t") + 1).cast("double") * (s + buckets) / ((F.col("s") + 1).cast("double") * (t + buckets))
    rows = every.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], np.int64)


def weighed(chunks: DataFrame, gain: np.ndarray, longest: int, buckets: int) -> DataFrame:
    """doc_id, text_hash, chunk, n_words, n_features, sum of gains for each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), 3), np.int64)
            for k, (text, own) in enumerate(zip(b["text"], b["own"], strict=True)):
                for found, words in features(text.lower(), None if pd.isna(own) else int(own), longest, buckets):
                    out[k] += words, len(found), gain[found].sum()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_hash": b["text_hash"], "chunk": b["chunk"], "n_words": out[:, 0], "n_features": out[:, 1], "gains": out[:, 2]})

    return chunks.mapInPandas(run, "doc_id long, text_hash long, chunk long, n_words long, n_features long, gains long")


def noise(doc_id: Column, seed: int) -> Column:
    """Floored Gumbel noise (times 1000) from an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn: Column, take: int) -> DataFrame:
    """``scored`` with ``rank``: 1 .. ``take`` by descending score, ascending doc_id, of the rows where ``drawn``; else null. Scores are integers of a bounded range."""
    of_score = scored.where(drawn).groupBy("score").agg(F.count("*").alias("rows"))
    above = of_score.select(F.col("score").alias("at"), (F.sum("rows").over(Window.orderBy(F.desc("score"))) - F.col("rows")).alias("above"))  # a row for each score
    cuts = F.broadcast(above.where(F.col("above") < take))  # bounded as scores are
    rows = scored.join(cuts, drawn & (F.col("score") == F.col("at")), "left").drop("at")
    same = [c for c in scored.columns if c != "score"]
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), *same)
    groups = rows.where("above is not null").groupBy(*scored.columns, "above").agg(F.count("*").alias("copies")).withColumn("first", F.col("above") + F.sum("copies").over(order) - F.col("copies") + 1)
    each = groups.select(*scored.columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("rank"))
    return each.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).unionByName(rows.where("above is null").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row of ``docs``; rank is null for rows that are not drawn. ``target`` has a column text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    short, long = _own_chunk(rows, chunk_bytes), chunked(rows, longest, chunk_bytes)
    raw = counts(short, longest, buckets).unionByName(counts(long, longest, buckets))
    aim = counts(_own_chunk(goal, chunk_bytes), longest, buckets).unionByName(counts(chunked(goal, longest, chunk_bytes), longest, buckets))
    gain = gains(raw.groupBy("bucket").agg(F.sum("n").alias("n")), aim.groupBy("bucket").agg(F.sum("n").alias("n")), buckets)
    # chunks of rows that are equal are added up together: their sums are so many times those of one
    copies = F.count_if(F.col("chunk") == 0)
    one = [(F.sum(c) / copies).cast("long").alias(c) for c in ("n_words", "n_features")] + [F.expr("sum(gains) div count_if(chunk = 0)").alias("gains")]
    of_long = weighed(long, gain, longest, buckets).groupBy("doc_id", "text_hash").agg(*one, copies.alias("copies"))
    of_long = of_long.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    names = ["doc_id", "n_words", "n_features", "gains"]
    sums = weighed(short, gain, longest, buckets).select(*names).unionByName(of_long.select(*names))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gains - pmod(gains, n_features)) div n_features"))
    scored = sums.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("gains")
    scored = materialize(scored)
    drawn = F.col("n_words") >= least_words
    take = percent * scored.where(drawn).count() // 100
    return ranked(scored, drawn, take).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def oracle() -> str:
    """DuckDB SQL for doc_id, n_features, weight, score, rank, n_words with the parameters above and runs of one word."""
    words = lambda table, key: f"""SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"""
    return f"""WITH RECURSIVE {CRC_TABLE},
    w AS ({words("documents", "doc_id")}), v AS ({words("benchmark", "item_id")}),
    h AS (SELECT w, {crc32_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM w UNION SELECT w FROM v), crc),
    s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM v JOIN h USING (w) GROUP BY bucket),
    g AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
        FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    d AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gains FROM w JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
    e AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 0 ELSE (gains - ((gains % n) + n) % n) // n END::BIGINT AS weight,
        ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
    f AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM f WHERE n >= {LEAST_WORDS})
    SELECT doc_id, n AS n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN r END AS rank, n AS n_words FROM f LEFT JOIN r USING (doc_id)"""
