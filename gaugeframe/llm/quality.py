"""Quality rules by n-gram perplexity, with a few counts beside it.

Character trigrams (code points, digits as one) of all words of all documents are counted by Spark for each language, each task adding up
its own first. From the counts DataFrame operations make a modified Kneser-Ney model: three discounts for each order, continuation
counts below the top, interpolated probabilities and the weights left to lower orders. A task holds them as
sorted arrays of hashed n-grams and looks words up by binary search. A word's probability is seven tenths its language's and three
tenths that of a model of all languages, so a foreign passage costs little. A document's perplexity is the words' whole cost for each letter
or digit: symbols cost and do not count, so random strings and symbol litter lie high, monotonous texts low. A language's bands lie
``BELOW`` and ``ABOVE`` interquartile ranges of the logarithm outside its quartiles; documents beyond them are rejected.

Every language has a model and bands of its own, however many there are, in any script. Models that take at most ``SHIP_BYTES`` are broadcast; beyond
that, documents are dealt by language (in parts of about ``PART_BYTES``) to tasks that hold the models of one language. Both ways give the same rows.

Defined results: null or empty text: no words, fails the base rules. Null language: a language of its own. Very long texts: whole, like any
other. Repeated rows: counted and judged each, with the same verdict. Empty table: no rows. Columns other than doc_id, lang and text are ignored, whatever their names; ``passing`` returns them all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import hashes, if_few, materialize, mixed, released, rolled

OWN = 0.7
BELOW, ABOVE = 6.0, 5.0
#: Bits of a code point in a packed n-gram; the uniform distribution below the lowest order is over all of them.
WIDE = 21
#: What a model of all languages is called; a language's own is its name behind OF.
ALL, OF = "*", "="
SHIP_BYTES, PART_BYTES = 128 << 20, 32 << 20
#: Distinct trigrams that a task gathers before it sends them.
GATHER = 2_000_000
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SCORES = f"doc_id long, lang string, text_hash long, {METRICS}, log_perplexity double"
ENTRIES = "model string, size int, context boolean, code long, value double"


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first code of each word) of the words' characters and ends (0), each after its two predecessors."""
    text = "\0\0" + "\0\0".join(w.decode("utf-8", "replace").lower().replace("\0", "\x01") for w in words) + "\0\0"
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s[(s > 48) & (s < 58)] = 48
    ends = np.flatnonzero((s[:-1] == 0) & (s[1:] == 0))  # each gap's first 0; the very first bounds no word
    code = (s[:-2] << 2 * WIDE) | (s[1:-1] << WIDE) | s[2:]  # of places 2, 3, ...
    keep = np.ones(len(s), bool)
    keep[ends + 1] = False  # the second 0 of a gap is given
    keep[:2] = False
    first = np.cumsum(keep)[ends[:-1] + 1]
    return code[keep[2:]], first


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """(model, code, n): trigrams of each language, and of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for b in released(batches):
            for k in range(0, len(b), 2000):
                for lang, texts in b.iloc[k : k + 2000].groupby("lang")["text"]:
                    count: Counter[bytes] = Counter()
                    for t in texts:
                        count.update(t.encode("utf-8", "surrogatepass").lower().split())
                    if count:
                        code, first = trigrams(list(count))
                        n = np.repeat(np.fromiter(count.values(), np.int64), np.diff(np.r_[first, len(code)]))
                        held[lang] = [_summed([*held.get(lang, []), (code, n)])]
                if sum(len(p[0][0]) for p in held.values()) > GATHER:
                    yield from sent(held)
                    held = {}
        yield from sent(held)

    def sent(held: dict[str, list]) -> Iterator[pd.DataFrame]:
        for lang, ((code, n),) in held.items():
            yield pd.DataFrame({"model": OF + lang, "code": code, "n": n})

    own = rows.select("lang", "text").mapInPandas(run, "model string, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))
    return own.unionByName(own.groupBy("code").agg(F.sum("n").alias("n")).withColumn("model", F.lit(ALL)))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """ENTRIES of modified Kneser-Ney models of trigram counts (model, code, n): probabilities of n-grams of ``size`` characters, and of contexts
    of n-grams of that size the weight left to the next lower order. A part of a model crosses the network for each order; nothing gathers a model."""
    last = lambda k: F.col("code").bitwiseAND((1 << WIDE * k) - 1)
    grams = {3: counts}
    for size in (2, 1):
        grams[size] = grams[size + 1].select("model", last(size).alias("code")).groupBy("model", "code").agg(F.count("*").alias("n"))
    out, lower = [], None
    for size in (1, 2, 3):
        rows = grams[size].withColumn("context", F.shiftright("code", WIDE) if size > 1 else F.lit(0).cast("long"))
        seen = [F.greatest(F.lit(1), F.count_if(F.col("n") == k)).cast("double").alias(f"n{k}") for k in range(1, 5)]
        cuts = if_few(rows.groupBy("model").agg(*seen))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def cut(k: int, y: Column = y) -> Column:
            return F.least(F.lit(k - 0.05), F.greatest(F.lit(0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))

        rows = rows.join(cuts, "model").withColumn("less", F.when(F.col("n") == 1, cut(1)).when(F.col("n") == 2, cut(2)).otherwise(cut(3))).select("model", "code", "context", "n", "less")
        rows = materialize(rows)
        contexts = materialize(rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("rest")))
        rows = rows.join(contexts, ["model", "context"])
        if lower is None:
            below = F.lit(1 / (1 << WIDE))
        else:
            rows = rows.withColumn("end", last(size - 1)).join(lower.select("model", F.col("code").alias("end"), F.col("value").alias("below")), ["model", "end"])
            below = F.col("below")
        lower = materialize(rows.select("model", "code", ((F.col("n") - F.col("less")) / F.col("total") + F.col("rest") * below).alias("value")))
        out.append(lower.select("model", F.lit(size).alias("size"), F.lit(False).alias("context"), "code", "value"))
        out.append(contexts.select("model", F.lit(size).alias("size"), F.lit(True).alias("context"), F.col("context").alias("code"), F.col("rest").alias("value")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4]).unionByName(out[5])


def _hashed(code: np.ndarray) -> np.ndarray:
    return mixed(code.astype(np.uint64))


class Model:
    """A model's entries as sorted arrays of hashed n-grams (the hash is one to one), one for each size, and of contexts."""

    def __init__(self, entries: pd.DataFrame):
        self.tables = {}
        for at, part in entries.groupby(["size", "context"]):
            h = _hashed(part["code"].to_numpy())
            order = np.argsort(h)
            self.tables[at] = (h[order], part["value"].to_numpy()[order])

    def _find(self, size: int, context: bool, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = self.tables[size, context]
        h = _hashed(code)
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return known[i] == h, value[i]

    def probability(self, code: np.ndarray, size: int = 3) -> np.ndarray:
        found, out = self._find(size, False, code)
        rest = np.flatnonzero(~found)
        if len(rest):
            c = code[rest]
            some, weight = self._find(size, True, c >> WIDE if size > 1 else c * 0)
            below = self.probability(c & ((1 << WIDE * (size - 1)) - 1), size - 1) if size > 1 else 1 / (1 << WIDE)
            out = out.copy()
            out[rest] = np.where(some, weight, 1.0) * below
        return out


def models_of(entries: pd.DataFrame) -> dict[str, Model]:
    return {name: Model(part) for name, part in entries.groupby("model")}


def word_logs(own: Model, all_: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(log probability, letters and digits) of each word with its end."""
    code, first = trigrams(words)
    distinct, at = np.unique(code, return_inverse=True)
    each = [np.add.reduceat(np.log(m.probability(distinct))[at], first) for m in (own, all_)]
    last, which = np.unique(distinct & ((1 << WIDE) - 1), return_inverse=True)
    letter = np.array([chr(c).isalnum() if c < 0x110000 else False for c in last.tolist()])
    return np.logaddexp(each[0] + np.log(OWN), each[1] + np.log(1 - OWN)), np.add.reduceat(letter[which][at].astype(np.int64), first)


def _repeated(h: np.ndarray, length: int = 8) -> int:
    """Words in windows of ``length`` words that come twice or more."""
    r = rolled(h, length)
    order = np.argsort(r, kind="stable")
    twin = r[order[1:]] == r[order[:-1]]
    if not twin.any():
        return 0
    at = np.unique(np.concatenate([order[1:][twin], order[:-1][twin]]))
    mask = np.zeros(len(h) + 1, np.int64)
    mask[at] += 1
    np.subtract.at(mask, at + length, 1)
    return int((np.cumsum(mask[:-1]) > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int, bool]:
    """METRICS of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    split = raw.split()
    seen: set[bytes] = set()
    twins = 0
    for x in raw.split(b"\n"):
        if x in seen:
            twins += 1
        elif x.strip():
            seen.add(x)
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
    again = _repeated(hashes(split)) if len(split) > 8 else 0
    return len(split), chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")), twins, again, len(split) < 20 or 100 * again > 30 * len(split)


def scored(part: pd.DataFrame, models: dict[str, Model]) -> pd.DataFrame:
    """SCORES of some rows (doc_id, lang, text_hash, text). Nothing stays in the worker but the models."""
    cost = np.full(len(part), np.nan)
    for lang, rows in part.reset_index(drop=True).groupby("lang"):
        at: dict[bytes, int] = {}
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in rows["text"]]
        ids = [np.fromiter((at.setdefault(w, len(at)) for w in x), np.int64, len(x)) for x in split]
        if at:
            logs, letters = word_logs(models[OF + lang], models[ALL], list(at))
            cost[rows.index] = [-logs[i].sum() / max(1, letters[i].sum()) if len(i) else np.nan for i in ids]
    out = pd.DataFrame([counts_of(t) for t in part["text"]], columns=[c.split()[0] for c in METRICS.split(", ")])
    for k, c in enumerate(("doc_id", "lang", "text_hash")):
        out.insert(k, c, part[c].array)
    return out.assign(log_perplexity=pd.Series(cost).astype(object).where(~np.isnan(cost), None).astype("Float64"))


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _in_parts(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    return lambda batches: (run(b.iloc[k : k + 500]) for b in released(batches) for k in range(0, len(b), 500))


def measured(docs: DataFrame, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """doc_id, lang, text_hash, the METRICS and log_perplexity (null without words)."""
    rows = _rows(docs)
    entries = kneser_ney(materialize(counted(rows)))
    if 16 * entries.count() <= ship_bytes:
        shipped = docs.sparkSession.sparkContext.broadcast(models_of(entries.toPandas()))
        return rows.mapInPandas(_in_parts(lambda part: scored(part, shipped.value)), SCORES)

    parts = rows.groupBy("lang").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / PART_BYTES).cast("int").alias("parts"))
    parts = materialize(parts.select(F.col("lang").alias("of"), "parts"))
    dealt = rows.join(if_few(parts), F.col("lang") == F.col("of")).drop("of").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")).cast("int"))
    places = parts.select("of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("place"))
    own = entries.where(F.col("model") != ALL).join(places, F.col("model") == F.concat(F.lit(OF), F.col("of")))
    held = own.unionByName(entries.where(F.col("model") == ALL).crossJoin(places))  # a copy for each task: one row of ``places`` is a task

    def run(key: tuple, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([scored(part.iloc[k : k + 500], models_of(model)) for k in range(0, len(part), 500)]) if len(part) else pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    return dealt.groupBy("lang", "part").cogroup(held.groupBy("of", "place")).applyInPandas(run, SCORES)


def judged(docs: DataFrame, below: float = BELOW, above: float = ABOVE, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """doc_id, text_hash, lang, the METRICS, perplexity, lower, upper (the language's bands) and kept."""
    rows = materialize(measured(docs, ship_bytes))
    quartiles = rows.where("not base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10000).alias("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    reach = F.greatest(high - low, F.lit(0.02))
    bands = quartiles.select(F.col("lang"), (low - below * reach).alias("lower"), (high + above * reach).alias("upper"))
    out = rows.join(if_few(materialize(bands)), "lang", "left")  # a row for each language
    good = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    names = [c.split()[0] for c in METRICS.split(", ")]
    return out.select("doc_id", "text_hash", "lang", *names, F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), F.coalesce(good, F.lit(False)).alias("kept"))


def passing(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    kept = judged(docs, below, above).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (text_hash == kept["__hash"]), "left_semi")
