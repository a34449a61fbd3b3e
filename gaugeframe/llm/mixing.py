"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of (source, lang, topic). Starting from their tokens, the cells' weights are raked to each margin in
turn, again and again, until every margin has its target share. A cell's calibrated probability is its weight over its tokens, scaled
so that the largest is 1: nothing is taken twice. A document is sampled where a uniform number hashed from its
doc_id is below its cell's probability, so runs agree, and a hot source is thinned in place without moving.

``topic`` is what the text looks like, unless the documents have a column of that name. A target defaults to the margin's share
to the power ``SMOOTHING``. Cells are aggregated before any shuffle. Up to ``TOGETHER`` of them, counted first, are raked in one partition without further
shuffles; beyond that a round adds the weights up by each margin and joins the sums back, so no task holds all cells of a hot value. The weights are the same
either way. ``residuals`` tells how far the margins still are from their targets.

Defined results: nulls in a margin are a value of their own; null or empty text: no tokens, and where a whole cell has none, probability 1. Null doc_id: hashed by
its text. Repeated rows get the same decision. Very long texts count whole. Empty table: no rows. ``mixed`` replaces columns named topic (unless there is one), n_tokens,
probability and sampled; ``sampled`` returns the columns of ``docs`` as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeframe.llm.common import discard, if_few, materialize

MARGINS = ("source", "lang", "topic")
ROUNDS, SMOOTHING = 10, 0.9
#: Cells up to which, after a count, one partition holds them all and raking needs no shuffle.
TOGETHER = 100_000


def topic_of(text: Column) -> Column:
    """What a text looks like: table, links, license, or prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("://")), "links").when(F.contains(text, F.lit("opyright")), "license").otherwise("prose")
    )


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text))))
    out = out.withColumn("__u", F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48))
    return out.withColumn("__topic", F.col("topic") if "topic" in docs.columns else topic_of(text))


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None, total: float, smoothing: float) -> DataFrame:
    """(_value, _target): the share that each value of a margin shall have."""
    value = F.col(margin).alias("_value")
    if given is not None:
        known = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        return cells.select(value).distinct().withColumn("_target", F.coalesce(known[F.col("_value")], F.lit(0.0)))
    shares = cells.groupBy(value).agg(F.pow(F.sum("tokens") / total, F.lit(smoothing)).alias("_share"))
    every = shares.agg(F.sum("_share")).scalar()
    return shares.select("_value", (F.col("_share") / every).alias("_target"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> DataFrame:
    """Cells (margins, tokens > 0) with ``weight``; the weights add up to 1. ``targets``: shares by margin and value; values without one share nothing."""
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    goals = {m: _targets(cells, m, (targets or {}).get(m), total, smoothing) for m in MARGINS}
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    if cells.count() <= TOGETHER:
        for m in MARGINS:
            out = out.join(F.broadcast(goals[m].withColumnsRenamed({"_value": f"_v_{m}", "_target": f"_t_{m}"})), F.col(m).eqNullSafe(F.col(f"_v_{m}")))
        out = out.coalesce(1)
        for m in MARGINS * rounds:
            out = out.withColumn("weight", _aimed(F.col(f"_t_{m}"), F.sum("weight").over(Window.partitionBy(m))))
        return out.select(*MARGINS, "tokens", "weight")
    goals = {m: if_few(materialize(goal)) for m, goal in goals.items()}
    for _ in range(rounds):
        before = out
        for m in MARGINS:
            sums = out.groupBy(F.col(m).alias("_m")).agg(F.sum("weight").alias("_sum")).join(goals[m], F.col("_m").eqNullSafe(F.col("_value")))
            out = out.join(sums, F.col(m).eqNullSafe(F.col("_m"))).withColumn("weight", _aimed(F.col("_target"), F.col("_sum"))).select(*MARGINS, "tokens", "weight")
        out = materialize(out)
        discard(before)
    return out


def _aimed(target: Column, reached: Column) -> Column:
    return F.coalesce(F.try_divide(F.col("weight") * target, reached), F.lit(0.0))


def residuals(weights: DataFrame, targets: dict[str, dict[str, float]] | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """margin, value, target, share: what raking aimed at and what it reached, for every value of every margin."""
    total = weights.agg(F.sum("tokens").cast("double")).scalar()
    parts = []
    for m in MARGINS:
        goal = _targets(weights, m, (targets or {}).get(m), total, smoothing)
        share = weights.groupBy(F.col(m).alias("value")).agg(F.sum("weight").alias("share"))
        parts.append(share.join(goal, F.col("value").eqNullSafe(F.col("_value"))).select(F.lit(m).alias("margin"), F.col("value").cast("string").alias("value"), F.col("_target").alias("target"), "share"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _decided(docs: DataFrame, targets: dict[str, dict[str, float]] | None, rounds: int, smoothing: float) -> DataFrame:
    """``docs`` with __topic, __tokens, __chance and __u, the number that decides."""
    rows = _prepared(docs)
    names = {m: "__topic" if m == "topic" else m for m in MARGINS}
    cells = materialize(rows.groupBy(*[F.col(n).alias(m) for m, n in names.items()]).agg(F.sum("__tokens").alias("tokens")))
    weights = materialize(raked(cells.where("tokens > 0"), targets, rounds, smoothing)).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = weights.agg(F.max("ratio")).scalar()
    rates = if_few(weights.select(*[F.col(m).alias(f"__of_{m}") for m in MARGINS], (F.col("ratio") / most).alias("__p")))
    same = [rows[n].eqNullSafe(rates[f"__of_{m}"]) for m, n in names.items()]
    return rows.join(rates, same[0] & same[1] & same[2], "left").withColumn("__chance", F.coalesce("__p", F.lit(1.0)))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> DataFrame:
    """``docs`` with topic, n_tokens, probability and sampled."""
    new = {"topic": F.col("__topic"), "n_tokens": F.col("__tokens"), "probability": F.round("__chance", 9), "sampled": F.col("__u") < F.col("__chance")}
    return _decided(docs, targets, rounds, smoothing).withColumns(new).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, *new])])


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> DataFrame:
    """The rows of ``docs`` that are sampled, with its columns."""
    return _decided(docs, targets, rounds, smoothing).where("__u < __chance").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(rounds: int = ROUNDS, smoothing: float = SMOOTHING, table: str = "documents", kept: str = "") -> str:
    """DuckDB SQL for ``mixed`` with default targets: doc_id, source, lang, topic, n_tokens, probability, sampled."""
    ctes = [
        rf"""r AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '://') THEN 'links' WHEN contains(coalesce(text, ''), 'opyright') THEN 'license' ELSE 'prose' END AS topic,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM {table})""",
        "c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "a AS (SELECT sum(tokens)::DOUBLE AS t FROM c)",
    ]
    for m in MARGINS:
        ctes.append(f"s_{m} AS (SELECT {m}, pow(sum(tokens) / (SELECT t FROM a), {smoothing}) AS s FROM c GROUP BY {m})")
        ctes.append(f"t_{m} AS (SELECT {m}, s / (SELECT sum(s) FROM s_{m}) AS s FROM s_{m})")
    ctes.append("w0 AS (SELECT c.*, tokens::DOUBLE AS weight FROM c)")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT w.* EXCLUDE (weight), weight * t.s / sum(weight) OVER (PARTITION BY w.{m}) AS weight FROM w{k} w JOIN t_{m} t ON w.{m} IS NOT DISTINCT FROM t.{m})")
            k += 1
    return f"""WITH {", ".join(ctes)}, p AS (SELECT source, lang, topic, (weight / tokens) / (SELECT max(weight / tokens) FROM w{k}) AS p FROM w{k})
    SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens::BIGINT AS n_tokens, round(coalesce(p, 1.0), 9) AS probability, u < coalesce(p, 1.0) AS sampled{kept} FROM r LEFT JOIN p
    ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic IS NOT DISTINCT FROM p.topic"""
