"""Hot spots of code: sampled loads by where they were served, branches, and reports of the largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit of a mispredicted branch, a counter at its end, and the places that serve loads by the code of their source; all others are DRAM.
MISPREDICTED, SATURATED = 1 << 7, 4095
SERVED = {"L1": (0,), "L2": (8,), "L3": (10, 11, 12), "DRAM": ()}
LOCATION = ["ino", "offset", "maj", "min", "gen"]


def loads(samples: DataFrame, caps: tuple[int, int, int]) -> DataFrame:
    """Samples (LOCATION, source, total, issue, translation) with ``place`` (L1, L2, L3, DRAM), ``bin`` (0-3) of their execution latency by the greatest ones of the
    three caches, and ``saturated``: whether the issue counter is at its end."""
    place = F.coalesce(*[F.when(F.col("source").isin(*codes), F.lit(p)) for p, codes in SERVED.items() if codes], F.lit("DRAM"))
    run = F.col("total") - F.col("issue") - F.col("translation")
    return samples.withColumns({"place": place, "bin": F.coalesce(*[F.when(run <= c, F.lit(k)) for k, c in enumerate(caps)], F.lit(len(caps))), "saturated": F.col("issue") == SATURATED})


def latencies(loads_: DataFrame, by: list[str]) -> DataFrame:
    """For each location the number of samples and of saturated ones, and of the others the sums of the counters and a histogram of place x bin (16 numbers)."""
    good = lambda c: F.sum(F.when(F.col("saturated"), 0).otherwise(F.col(c)))
    cells = [F.count_if((F.col("place") == p) & (F.col("bin") == b) & ~F.col("saturated")) for p in SERVED for b in range(4)]
    sums = {c: good(c) for c in ("total", "issue", "translation")}
    return loads_.groupBy(*by).agg(*[x.alias(c) for c, x in sums.items()], F.count_if("saturated").alias("saturated"), F.count("*").alias("count"), F.array(*cells).alias("h"))


def shares(latencies_: DataFrame) -> DataFrame:
    """The share of each place, and of each latency bin within it, in percent; 0 where there is none."""
    width = 4
    out = latencies_.withColumn("_all", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x))
    for k, p in enumerate(SERVED):
        part = F.aggregate(F.slice("h", k * width + 1, width), F.lit(0).cast("long"), lambda a, x: a + x)
        out = out.withColumn(f"_{p}", part).withColumn(p, F.coalesce(F.try_divide(F.col(f"_{p}") * 100.0, F.col("_all")), F.lit(0.0)))
        for b in range(width):
            out = out.withColumn(f"{p}_{b}", F.coalesce(F.try_divide(F.get("h", F.lit(k * width + b)) * 100.0, F.col(f"_{p}")), F.lit(0.0)))
    return out.drop("_all", *[f"_{p}" for p in SERVED])


def mean_latency(latencies_: DataFrame, scale: int = 1000) -> DataFrame:
    return latencies_.withColumns({f"mean_{c}": F.coalesce(F.try_divide(F.col(c), F.col("count") * scale), F.lit(0.0)) for c in ("total", "issue", "translation")})


def mispredicted(events: Column) -> Column:
    return events.bitwiseAND(MISPREDICTED) != 0


def branches(samples: DataFrame, by: list[str]) -> DataFrame:
    """Counts and mispredictions of each branch, with their percentage and the type seen last (ts)."""
    miss = mispredicted(F.col("events")).cast("long")
    out = samples.groupBy(*by).agg(F.count("*").alias("count"), F.sum(miss).alias("mispredicted"), F.max_by("branch_type", "ts").alias("branch_type"))
    return out.withColumn("percent", F.try_divide(F.col("mispredicted") * 100.0, F.col("count")))


def reports(latencies_: DataFrame, branches_: DataFrame, n: int = 5000) -> dict[str, DataFrame]:
    """The five reports: the largest ``n`` branches by mispredictions, and locations by total, execution, issue and translation time."""
    place = lambda df: [c for c in LOCATION if c in df.columns]
    top = lambda df, order: df.orderBy(order.desc(), *place(df)).limit(n)
    run = F.col("total") - F.col("issue") - F.col("translation")
    return {"branches": top(branches_, F.col("mispredicted")), "latency": top(latencies_, F.col("total")), "execution": top(latencies_, run), "issue": top(latencies_, F.col("issue")), "translation": top(latencies_, F.col("translation"))}
