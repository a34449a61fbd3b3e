"""Live rates: counters from a stream, one previous value kept for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "run string, metric string, series string, time_diff long, value double"


def stream_rates(counters: DataFrame) -> DataFrame:
    """Rates of a stream of (run, metric, series, time_diff, value), as operators.timeseries.rates makes them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("time_diff", kind="stable")  # one series in one trigger, all its batches in order
        out = []
        for t, v in rows[["time_diff", "value"]].itertuples(index=False):
            if before is not None and t < before[0]:
                continue  # later than its successors: the state never goes back in time
            if before is None:
                out.append((*key, t, 0.0))
            elif v >= before[1] and t > before[0]:
                out.append((*key, t, (v - before[1]) / (t - before[0])))
            before = (int(t), float(v))
        if before is not None:
            state.update(before)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return counters.groupBy("run", "metric", "series").applyInPandasWithState(step, OUT, "t long, v double", "append", "NoTimeout")


def bucket_sums(events: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Sums of ``value`` by metric in tumbling seconds, late rows up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 second"), "metric").agg(F.sum("value").alias("value"))
