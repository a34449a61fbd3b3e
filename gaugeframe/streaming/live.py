"""Live excursions and findings: spikes and drops of running series against known bounds, and findings of rules as points come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.blocks import Scan
from gaugeframe.operators.timeseries import closed_runs

OUT = "run string, metric string, series string, kind string, begin long, end long, peak double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
#: An open excursion of a kind: begin and peak, null while there is none; and the time of the last point.
STATE = "at long, spike_begin long, spike_peak double, drop_begin long, drop_peak double"


def bounds_of(statistics: DataFrame) -> DataFrame:
    """metric, high, low from statistics(metric, avg, std) of a base run: mean + 2 deviations; mean - 2 deviations, 0 at least, null where the deviation is 0.001 or less."""
    high, low = F.col("avg") + 2 * F.col("std"), F.greatest(F.col("avg") - 2 * F.col("std"), F.lit(0.0))
    return statistics.select("metric", high.alias("high"), F.when(F.col("std") > 0.001, low).alias("low"))


def bounded(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Points (run, metric, series, time_diff, value), streaming or not, with the bounds of their metric; metrics without bounds are left out."""
    return points.select("run", "metric", "series", "time_diff", "value").join(F.broadcast(bounds), "metric")  # a row for each metric


def _step(state: list, t: int, v: float, high: float | None, low: float | None) -> list[tuple]:
    """Takes one point into the state and returns the excursions it closes."""
    closed = []
    for kind, at, beyond, worse in (("spike", 1, pd.notna(high) and v > high, max), ("drop", 3, pd.notna(low) and v < low, min)):
        if beyond:
            state[at], state[at + 1] = (t, v) if state[at] is None else (state[at], worse(state[at + 1], v))
        elif state[at] is not None:
            closed.append((kind, state[at], t, state[at + 1]))
            state[at] = state[at + 1] = None
    state[0] = t
    return closed


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: list) -> pd.DataFrame:
    rows = pd.concat(list(batches)).sort_values("time_diff", kind="stable")  # of one series, what one trigger brings
    out = []
    for t, v, high, low in rows[["time_diff", "value", "high", "low"]].itertuples(index=False):
        if state[0] is None or t > state[0]:  # later than its successors: left out
            out += [(*key, *x) for x in _step(state, int(t), float(v), high, low)]
    return pd.DataFrame(out, columns=NAMES)


def live_excursions(points: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Spikes and drops of a stream of ``bounded`` points: each is given out when a point closes it. A series without points for ``idle_ms`` of processing time is forgotten,
    and with it what was open. One row of state a series. A query that should end when its input is used up needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off, since timeouts keep it going."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            yield pd.DataFrame([], columns=NAMES)
            return
        state = list(group.get) if group.exists else [None] * 5
        out = _run(key, batches, state)
        group.update(tuple(state))
        group.setTimeoutDuration(idle_ms)
        yield out

    return points.groupBy("run", "metric", "series").applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout")


def excursions(points: DataFrame) -> DataFrame:
    """The same of ``bounded`` points that are all there, by the batch engine: in blocks, a series over several tasks."""
    spike, drop = (F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("value") > F.col("high"), F.col("value") < F.col("low")))
    return closed_runs(Scan(points.withColumns({"_spike": spike, "_drop": drop}), "time_diff")).select(*NAMES)
