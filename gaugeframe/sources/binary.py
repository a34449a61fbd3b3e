"""Files of fixed-width binary entries, and stored profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"i8": "long", "u8": "long", "i4": "int", "u4": "long", "f8": "double"}


def fixed_width(files: DataFrame, fields: dict[str, str], header: int = 0) -> DataFrame:
    """run and one row for each entry of little-endian ``fields`` (name to type: i4, u4, i8, u8, f8) behind ``header`` bytes; a last entry that is cut short is left out."""
    layout = np.dtype([(n, "<" + t) for n, t in fields.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["run"], b["content"], strict=True):
                rows = np.frombuffer(content, layout, max(0, len(content) - header) // layout.itemsize, header) if len(content) > header else np.zeros(0, layout)
                yield pd.DataFrame({"run": name} | {n: rows[n].astype(np.int64) if TYPES[t] == "long" else rows[n] for n, t in fields.items()}, index=range(len(rows)))

    return files.select("run", "content").mapInPandas(run, "run string, " + ", ".join(f"{n} {TYPES[t]}" for n, t in fields.items()))


PROFILER = "struct<start_time_ms:long,block_width_ms:long,metadata:map<string,map<string,string>>,profiles:map<string,array<struct<block:long,thread_state:int,path:array<string>,count:long>>>>"


def stored_samples(texts: DataFrame) -> DataFrame:
    """run, profiler, profile_type, block, thread_state, path, count of stored profilers (run, profiler, payload as JSON)."""
    rows = texts.select("run", "profiler", F.from_json("payload", PROFILER).alias("p")).select("run", "profiler", F.explode("p.profiles").alias("profile_type", "s"))
    return rows.select("run", "profiler", "profile_type", F.inline("s"))
