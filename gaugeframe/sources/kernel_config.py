"""Kernel configuration text to key-values, with the path of groups that comment banners open and ``# end of`` lines close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a comment line that belongs to no banner contains.
NOT_BANNER = ("is not set", "NOTE", "also be needed", "end of")


def entries(text: str) -> list[tuple[str, str, str]]:
    """(group path joined by ``:``, key, value) of one configuration; a banner is three comment lines in a row.

    A group takes all that follows up to the next banner. ``# end of X`` moves the groups opened since X into X.
    """
    opened: list[tuple[str, list[tuple[tuple[str, ...], str, str]]]] = [("", [])]
    banner: list[str] = []
    for line in text.splitlines():
        if line.startswith("#") and not any(mark in line for mark in NOT_BANNER):
            banner.append(line)
            continue
        if len(banner) == 3:
            opened.append((banner[1][2:], []))
        banner = []
        key, equals, value = line.partition("=")
        if equals:
            opened[-1][1].append(((), key, value))
        if "is not set" in line:
            opened[-1][1].append(((), line.split(" ")[1], "not set"))
        if "end of" in line:
            name = line.split(" ", 3)[-1]
            at = max((k for k, (known, _) in enumerate(opened) if known == name), default=None)
            if at is not None:
                for inner, rows in opened[at + 1 :]:
                    opened[at][1].extend(((inner, *path), k, v) for path, k, v in rows)
                del opened[at + 1 :]
    return [(":".join(x for x in (name, *path) if x), k, v) for name, rows in opened for path, k, v in rows]


def kernel_config(raw: DataFrame) -> DataFrame:
    """raw(run, payload), one text a row, to run, grp, key, value; the last of repeated keys of a group holds. Null text: no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["run"], b["payload"], strict=True):
                last = {(group, key): value for group, key, value in entries(text or "")}
                yield pd.DataFrame([(name, *at, value) for at, value in last.items()], columns=["run", "grp", "key", "value"])

    return raw.select("run", "payload").mapInPandas(run, "run string, grp string, key string, value string")
