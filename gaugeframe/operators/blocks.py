"""Scans along one series without sorting it in one task.

A series is cut into blocks of so many snapshots. A block is sorted and scanned by itself; what a scan must know of the blocks before is in one row
a block (its last row, its sums), and a window over these rows gives each block what it takes over. So a task sorts a block, or one row for each
block of a series, however long that is. Rows without a name of run, metric or series, or without a place in the order, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SERIES = ["run", "metric", "series"]
#: Snapshots in a block.
WIDTH = 1 << 16


class Scan:
    """``rows`` cut into blocks along ``order`` (a whole number; ties by ``then``), series by series."""

    def __init__(self, rows: DataFrame, order: str = "sample_idx", then: tuple[str, ...] = (), by: list[str] | None = None, width: int | None = None):
        self.by, self.order = by or SERIES, (order, *then)
        self.keys = [*self.by, "_block"]
        # nulls go at once: else joins drop them at different places of the branches, and these could not share an exchange
        self.rows = rows.withColumn("_block", F.floor(F.col(order) / (width or WIDTH))).where(" and ".join(f"`{c}` is not null" for c in self.keys))

    @property
    def local(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def blocks(self) -> WindowSpec:
        """Over the rows of blocks, one for each."""
        return Window.partitionBy(*self.by).orderBy("_block")

    def _carry(self, sums: dict[str, Column], taken: list[dict[str, Column]]) -> None:
        """Adds to every row what its block takes over, from a row of ``sums`` for each block; later dicts of ``taken`` may use earlier ones."""
        of_block = self.rows.groupBy(*self.keys).agg(*[c.alias(n) for n, c in sums.items()])
        for more in taken:
            of_block = of_block.withColumns(more)
        self.rows = self.rows.join(of_block.select(*self.keys, *[n for more in taken for n in more]), self.keys)

    def _end(self, last: bool) -> Column:
        pick = F.max_by if last else F.min_by
        return pick(F.struct(*[c for c in self.rows.columns if c not in self.keys]), F.struct(*self.order))

    def neighbours(self, **columns: tuple[str, int]) -> Scan:
        """Each name gets a column's value of the row before (-1) or after (1); null at the ends of the series."""
        near = lambda c, step, w: (F.lag if step < 0 else F.lead)(c).over(w)
        steps = {s for _, s in columns.values()}
        edge = {-1: F.row_number().over(self.local) == 1, 1: F.lead(F.lit(1)).over(self.local).isNull()}
        self.rows = self.rows.withColumns({n: near(c, s, self.local) for n, (c, s) in columns.items()} | {f"_edge{s + 1}": edge[s] for s in steps})
        sums = {f"_end{s + 1}": self._end(s < 0) for s in steps}
        self._carry(sums, [{f"_far_{n}": near(F.col(f"_end{s + 1}")[c], s, self.blocks) for n, (c, s) in columns.items()}])
        self.rows = self.rows.withColumns({n: F.when(F.col(f"_edge{s + 1}"), F.col(f"_far_{n}")).otherwise(F.col(n)) for n, (_, s) in columns.items()})
        self.rows = self.rows.drop(*[f"_edge{s + 1}" for s in steps], *[f"_far_{n}" for n in columns])
        return self

    def running(self, **columns: Column) -> Scan:
        """Each name gets the sum of a column over the series up to and with the row."""
        self.rows = self.rows.withColumns({n: F.sum(c).over(self.local.rowsBetween(Window.unboundedPreceding, 0)) for n, c in columns.items()})
        before = self.blocks.rowsBetween(Window.unboundedPreceding, -1)
        self._carry({"_end": self._end(True)}, [{f"_far_{n}": F.coalesce(F.sum(F.col("_end")[n]).over(before), F.lit(0)) for n in columns}])
        self.rows = self.rows.withColumns({n: F.col(n) + F.col(f"_far_{n}") for n in columns}).drop(*[f"_far_{n}" for n in columns])
        return self

    def placed(self, value: str | None = None) -> Scan:
        """``_k``, the row's place from 1 on, and ``_n``, the rows of the series; with ``value`` also ``_avg`` and ``_std`` (population) of that column over the series."""
        whole = Window.partitionBy(*self.by)
        self.rows = self.rows.withColumn("_k", F.row_number().over(self.local))
        sums = {"_rows": F.count("*"), **({"_has": F.count(value), "_mean": F.avg(value), "_var": F.var_pop(value)} if value else {})}
        before = F.coalesce(F.sum("_rows").over(self.blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = [{"_before": before, "_n": F.sum("_rows").over(whole)}]
        if value:
            all_ = F.sum("_has").over(whole)
            taken.append({"_avg": F.try_divide(F.sum(F.col("_mean") * F.col("_has")).over(whole), all_)})
            spread = F.col("_has") * (F.col("_var") + (F.col("_mean") - F.col("_avg")) * (F.col("_mean") - F.col("_avg")))
            taken.append({"_std": F.sqrt(F.try_divide(F.sum(spread).over(whole), all_))})
        self._carry(sums, taken)
        self.rows = self.rows.withColumn("_k", F.col("_k") + F.col("_before")).drop("_before")
        return self

    def greatest(self, **columns: str) -> Scan:
        """Each name gets the greatest value of a column over the series."""
        whole = Window.partitionBy(*self.by)
        self._carry({f"_most_{n}": F.max(c) for n, c in columns.items()}, [{n: F.max(f"_most_{n}").over(whole) for n in columns}])
        return self

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop("_block", *drop)
