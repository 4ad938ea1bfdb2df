"""Regular resampling: every ``count`` steps of an axis become one.

The label of a bin is its first coordinate. Bins are found by arithmetic on the
time axis, so that a plain group-by does the rest, with partial aggregation
before its one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import div, whole
from ..grid import Axis, Grid

#: Bins that a Python function's task takes together.
BINS = 512
# Seconds of the periods that a bin may be given by.
PERIODS = {"s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86_400, "W": 604_800}


def _seconds_of(period: str) -> int:
    n = period.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    unit = period[len(n) :]
    if unit not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    return int(n or 1) * PERIODS[unit]


class Resampler:
    """Reductions of every ``count`` steps along time."""

    def __init__(self, grid: Grid, count: int, axis: Axis | None = None):
        self.grid, self.count = grid, count
        self.axis = axis or grid.time_axis()
        if count < 1 or self.axis.n % count:
            raise ValueError(f"count {count} does not evenly divide the size of {grid.time} ({self.axis.n})")

    def _bins(self):
        g = self.grid
        return g.df.withColumn("bin", div(self.axis.index(F.col(g.time)), self.count))

    def _agg(self, agg: Column) -> Grid:
        g = self.grid
        out = self._bins().groupBy(*g.cells, "bin").agg(agg.alias(g.value))
        return g.with_df(out.select(*(self.axis.at(F.col("bin") * self.count).alias(g.time) if d == g.time else F.col(d) for d in g.dims), g.value))

    def _full(self, agg: Column) -> Grid:
        return self._agg(whole(agg, F.col(self.grid.value), self.count))

    def mean(self) -> Grid:
        """Mean; missing if any value is."""
        return self._full(F.avg(self.grid.value))

    def min(self) -> Grid:
        return self._full(F.min(self.grid.value))

    def max(self) -> Grid:
        return self._full(F.max(self.grid.value))

    def sum(self) -> Grid:
        return self._full(F.sum(self.grid.value))

    def nanmin(self) -> Grid:
        """Least of the values that there are."""
        return self._agg(F.min(self.grid.value))

    def nanmax(self) -> Grid:
        return self._agg(F.max(self.grid.value))

    def reduce(self, op: Callable[[pd.Series], float]) -> Grid:
        """Any function of a bin's values in time order, missing ones as NaN; Python code per run of bins, which calls ``op`` per bin."""
        g, time, value = self.grid, self.grid.time, self.grid.value
        cells = list(g.cells)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["bin", time], kind="stable")
            first = np.flatnonzero(~rows.duplicated("bin").to_numpy())
            out = rows[[*cells, "bin"]].iloc[first].reset_index(drop=True)
            series = np.split(rows[value].to_numpy(), first[1:])
            return out.assign(**{value: [float(op(pd.Series(x))) for x in series]})

        bins = self._bins().withColumn("bins", div(F.col("bin"), BINS))
        schema = ", ".join(f"`{k}` {bins.schema[k].dataType.simpleString()}" for k in [*cells, "bin"]) + f", `{value}` double"
        out = bins.groupBy(*cells, "bins").applyInPandas(run, schema)
        return g.with_df(out.select(*(self.axis.at(F.col("bin") * self.count).alias(time) if d == time else F.col(d) for d in g.dims), value))


def blocked_resample(grid: Grid, indexer: dict[str, int | str] | None = None, **by: int | str) -> Resampler:
    """Resample one dimension by a number of steps or a period such as ``"1D"``."""
    by = dict(indexer or {}) | by
    if len(by) != 1 or next(iter(by)) != grid.time:
        raise ValueError(f"give one dimension, {grid.time}; got {sorted(by)}")
    size = by[grid.time]
    axis = grid.time_axis()
    if isinstance(size, str):
        period = _seconds_of(size)
        if period % axis.step:
            raise ValueError(f"{size} is no whole number of steps of {axis.step} s")
        size = period // axis.step
    return Resampler(grid, size, axis)
