"""Series packed into one row per cell: an array of values over the whole time axis.

A row holds all that an operator along time needs, so resampling, climatologies
and runs work within rows: no shuffle, and no more rows than cells. Made once
by :func:`pack`, the layout pays where a table is read often. Arrays are as long
as the axis; NULL elements are missing values. The methods named ``_matrix`` do
the same by NumPy on many cells at a time, which is the faster the longer the
axis; the others stay in expressions.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, once
from ..grid import Axis, Grid

#: Values that a matrix of cells holds.
ROWS = 4_000_000
OPS = ("mean", "min", "max", "sum", "nanmin", "nanmax")


@dataclass(frozen=True)
class Packed:
    """``df`` has the cells' columns and the array column ``value``."""

    df: DataFrame
    cells: tuple[str, ...]
    axis: Axis
    value: str = "value"

    def unpack(self) -> DataFrame:
        """Long rows: time, cells, value."""
        rows = self.df.select(*self.cells, F.posexplode(self.value).alias("i", self.value))
        return rows.select(self.axis.at(F.col("i")).alias("time"), *self.cells, self.value)

    def _with(self, values: Column, axis: Axis) -> Packed:
        return Packed(self.df.select(*self.cells, values.alias(self.value)), self.cells, axis, self.value)

    def resample(self, count: int, op: str = "mean") -> Packed:
        """Every ``count`` steps become one; missing if any is, but for nanmin and nanmax."""
        if op not in OPS:
            raise ValueError(f"op {op!r} is none of {OPS}")
        if count < 1 or self.axis.n % count:
            raise ValueError(f"count {count} does not evenly divide {self.axis.n}")
        n = self.axis.n // count
        # a sum with NULL is NULL; least and greatest of arrays skip it
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        gap = lambda x: F.exists(x, lambda b: b.isNull())
        of = {
            "sum": total,
            "mean": lambda x: total(x) / count,
            "nanmin": F.array_min,
            "nanmax": F.array_max,
            "min": lambda x: F.when(~gap(x), F.array_min(x)),
            "max": lambda x: F.when(~gap(x), F.array_max(x)),
        }[op]
        bins = once(F.col(self.value), lambda x: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: once(F.slice(x, b * count + 1, count), of)))
        last = self.axis.first + dt.timedelta(seconds=self.axis.step * count * (n - 1))
        return self._with(bins, Axis(self.axis.start, self.axis.step * count, n, self.axis.first, last))

    def matrix(self, f: Callable[[np.ndarray], np.ndarray], axis: Axis | None = None) -> DataFrame:
        """(cells, value): ``f`` of many cells at once, as a matrix of cells x steps with NaN for what is missing; Arrow batches, nothing is shuffled."""
        cells, value, n = list(self.cells), self.value, self.axis.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, max(1, ROWS // n)):
                    rows = batch.slice(lo, max(1, ROWS // n))
                    x = rows.column(value).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, n)
                    out = np.ascontiguousarray(f(x))
                    flat = out.ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in cells), lists], names=[*cells, value])

        kept = self.df.select(*cells, value)
        schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in cells) + (", " if cells else "") + f"`{value}` array<double>"
        return kept.mapInArrow(run, schema)

    def resample_matrix(self, count: int, op: str = "mean") -> Packed:
        """As :meth:`resample`, many cells at once."""
        if op not in OPS or count < 1 or self.axis.n % count:
            raise ValueError(f"{op!r} of {count} of {self.axis.n} steps")
        of = {"mean": np.mean, "min": np.min, "max": np.max, "sum": np.sum, "nanmin": np.fmin.reduce, "nanmax": np.fmax.reduce}[op]
        n = self.axis.n // count
        last = self.axis.first + dt.timedelta(seconds=self.axis.step * count * (n - 1))
        df = self.matrix(lambda x: of(x.reshape(len(x), n, count), axis=2))
        return Packed(df, self.cells, Axis(self.axis.start, self.axis.step * count, n, self.axis.first, last), self.value)

    def climatology_matrix(self, op: str = "mean", grouping: str = "dayofyear") -> DataFrame:
        """As :meth:`climatology`, many cells at once."""
        if op not in ("mean", "min", "max", "sum"):
            raise ValueError(f"op {op!r}")
        places = self.slots(grouping)
        years = max(map(len, places), default=0)
        at = np.array([p + [-1] * (years - len(p)) for p in places])

        def slotted(x: np.ndarray) -> np.ndarray:
            total, n = np.zeros((len(x), len(at))), np.zeros((len(x), len(at)), np.int32)
            best = np.full(total.shape, np.nan)
            for k in range(years):  # a year after the other
                v = np.where(at[:, k] >= 0, x[:, at[:, k]], np.nan)
                there = ~np.isnan(v)
                if op in ("mean", "sum"):
                    total += np.where(there, v, 0.0)
                    n += there
                else:
                    best = (np.fmin if op == "min" else np.fmax)(best, v)
            if op in ("min", "max"):
                return best
            return total if op == "sum" else np.divide(total, n, out=best, where=n > 0)

        return self.matrix(slotted)

    def events_matrix(self, holds: Callable[[np.ndarray], np.ndarray], min_duration: int = 1) -> DataFrame:
        """As :meth:`find_events`, many cells at once; ``holds`` takes a matrix, NaN where a value is missing."""
        cells, value, n = list(self.cells), self.value, self.axis.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, max(1, ROWS // n)):
                    rows = batch.slice(lo, max(1, ROWS // n))
                    x = rows.column(value).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, n)
                    ok = np.zeros((len(x), n + 2), np.int8)
                    ok[:, 1:-1] = holds(x) & ~np.isnan(x)
                    edge = np.diff(ok, axis=1)
                    row, start = np.nonzero(edge == 1)
                    size = np.nonzero(edge == -1)[1] - start
                    keep = np.flatnonzero(size >= min_duration)
                    at = pa.array(row[keep])
                    yield pa.RecordBatch.from_arrays([pa.array(start[keep]), *(rows.column(c).take(at) for c in cells), pa.array(size[keep])], names=["time", *cells, "event_duration"])

        kept = self.df.select(*cells, value)
        schema = "time bigint, " + "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in cells) + "event_duration bigint"
        return kept.mapInArrow(run, schema)

    def slots(self, grouping: str = "dayofyear") -> list[list[int]]:
        """Places on the axis of the 366 slots' values, one per year that has the slot."""
        out: list[list[int]] = [[] for _ in range(366)]
        for i in range(self.axis.n):
            day = self.axis.first + dt.timedelta(days=i)
            leap = dt.date(2004, day.month, day.day)
            k = day.timetuple().tm_yday - 1 if grouping == "dayofyear" else leap.timetuple().tm_yday - 1
            out[k].append(i)
        return out

    def climatology(self, op: str = "mean", grouping: str = "dayofyear") -> DataFrame:
        """(cells, value): an array of the 366 slots' mean, min, max or sum of the values that there are."""
        if op not in ("mean", "min", "max", "sum"):
            raise ValueError(f"op {op!r}")
        places = F.from_json(F.lit(json.dumps(self.slots(grouping))), "array<array<int>>")  # folded to a constant

        total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
        of = {"mean": lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)), "sum": total, "min": F.array_min, "max": F.array_max}[op]
        picked = lambda x, p: F.filter(F.transform(p, lambda i: F.get(x, i)), lambda v: v.isNotNull())
        slots = once(F.col(self.value), lambda x: F.transform(places, lambda p: once(picked(x, p), of)))
        return self.df.select(*self.cells, slots.alias(self.value))

    def find_events(self, holds, min_duration: int = 1) -> DataFrame:
        """time (index), cells, event_duration of the runs in which ``holds`` of the value; nothing is shuffled."""
        kept = F.filter(F.transform(self.value, lambda v, i: F.struct(i.alias("i"), holds(v).alias("h"))), lambda x: x["h"])
        # a run starts where the step before isn't kept, and ends where the next isn't
        starts = lambda at: F.filter(at, lambda i, k: (k == 0) | (F.get(at, k - 1) != i - 1))
        ends = lambda at: F.filter(at, lambda i, k: (k == F.size(at) - 1) | (F.get(at, k + 1) != i + 1))
        both = once(F.transform(kept, lambda x: x["i"]), lambda at: F.arrays_zip(starts(at).alias("s"), ends(at).alias("e")))
        runs = self.df.select(*self.cells, F.explode(both).alias("r"))
        out = runs.select(F.col("r.s").cast("bigint").alias("time"), *self.cells, (F.col("r.e") - F.col("r.s") + 1).cast("bigint").alias("event_duration"))
        return out.filter(F.col("event_duration") >= min_duration)


def pack(grid: Grid, axis: Axis | None = None) -> Packed:
    """The grid in packed form: one shuffle by cell; steps without a row become NULL."""
    axis = axis or grid.time_axis()
    i = axis.index(F.col(grid.time))
    at = F.when(i.between(0, axis.n - 1), F.struct(i.alias("i"), F.col(grid.value).alias("v")))
    series = grid.df.groupBy(*grid.cells).agg(F.collect_list(at).alias("__series"))
    return Packed(series.select(*grid.cells, F.transform(filled(F.col("__series"), axis.n), lambda x: x["v"]).alias(grid.value)), tuple(grid.cells), axis, grid.value)
