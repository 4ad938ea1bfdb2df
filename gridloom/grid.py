"""Labelled gridded series as a long DataFrame.

One row is one value: the coordinates of its dimensions, and the value, NULL if
it is missing. The dimensions other than time name a cell. Rows may be absent;
:meth:`Grid.densify` adds them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import metadata
from .functions.columns import DAY, div, filled, later, nan_to_null, seconds


@dataclass(frozen=True)
class Axis:
    """A regular time axis: first time, step in seconds, number of steps. ``start`` is a timestamp literal."""

    start: Column
    step: int
    n: int
    first: object
    last: object

    def index(self, time: Column) -> Column:
        """Place of a time on the axis, from 0."""
        return div(seconds(time.cast("timestamp_ntz") - self.start), self.step)

    def at(self, index: Column) -> Column:
        return later(self.start, index.cast("bigint") * self.step)


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    dims: tuple[str, ...]
    time: str = "time"
    value: str = "value"
    attrs: Mapping[str, object] = field(default_factory=dict)
    _known: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    @classmethod
    def of(cls, df: DataFrame, dims: Sequence[str], value: str, time: str | None = None, attrs: Mapping[str, object] | None = None) -> Grid:
        """A grid of a table's columns; numbers become double and NaN becomes NULL."""
        time = time or metadata.identify_time(df)
        kept = dict.fromkeys([time, *dims])
        t = F.col(time).cast("timestamp_ntz").alias(time, metadata=df.schema[time].metadata)
        return cls(df.select(*(t if c == time else F.col(c) for c in kept), nan_to_null(F.col(value).cast("double")).alias(value)), tuple(kept), time, value, dict(attrs or {}))

    @property
    def cells(self) -> list[str]:
        """The dimensions other than time."""
        return [d for d in self.dims if d != self.time]

    def with_df(self, df: DataFrame, **changes) -> Grid:
        return replace(self, df=df, **changes)

    def select(self, **ranges: tuple) -> Grid:
        """Rows whose coordinates lie in (first, last), both ends included; None leaves an end open."""
        df = self.df
        for d, (lo, hi) in ranges.items():
            df = df if lo is None else df.filter(F.col(d) >= F.lit(lo))
            df = df if hi is None else df.filter(F.col(d) <= F.lit(hi))
        return self.with_df(df)

    def axis(self, dim: str) -> DataFrame:
        """(index, dim): the coordinates of a dimension in order; as long as the axis, not the grid."""
        return self.df.select(dim).distinct().withColumn(f"{dim}_index", (F.row_number().over(Window.orderBy(dim)) - 1).cast("bigint"))

    def time_axis(self) -> Axis:
        """The time axis; ValueError if its steps differ. Two jobs over the times, whose result the grid keeps."""
        if "axis" not in self._known:
            self._known["axis"] = self._find_axis()
        return self._known["axis"]

    def _find_axis(self) -> Axis:
        times = self.df.select(self.time).distinct()
        span = times.agg(F.min(self.time).alias("a"), F.max(self.time).alias("b"), F.count("*").alias("n"), seconds(F.max(self.time) - F.min(self.time)).alias("s")).first()
        if not span["n"]:
            raise ValueError("an empty grid has no time axis")
        if span["n"] == 1:
            return Axis(F.lit(span["a"]).cast("timestamp_ntz"), DAY, 1, span["a"], span["b"])
        step, rest = divmod(span["s"], span["n"] - 1)
        start = F.lit(span["a"]).cast("timestamp_ntz")
        # as many distinct times as there are steps from the first to the last, all on a step: none is missing
        if rest or times.filter(seconds(F.col(self.time) - start) % step != 0).head(1):
            raise ValueError(f"{self.time} has an irregular period")
        return Axis(start, step, span["n"], span["a"], span["b"])

    def spine(self, axis: Axis | None = None) -> DataFrame:
        """Every cell at every time."""
        axis = axis or self.time_axis()
        steps = F.sequence(F.lit(0).cast("bigint"), F.lit(axis.n - 1).cast("bigint"))
        cells = self.df.select(*self.cells).distinct() if self.cells else self.df.select(F.lit(1).alias("one")).limit(1).drop("one")
        return cells.select(*self.cells, F.explode(steps).alias("i")).select(*self.cells, axis.at(F.col("i")).alias(self.time))

    def densify(self, axis: Axis | None = None) -> Grid:
        """The grid with a row for every cell at every time, NULL where there was none; one shuffle, a row per cell in it."""
        axis = axis or self.time_axis()
        i = axis.index(F.col(self.time))
        on_axis = i.between(0, axis.n - 1) & (axis.at(i) == F.col(self.time))
        # rows off the axis count for their cell alone
        at = F.when(on_axis, F.struct(i.alias("i"), F.col(self.value).alias("v")))
        series = self.df.groupBy(*self.cells).agg(F.collect_list(at).alias("__series"))
        full = F.explode(filled(F.col("__series"), axis.n)).alias("__step")
        long = series.select(*self.cells, full).select(*self.cells, axis.at(F.col("__step.i")).alias(self.time), F.col("__step.v").alias(self.value))
        return self.with_df(long.select(*self.dims, self.value))

    def smooth(self, width: int) -> Grid:
        """Centred moving mean over an odd number of rows; NULL where the window isn't full."""
        if width % 2 == 0:
            raise ValueError("a centred window has an odd width")
        w = Window.partitionBy(*self.cells).orderBy(self.time).rowsBetween(-(width // 2), width // 2)
        return self.with_df(self.df.withColumn(self.value, F.when(F.count(self.value).over(w) == width, F.avg(self.value).over(w))))
