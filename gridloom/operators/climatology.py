"""Day-of-year and month-day climatologies of whole years of daily values.

Values of one slot (a day of the year) are compared over the years. With
``dayofyear`` a slot is the number of the day, so that March 1 is slot 60 or 61
and slot 366 belongs to leap years alone; with ``monthday`` it is the calendar
day, and February 29 belongs to leap years alone. Results have all 366 slots.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY, filled, nan_to_null, whole
from ..grid import Axis, Grid

RANKS = ("average", "min", "max", "dense", "ordinal")
_LEAP = "2004-01-01"


class Climatology:
    """``df`` has the cells, the slot's columns and the value.

    ``of`` and ``agg`` say which group's aggregate it is, if it is a plain one.
    """

    def __init__(self, df: DataFrame, cells: list[str], slot: list[str], value: str, of: BlockedGroupby | None = None, agg: Column | None = None):
        self.df, self.cells, self.slot, self.value, self.of, self.agg = df, cells, slot, value, of, agg


class BlockedGroupby:
    """A daily series of whole years, grouped by slot."""

    def __init__(self, grid: Grid, grouping: str, validate: bool = True):
        if grouping not in ("dayofyear", "monthday"):
            raise NotImplementedError(f"grouping {grouping!r}")
        self.grid, self.grouping = grid, grouping
        self.slot = ["dayofyear"] if grouping == "dayofyear" else ["month", "day"]
        self._years: tuple[int, int] | None = None
        if validate:
            self.check(grid.time_axis())

    def check(self, axis: Axis) -> None:
        first, last = axis.first, axis.last
        if axis.step != DAY:
            raise ValueError("the time axis is not daily")
        if (first.month, first.day) != (1, 1) or (first.hour, first.minute, first.second) != (0, 0, 0):
            raise ValueError(f"the series starts on {first}, not on January 1")
        if (last.month, last.day) != (12, 31):
            raise ValueError(f"the series ends on {last}, not on December 31")
        self._years = first.year, last.year

    @property
    def years(self) -> tuple[int, int]:
        """First and last year."""
        if self._years is None:
            r = self.grid.df.agg(F.year(F.min(self.grid.time)), F.year(F.max(self.grid.time))).first()
            self._years = r[0], r[1]
        return self._years

    @property
    def n_years(self) -> int:
        return self.years[1] - self.years[0] + 1

    def _slots(self) -> list[Column]:
        t = F.col(self.grid.time)
        if self.grouping == "dayofyear":
            return [F.dayofyear(t).cast("bigint").alias("dayofyear")]
        return [F.month(t).cast("bigint").alias("month"), F.day(t).cast("bigint").alias("day")]

    def slotted(self) -> DataFrame:
        """The series with its slot's columns and ``year``."""
        return self.grid.df.select("*", *self._slots(), F.year(self.grid.time).cast("bigint").alias("year"))

    def _all_slots(self, days: Column) -> list[Column]:
        """The slot's columns of day 0 to 365 of a leap year."""
        if self.grouping == "dayofyear":
            return [(days + 1).cast("bigint").alias("dayofyear")]
        date = F.date_add(F.lit(_LEAP).cast("date"), days.cast("int"))
        return [F.month(date).cast("bigint").alias("month"), F.day(date).cast("bigint").alias("day")]

    def _cells(self) -> DataFrame:
        c = self.grid.cells
        return self.grid.df.select(*c).distinct() if c else self.grid.df.select(F.lit(1).alias("one")).limit(1).drop("one")

    def _spine(self) -> DataFrame:
        days = F.explode(F.sequence(F.lit(0), F.lit(365))).alias("days")
        return self._cells().select(*self.grid.cells, days).select(*self.grid.cells, *self._all_slots(F.col("days")))

    def _reduce(self, agg: Column, empty: Column | None = None, full: bool = True, plain: bool = True) -> Climatology:
        g = self.grid
        keys = [*g.cells, *self.slot]
        if not full:
            out = self.slotted().groupBy(*keys).agg(agg.alias(g.value))
            return Climatology(out.select(*keys, g.value), g.cells, self.slot, g.value, self, agg if plain else None)
        # a cell's slots, 366 at most, are gathered and those that it lacks are added
        day = self._day(F.col(g.time))
        slots = g.df.groupBy(*g.cells, day.alias("__slot")).agg(agg.alias("__value"))
        whole_year = slots.groupBy(*g.cells).agg(F.collect_list(F.struct(F.col("__slot").alias("i"), F.col("__value").alias("v"))).alias("__slots")).select(*g.cells, F.explode(filled(F.col("__slots"), 366)).alias("__slot"))
        value = F.col("__slot.v") if empty is None else F.coalesce(F.col("__slot.v"), empty)
        out = whole_year.select(*g.cells, *self._all_slots(F.col("__slot.i")), value.alias(g.value))
        return Climatology(out.select(*keys, g.value), g.cells, self.slot, g.value, self, agg if plain and empty is None else None)

    def _day(self, t: Column) -> Column:
        """Number of the slot, from 0."""
        if self.grouping == "dayofyear":
            return (F.dayofyear(t) - 1).cast("bigint")
        return (F.dayofyear(F.make_date(F.lit(2004), F.month(t), F.day(t))) - 1).cast("bigint")

    # reductions that skip missing values

    def mean(self, full: bool = True) -> Climatology:
        """Mean; with ``full`` false only of the slots that occur, without the join that adds the others."""
        return self._reduce(F.avg(self.grid.value), full=full)

    def min(self) -> Climatology:
        return self._reduce(F.min(self.grid.value))

    def max(self) -> Climatology:
        return self._reduce(F.max(self.grid.value))

    def sum(self) -> Climatology:
        """Sum; 0 if there is nothing to add."""
        return self._reduce(F.sum(self.grid.value), F.lit(0.0))

    def nanpercentile(self, q: float) -> Climatology:
        """Exact percentile with linear interpolation of the values that there are; q from 0 to 100."""
        return self._reduce(F.percentile(self.grid.value, F.lit(q / 100)))

    def percentile(self, q: float) -> Climatology:
        """Exact percentile; missing if the slot lacks a value in any year."""
        return self._reduce(whole(F.percentile(self.grid.value, F.lit(q / 100)), F.col(self.grid.value), self.n_years), plain=False)

    def reduce(self, op: Callable[[pd.Series], float]) -> Climatology:
        """Any function of a slot's values in order of the years, NaN where there is none; Python code per cell, which calls ``op`` per slot."""
        g, value, slot = self.grid, self.grid.value, list(self.slot)
        cells, blocks = list(g.cells), self.block()

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([*slot, "year"], kind="stable")
            first = np.flatnonzero(~rows.duplicated(slot).to_numpy())
            out = rows[[*cells, *slot]].iloc[first].reset_index(drop=True)
            series = np.split(rows[value].to_numpy(), first[1:])
            return out.assign(**{value: [float(op(pd.Series(x))) for x in series]})

        keys = [*cells, *slot]
        schema = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys) + f", `{value}` double"
        grouped = blocks.groupBy(*cells) if cells else blocks.groupBy(F.lit(0))
        out = grouped.applyInPandas(run, schema).withColumn(value, nan_to_null(F.col(value)))
        return Climatology(out, g.cells, self.slot, g.value)

    # blocks of years

    def block(self) -> DataFrame:
        """(year from 0, cells, slot, value) with 366 slots in every year."""
        g = self.grid
        first, last = self.years
        year = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last - first).cast("bigint"))).alias("year")
        spine = self._spine().select("*", year)
        rows = self.slotted().withColumn("year", F.col("year") - first).select("year", *g.cells, *self.slot, g.value)
        keys = ["year", *g.cells, *self.slot]
        return spine.join(rows, keys, "left").select(*keys, g.value)

    def unblock(self, blocks: DataFrame) -> Grid:
        """The series of a frame such as :meth:`block` gives; slots that a year lacks are dropped."""
        g = self.grid
        first = self.years[0]
        at = self.slotted().withColumn("year", F.col("year") - first).select("year", *self.slot, *g.cells, g.time)
        out = at.join(blocks, ["year", *g.cells, *self.slot])
        return g.with_df(out.select(*g.dims, g.value))

    def apply(self, op: Callable[[pd.DataFrame], pd.DataFrame]) -> Grid:
        """Any function of a cell's year x slot table that keeps its shape; Python code per cell."""
        g, value = self.grid, self.grid.value
        blocks = self.block()
        cols, slot, cells = blocks.columns, list(self.slot), list(g.cells)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            table = rows.set_index(["year", *slot])[value].unstack(slot).sort_index(axis=0).sort_index(axis=1)
            new = pd.DataFrame(op(table), index=table.index, columns=table.columns)
            long = new.stack(slot, future_stack=True).rename(value).reset_index()
            for c in cells:
                long[c] = rows[c].iloc[0]
            return long[cols]

        schema = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in cols)
        done = (blocks.groupBy(*g.cells) if g.cells else blocks.groupBy(F.lit(0))).applyInPandas(run, schema)
        return self.unblock(done.withColumn(value, nan_to_null(F.col(value))))

    def rank(self, method: str = "average") -> Grid:
        """Rank of each value within its slot over the years, from 1; a missing value has none."""
        if method not in RANKS:
            raise ValueError(f"method {method!r} is none of {RANKS}")
        g = self.grid
        keys = [*g.cells, *self.slot]
        v = F.col(g.value)
        by = Window.partitionBy(*keys)
        w = by.orderBy(v.asc_nulls_last())
        last = F.count(v).over(w)  # values no larger, so the greatest rank of equal ones
        of = {
            "min": F.rank().over(w),
            "max": last,
            "dense": F.dense_rank().over(w),
            "ordinal": F.row_number().over(by.orderBy(v.asc_nulls_last(), "year")),
            "average": (F.rank().over(w) + last) / 2,
        }[method]
        ranked = self.slotted().withColumn("rank", F.when(v.isNotNull(), of.cast("double")))
        return g.with_df(ranked.select(*g.dims, F.col("rank").alias(g.value)))

    # arithmetic with a climatology

    def combine(self, other: Climatology, op: Callable[[Column, Column], Column]) -> Grid:
        """``op`` of each value and its slot's value in ``other``, matched by cell and slot."""
        if not isinstance(other, Climatology):
            raise TypeError("the other operand must be a Climatology")
        if other.slot != self.slot:
            raise KeyError(f"the other operand has no {self.slot}")
        g = self.grid
        if other.of is self and other.agg is not None:
            # the series' own climatology is there in the shuffle that brings a slot together
            normal = other.agg.over(Window.partitionBy(*g.cells, *self.slot))
            out = self.slotted().withColumn("normal", normal)
        else:
            shared = [c for c in g.cells if c in other.cells]
            norm = other.df.withColumnRenamed(other.value, "normal").select(*shared, *self.slot, "normal")
            out = self.slotted().join(norm, [*shared, *self.slot], "left")
        return g.with_df(out.select(*g.dims, op(F.col(g.value), F.col("normal")).alias(g.value)))

    def __add__(self, other: Climatology) -> Grid:
        return self.combine(other, lambda a, b: a + b)

    def __sub__(self, other: Climatology) -> Grid:
        return self.combine(other, lambda a, b: a - b)

    def __mul__(self, other: Climatology) -> Grid:
        return self.combine(other, lambda a, b: a * b)

    def __truediv__(self, other: Climatology) -> Grid:
        """Ratio; missing where the climatology is 0."""
        return self.combine(other, lambda a, b: F.try_divide(a, b))


def blocked_groupby(grid: Grid, indexer: dict[str, str] | None = None, validate: bool = True, **by: str) -> BlockedGroupby:
    """Group one dimension, time, by ``dayofyear`` or ``monthday``."""
    by = dict(indexer or {}) | by
    if len(by) != 1 or next(iter(by)) != grid.time:
        raise ValueError(f"give one dimension, {grid.time}; got {sorted(by)}")
    return BlockedGroupby(grid, by[grid.time], validate)


