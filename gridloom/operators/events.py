"""Events: maximal runs of consecutive time steps in which a condition holds.

An event table has ``time`` (index of the first step), the cells' dimensions and
``event_duration`` (number of steps). With :func:`indexed`, cells are indices
too; otherwise they are coordinates. An event's key is (cells, time);
:func:`with_event_id` numbers events where a single number is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, seconds
from ..grid import Axis, Grid

DURATION = "event_duration"
#: Steps within which events begin that a Python function's task takes together.
TOGETHER = 4096
_WIDTH = {"time": "bigint", DURATION: "bigint"}


def steps(grid: Grid, axis: Axis | None = None) -> DataFrame:
    """The grid's rows with the time replaced by its index, named ``time``."""
    axis = axis or grid.time_axis()
    return grid.df.select(axis.index(F.col(grid.time)).alias("time"), *grid.cells, grid.value)


def indexed(grid: Grid) -> Grid:
    """The grid with the coordinates of its cells replaced by their indices; axes join by broadcast if small."""
    df = grid.df
    for c in grid.cells:
        df = df.join(grid.axis(c), c).drop(c).withColumnRenamed(f"{c}_index", c)
    return grid.with_df(df.select(*grid.dims, grid.value))


def runs(rows: DataFrame, cells: Sequence[str], time: str = "time") -> DataFrame:
    """Maximal runs of consecutive ``time`` in each cell: time, cells, event_duration.

    The window and the group-by share one shuffle by cell.
    """
    w = Window.partitionBy(*cells).orderBy(time)
    island = rows.withColumn("island", F.col(time) - F.row_number().over(w))
    out = island.groupBy(*cells, "island").agg(F.min(time).cast("bigint").alias("time"), F.count("*").alias(DURATION))
    return out.select("time", *cells, DURATION)


def find_events(grid: Grid, condition: Column | Callable[[Column], Column], min_duration: int = 1, axis: Axis | None = None) -> DataFrame:
    """Events of a condition on the value; a missing value or step ends a run."""
    holds = condition(F.col(grid.value)) if callable(condition) and not isinstance(condition, Column) else condition
    found = runs(steps(grid.with_df(grid.df.filter(holds)), axis or grid.time_axis()), grid.cells)
    return found.filter(F.col(DURATION) >= min_duration) if min_duration > 1 else found


def event_summary(grid: Grid, condition: Callable[[Column], Column], min_duration: int = 1, axis: Axis | None = None, **aggs: Column) -> DataFrame:
    """Events with aggregates of their own values, in the one shuffle that finds them."""
    axis = axis or grid.time_axis()
    rows = steps(grid.with_df(grid.df.filter(condition(F.col(grid.value)))), axis)
    w = Window.partitionBy(*grid.cells).orderBy("time")
    island = rows.withColumn("island", F.col("time") - F.row_number().over(w))
    out = island.groupBy(*grid.cells, "island").agg(F.min("time").cast("bigint").alias("time"), F.count("*").alias(DURATION), *(a.alias(n) for n, a in aggs.items()))
    return out.filter(F.col(DURATION) >= min_duration).select("time", *grid.cells, DURATION, *aggs)


def find_events_block(rows: DataFrame, cells: Sequence[str], first: int, last: int, min_duration: int = 1) -> DataFrame:
    """Events within the steps first..last of rows in which the condition holds; short ones that touch an end stay, so that blocks can be joined."""
    found = runs(rows.filter(F.col("time").between(first, last)), cells)
    touches = (F.col("time") == first) | (F.col("time") + F.col(DURATION) - 1 == last)
    return found.filter((F.col(DURATION) >= min_duration) | touches)


def join_events(events: DataFrame | Sequence[DataFrame], cells: Sequence[str] | None = None, min_duration: int = 1) -> DataFrame:
    """Joins events of one cell that follow each other without a gap, such as those of neighbouring blocks of time."""
    if not isinstance(events, DataFrame):
        first, *rest = events
        for e in rest:
            first = first.unionByName(e)
        events = first
    cells = [c for c in events.columns if c not in ("time", DURATION)] if cells is None else list(cells)
    w = Window.partitionBy(*cells).orderBy("time")
    stop = F.lag(F.col("time") + F.col(DURATION)).over(w)
    fresh = F.when(stop == F.col("time"), 0).otherwise(1)
    grouped = events.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy(*cells, "run").agg(F.min("time").alias("time"), F.sum(DURATION).alias(DURATION))
    return grouped.filter(F.col(DURATION) >= min_duration).select("time", *cells, DURATION)


def offset_events(events: DataFrame, **by: int) -> DataFrame:
    """Moves a block's events to their place in the whole: adds an offset to the named columns."""
    return events.withColumns({c: F.col(c) + n for c, n in by.items()})


def with_event_id(events: DataFrame) -> DataFrame:
    """Adds ``event_id``, from 0, in order of the events' ends and then of their cells.

    One task numbers them: for tables of events, not of values.
    """
    cells = [c for c in events.columns if c not in ("time", DURATION)]
    w = Window.orderBy(F.col("time") + F.col(DURATION), *cells)
    return events.withColumn("event_id", (F.row_number().over(w) - 1).cast("bigint"))


def extend_events(events: DataFrame) -> DataFrame:
    """One row per step of each event, in place of its duration."""
    step = F.explode(F.sequence(F.col("time"), F.col("time") + F.col(DURATION) - 1))
    return events.select(*(step.alias("time") if c == "time" else F.col(c) for c in events.columns if c != DURATION))


def event_values(grid: Grid, events: DataFrame, axis: Axis | None = None) -> DataFrame:
    """The value at every step of each event. Events are extended first, so that the range join is an equi-join."""
    rows = steps(grid, axis)
    keys = ["time", *grid.cells]
    extended = extend_events(events)
    return extended.join(rows, keys, "left").select(*extended.columns, grid.value)


def event_stats(grid: Grid, events: DataFrame, axis: Axis | None = None, **aggs: Column) -> DataFrame:
    """Events with aggregates of their values, e.g. ``total=F.sum("value")``."""
    keys = [c for c in events.columns if c not in ("time", DURATION)]
    extended = extend_events(events.withColumn("event_start", F.col("time")).withColumn("event_length", F.col(DURATION)))
    valued = extended.join(steps(grid, axis), ["time", *grid.cells], "left")
    stats = valued.groupBy("event_start", *keys, "event_length").agg(*(a.alias(n) for n, a in aggs.items()))
    named = {"time": "event_start", DURATION: "event_length"}
    return stats.select(*(F.col(named.get(c, c)).alias(c) for c in events.columns), *aggs)


def map_events(grid: Grid, events: DataFrame, func: Callable[[pd.Series], object], schema: str | None = None, axis: Axis | None = None) -> DataFrame:
    """Events with the result of any function of their values in time order; Python code per run of events.

    ``func`` gives a number, or a dict of numbers named in ``schema``. Without a
    schema it is tried on one event.
    """
    cells = [c for c in events.columns if c not in ("time", DURATION)]
    extended = extend_events(events.withColumn("event_start", F.col("time")).withColumn("event_length", F.col(DURATION)))
    valued = extended.join(steps(grid, axis), ["time", *grid.cells], "left")
    keys = ["event_start", *cells, "event_length"]
    if schema is None:
        one = events.limit(1)
        got = [r[0] for r in event_values(grid, one, axis).orderBy("time").select(grid.value).collect()] if one.head(1) else [0.0]
        result = func(pd.Series(got, dtype=float))
        schema = ", ".join(f"`{k}` double" for k in (result if isinstance(result, dict) else {"result": 0}))
    names = [f.strip().split()[0].strip("`") for f in schema.split(",")]
    column = grid.value

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, "time"], kind="stable")
        first = np.flatnonzero(~rows.duplicated(keys).to_numpy())
        out = rows[keys].iloc[first].reset_index(drop=True)
        results = [func(pd.Series(x)) for x in np.split(rows[column].to_numpy(), first[1:])]
        return out.assign(**{n: [r[n] if isinstance(r, dict) else r for r in results] for n in names})[[*keys, *names]]

    types = {**{c: valued.schema[c].dataType.simpleString() for c in keys}}
    # many events to a task's call: those that begin in one run of steps of a cell
    together = valued.withColumn("events", F.floor(F.col("event_start") / TOGETHER))
    out = together.groupBy(*grid.cells, "events").applyInPandas(run, ", ".join(f"`{k}` {t}" for k, t in types.items()) + ", " + schema)
    out = out.withColumnsRenamed({"event_start": "time", "event_length": DURATION})
    return out.select("time", *cells, DURATION, *names)


def event_coords(grid: Grid, events: DataFrame, axis: Axis | None = None) -> DataFrame:
    """Events with coordinates in place of indices, and their duration in seconds.

    An event that lasts to the end of the series has no known duration.
    """
    axis = axis or grid.time_axis()
    end = F.col("time") + F.col(DURATION)
    out = events.withColumn("seconds", F.when(end < axis.n, seconds(axis.at(end) - axis.at(F.col("time")))))
    for c in grid.cells:
        if c in events.columns:
            coords = grid.axis(c).withColumnsRenamed({c: "coordinate", f"{c}_index": c})
            out = out.join(coords, c).drop(c).withColumnRenamed("coordinate", c)
    out = out.withColumn("time", axis.at(F.col("time"))).drop(DURATION).withColumnRenamed("seconds", DURATION)
    return out.select(*events.columns)


def event_da(grid: Grid, events: DataFrame, value: str, axis: Axis | None = None) -> Grid:
    """A grid with each event's ``value`` at its first step and nothing elsewhere; values at one place add up."""
    axis = axis or grid.time_axis()
    at = events.select(axis.at(F.col("time")).alias(grid.time), *grid.cells, F.col(value).cast("double").alias(grid.value))
    summed = at.groupBy(*grid.dims).agg(F.sum(grid.value).alias(grid.value))
    return grid.with_df(grid.spine(axis).join(summed, list(grid.dims), "left").select(*grid.dims, grid.value))


def atleastn(grid: Grid, n: int, axis: Axis | None = None) -> Grid:
    """Values in runs of at least ``n`` finite values; others become missing."""
    axis = axis or grid.time_axis()
    ok = finite(F.col(grid.value))
    w = Window.partitionBy(*grid.cells, "ok").orderBy("step")
    rows = grid.df.withColumn("step", axis.index(F.col(grid.time))).withColumn("ok", ok)
    rows = rows.withColumn("island", F.col("step") - F.row_number().over(w))
    size = F.count("*").over(Window.partitionBy(*grid.cells, "ok", "island"))
    return grid.with_df(rows.withColumn(grid.value, F.when(F.col("ok") & (size >= n), F.col(grid.value))).select(*grid.dims, grid.value))


def filter_block(events: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Events whose cells lie in a block, by first and last index of each dimension."""
    for c, (lo, hi) in ranges.items():
        events = events.filter(F.col(c).between(lo, hi))
    return events
