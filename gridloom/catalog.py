"""Queries that exercise each operator on the driver's tables, with DuckDB SQL beside them.

Series: OD, daily order value by priority, over all years that have orders, NULL
on days without; EH, hourly event value by type, over all days that have events,
NULL in hours without; N5, account balance by nation on a 5 x 5 grid.
"""

from __future__ import annotations

import datetime as dt
import functools
import io
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metadata
from .functions.columns import DAY
from .grid import Axis, Grid
from .operators import blocks, climatology, events, grids, packed, quantile, regrid, resample, weights
from .plans import profiling, report, session
from .sources import netcdf3, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE[name] = sql


# Series


def _axis(first: dt.datetime, step: int, n: int) -> Axis:
    return Axis(F.lit(first).cast("timestamp_ntz"), step, n, first, first + dt.timedelta(seconds=step * (n - 1)))


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


@functools.lru_cache(maxsize=64)
def _span(s: SparkSession, path: str, column: str) -> tuple[dt.datetime, dt.datetime]:
    """First and last time of a table."""
    return tuple(s.read.parquet(path).agg(F.min(_ntz(column)), F.max(_ntz(column))).first())


def od_axis(s: SparkSession, d: str) -> Axis:
    """Whole years, as climatologies need them."""
    first, last = _span(s, f"{d}/orders.parquet", "o_orderdate")
    a = dt.datetime(first.year, 1, 1)
    return _axis(a, DAY, (dt.datetime(last.year + 1, 1, 1) - a).days)


def od(spark: SparkSession, sf: str) -> Grid:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    daily = orders.groupBy(F.col("o_orderpriority").alias("cell"), F.date_trunc("day", _ntz("o_orderdate")).cast("timestamp_ntz").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return Grid.of(daily, ["time", "cell"], "value", "time").densify(od_axis(spark, sf))


def eh_axis(s: SparkSession, d: str) -> Axis:
    """Whole days."""
    first, last = (t.replace(hour=0, minute=0, second=0, microsecond=0) for t in _span(s, f"{d}/events.parquet", "ts"))
    return _axis(first, 3600, 24 * ((last - first).days + 1))


def eh(spark: SparkSession, sf: str) -> Grid:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    hourly = rows.groupBy(F.col("event_type").alias("cell"), F.date_trunc("hour", _ntz("ts")).cast("timestamp_ntz").alias("time")).agg(F.round(F.sum("value"), 4).alias("value"))
    return Grid.of(hourly, ["time", "cell"], "value", "time").densify(eh_axis(spark, sf))


N5_LAT, N5_LON = np.arange(-60.0, 61.0, 30.0), np.arange(0.0, 360.0, 72.0)
T3_LAT, T3_LON = np.array([-45.0, 0.0, 45.0]), np.array([10.0, 130.0, 250.0])


def n5(spark: SparkSession, sf: str) -> DataFrame:
    """(i, j, lat, lon, value), value NULL where a nation has no customers."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("k"))
    balance = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").cast("bigint").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    i, j = F.call_function("div", F.col("k"), F.lit(5)), F.col("k") % 5
    return nation.join(balance, "k", "left").select(i.alias("i"), j.alias("j"), (i * 30.0 - 60.0).alias("lat"), (j * 72.0).alias("lon"), "value")


_OD = """od0 AS (SELECT o_orderpriority AS cell, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL),
ax AS (SELECT CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS a, CAST(date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS b FROM orders),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM ax),
od AS (SELECT c.cell, days.d, od0.v, CAST(date_diff('day', ax.a, days.d) AS BIGINT) AS i FROM (SELECT DISTINCT cell FROM od0) c CROSS JOIN days CROSS JOIN ax LEFT JOIN od0 ON od0.cell = c.cell AND od0.d = days.d)"""
_YEARS = "(SELECT year(b) - year(a) + 1 FROM ax)"
_EH = """eh0 AS (SELECT event_type AS cell, date_trunc('hour', ts) AS h, round(sum(value), 4) AS v FROM events GROUP BY ALL),
ax AS (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS a, CAST(date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS TIMESTAMP) AS b FROM events),
hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM ax),
eh AS (SELECT c.cell, hours.h, eh0.v, CAST(date_diff('hour', ax.a, hours.h) AS BIGINT) AS i FROM (SELECT DISTINCT cell FROM eh0) c CROSS JOIN hours CROSS JOIN ax LEFT JOIN eh0 ON eh0.cell = c.cell AND eh0.h = hours.h)"""
_N5 = """n5 AS (SELECT n_nationkey // 5 AS i, n_nationkey % 5 AS j, -60.0 + 30.0 * (n_nationkey // 5) AS lat, 72.0 * (n_nationkey % 5) AS lon, v AS v, CAST(n_nationkey AS BIGINT) AS src
FROM nation LEFT JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""


def _shown(g: Grid, digits: int = 6) -> DataFrame:
    """cell, time as text, rounded value."""
    return g.df.select("cell", F.date_format(g.time, "yyyy-MM-dd HH:mm:ss").alias("time"), F.round(g.value, digits).alias("value"))


def _scaled(g: Grid, unit: float) -> DataFrame:
    return _shown(g.with_df(g.df.withColumn(g.value, F.col(g.value) / unit)))


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# Resampling

for _op, _agg, _full in (("mean", "avg", True), ("min", "min", True), ("max", "max", True), ("sum", "sum", True), ("nanmin", "min", False), ("nanmax", "max", False)):
    _sql = f"CASE WHEN count(v) = 24 THEN {_agg}(v) END" if _full else f"{_agg}(v)"
    _add(
        f"resample_{_op}",
        lambda s, d, op=_op: _shown(getattr(resample.Resampler(eh(s, d), 24, eh_axis(s, d)), op)()),
        f"WITH {_EH} SELECT cell, {_TIME.format("(SELECT a FROM ax) + INTERVAL 1 DAY * (i // 24)")} AS time, round({_sql}, 6) AS value FROM eh GROUP BY cell, i // 24",
    )
_RESAMPLED = f"WITH {_EH} SELECT cell, {_TIME.format("(SELECT a FROM ax) + INTERVAL 1 HOUR * 6 * (i // 6)")} AS time, round(CASE WHEN count(v) = 6 THEN avg(v) END, 6) AS value FROM eh GROUP BY cell, i // 6"
_add("resample_count", lambda s, d: _shown(resample.blocked_resample(eh(s, d), time=6).mean()), _RESAMPLED)
_add("resample_period", lambda s, d: _shown(resample.blocked_resample(eh(s, d), {"time": "6h"}).mean()), _RESAMPLED)
_add(
    "resample_reduce",
    lambda s, d: _shown(resample.Resampler(eh(s, d), 24, eh_axis(s, d)).reduce(lambda v: v.max() - v.min() if v.notna().any() else 0.0)),
    f"WITH {_EH} SELECT cell, {_TIME.format("(SELECT a FROM ax) + INTERVAL 1 DAY * (i // 24)")} AS time, round(coalesce(max(v) - min(v), 0), 6) AS value FROM eh GROUP BY cell, i // 24",
)

# The same in packed form


def _unpacked(p: packed.Packed) -> DataFrame:
    return p.unpack().select("cell", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("value", 6).alias("value"))


_add("packed_resample_mean", lambda s, d: _unpacked(packed.pack(eh(s, d), eh_axis(s, d)).resample(24)), ORACLE["resample_mean"])
_add("packed_resample_nanmax", lambda s, d: _unpacked(packed.pack(eh(s, d), eh_axis(s, d)).resample(24, "nanmax")), ORACLE["resample_nanmax"])
_add("packed_resample_min", lambda s, d: _unpacked(packed.pack(eh(s, d), eh_axis(s, d)).resample(24, "min")), ORACLE["resample_min"])
_add(
    "packed_find_events",
    lambda s, d: packed.pack(eh(s, d), eh_axis(s, d)).find_events(lambda v: v > 50, 1),
    "WITH " + _EH + ", hit AS (SELECT cell, i, i - row_number() OVER (PARTITION BY cell ORDER BY i) AS g FROM eh WHERE v > 50) SELECT CAST(min(i) AS BIGINT) AS time, cell, CAST(count(*) AS BIGINT) AS event_duration FROM hit GROUP BY cell, g",
)

_add("packed_matrix_resample", lambda s, d: _unpacked(packed.pack(eh(s, d), eh_axis(s, d)).resample_matrix(24)), ORACLE["resample_mean"])
_add("packed_matrix_events", lambda s, d: packed.pack(eh(s, d), eh_axis(s, d)).events_matrix(lambda x: x > 50, 1), ORACLE["packed_find_events"])

# Climatology


@functools.cache
def _slot_sql(grouping: str) -> tuple[str, str, str]:
    """(columns of the slot from d, names, table of all slots)."""
    if grouping == "dayofyear":
        return "CAST(dayofyear(d) AS BIGINT) AS dayofyear", "dayofyear", "SELECT CAST(unnest(range(1, 367)) AS BIGINT) AS dayofyear"
    return "CAST(month(d) AS BIGINT) AS month, CAST(day(d) AS BIGINT) AS day", "month, day", "SELECT CAST(month(x) AS BIGINT) AS month, CAST(day(x) AS BIGINT) AS day FROM (SELECT DATE '2004-01-01' + CAST(unnest(range(366)) AS INTEGER) AS x)"


def _by_slot(grouping: str, agg: str, empty: str = "NULL") -> str:
    cols, names, slots = _slot_sql(grouping)
    using = f"USING (cell, {names})"
    return f"SELECT cell, {names}, round(coalesce(a, {empty}), 6) AS value FROM (SELECT DISTINCT cell FROM od) CROSS JOIN ({slots}) LEFT JOIN (SELECT cell, {cols}, {agg} AS a FROM od GROUP BY ALL) {using}"


def _slots(c: climatology.Climatology) -> DataFrame:
    return c.df.withColumn(c.value, F.round(c.value, 6))


def _grouped(s: SparkSession, d: str, grouping: str = "dayofyear") -> climatology.BlockedGroupby:
    g = climatology.BlockedGroupby(od(s, d), grouping, validate=False)
    g.check(od_axis(s, d))
    return g


for _g, _short in (("dayofyear", "doy"), ("monthday", "monthday")):
    for _op, _agg, _empty in (("mean", "avg(v)", "NULL"), ("min", "min(v)", "NULL"), ("max", "max(v)", "NULL"), ("sum", "sum(v)", "0")):
        _add(f"climatology_{_short}_{_op}", lambda s, d, g=_g, op=_op: _slots(getattr(_grouped(s, d, g), op)()), f"WITH {_OD} {_by_slot(_g, _agg, _empty)}")
    _add(
        f"packed_climatology_{_short}",
        lambda s, d, g=_g: packed.pack(od(s, d), od_axis(s, d)).climatology("mean", g).select("cell", F.posexplode("value").alias("slot", "value")).select("cell", F.col("slot").cast("bigint").alias("slot"), F.round("value", 6).alias("value")),
        f"WITH {_OD} SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY {_slot_sql(_g)[1]}) - 1 AS BIGINT) AS slot, value FROM ({_by_slot(_g, 'avg(v)')})",
    )
    _add(
        f"packed_matrix_climatology_{_short}",
        lambda s, d, g=_g: packed.pack(od(s, d), od_axis(s, d)).climatology_matrix("mean", g).select("cell", F.posexplode("value").alias("slot", "value")).select("cell", F.col("slot").cast("bigint").alias("slot"), F.round("value", 6).alias("value")),
        ORACLE[f"packed_climatology_{_short}"],
    )
_add("climatology_nanpercentile", lambda s, d: _slots(_grouped(s, d).nanpercentile(90)), f"WITH {_OD} {_by_slot('dayofyear', 'quantile_cont(v, 0.9)')}")
_add("climatology_percentile", lambda s, d: _slots(_grouped(s, d, "monthday").percentile(50)), f"WITH {_OD} {_by_slot('monthday', 'CASE WHEN count(v) = ' + _YEARS + ' THEN quantile_cont(v, 0.5) END')}")
_add("climatology_reduce", lambda s, d: _slots(_grouped(s, d).reduce(lambda v: float(v.notna().sum()))), f"WITH {_OD} {_by_slot('dayofyear', 'CAST(count(v) AS DOUBLE)', '0')}")

_RANK_SQL = {
    "average": "rank() OVER w + (count(*) OVER t - 1) / 2.0",
    "min": "rank() OVER w",
    "max": "rank() OVER w + count(*) OVER t - 1",
    "dense": "dense_rank() OVER w",
    "ordinal": "row_number() OVER o",
}
for _m, _sql in _RANK_SQL.items():
    _add(
        f"climatology_rank_{_m}",
        lambda s, d, m=_m: _shown(_grouped(s, d).rank(m)),
        f"WITH {_OD} SELECT cell, {_TIME.format('d')} AS time, CAST(CASE WHEN v IS NOT NULL THEN {_sql} END AS DOUBLE) AS value FROM od "
        "WINDOW w AS (PARTITION BY cell, dayofyear(d), v IS NULL ORDER BY v), t AS (PARTITION BY cell, dayofyear(d), v), o AS (PARTITION BY cell, dayofyear(d), v IS NULL ORDER BY v, year(d))",
    )
# products are shown in units of 1e9, of which a double holds all six decimals
for _op, _sign, _f, _unit in (("sub", "-", lambda g, c: g - c, 1.0), ("add", "+", lambda g, c: g + c, 1.0), ("mul", "*", lambda g, c: g * c, 1e9), ("div", "/", lambda g, c: g / c, 1.0)):
    _add(
        f"anomaly_{_op}",
        lambda s, d, f=_f, unit=_unit: _scaled(f(g := _grouped(s, d, "monthday"), g.mean()), unit),
        f"WITH {_OD}, m AS (SELECT cell, month(d) AS mo, day(d) AS da, avg(v) AS c FROM od GROUP BY ALL) SELECT od.cell, {_TIME.format('d')} AS time, round((v {_sign} c) / {_unit}, 6) AS value FROM od JOIN m ON m.cell = od.cell AND mo = month(d) AND da = day(d)",
    )
_add(
    "block_dataarray",
    lambda s, d: _grouped(s, d).block(),
    f"WITH {_OD} SELECT CAST(y AS BIGINT) AS year, c.cell, CAST(k AS BIGINT) AS dayofyear, v AS value FROM (SELECT DISTINCT cell FROM od) c CROSS JOIN (SELECT unnest(range({_YEARS})) AS y) CROSS JOIN (SELECT unnest(range(1, 367)) AS k) LEFT JOIN od ON od.cell = c.cell AND year(d) = (SELECT year(a) FROM ax) + y AND dayofyear(d) = k",
)
_add("unblock_dataarray", lambda s, d: _shown((g := _grouped(s, d, "monthday")).unblock(g.block())), f"WITH {_OD} SELECT cell, {_TIME.format('d')} AS time, v AS value FROM od")
_add("apply_double", lambda s, d: _shown(_grouped(s, d).apply(lambda t: 2 * t)), f"WITH {_OD} SELECT cell, {_TIME.format('d')} AS time, round(2 * v, 6) AS value FROM od")

# Percentiles

_add(
    "percentile_exact",
    lambda s, d: quantile.percentiles(eh(s, d), [10, 50, 90], "time", exact=True).withColumn("value", F.round("value", 6)),
    f"WITH {_EH} SELECT cell, CAST(p AS DOUBLE) AS percentile, round(q, 6) AS value FROM (SELECT cell, unnest([10, 50, 90]) AS p, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS q FROM eh GROUP BY cell)",
)
_add("percentile_exact_skipna_false", lambda s, d: quantile.percentiles(eh(s, d), 50, "time", skipna=False, exact=True), f"WITH {_EH} SELECT cell, 50.0::DOUBLE AS percentile, CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.5) END AS value FROM eh GROUP BY cell")
_add("percentile_approx", lambda s, d: quantile.approx_percentile(eh(s, d), [10, 50, 90], "time"))
_add("percentile_sketch", lambda s, d: quantile.from_sketches(quantile.sketch(eh(s, d), ["cell", "time"]), ["cell"], [10, 50, 90]))

# Events: hours or days whose value exceeds a threshold

_EV = """hit AS (SELECT cell, i, v, i - row_number() OVER (PARTITION BY cell ORDER BY i) AS g FROM {view} WHERE v > {thr}),
ev AS (SELECT CAST(min(i) AS BIGINT) AS time, cell, CAST(count(*) AS BIGINT) AS event_duration, sum(v) AS s, avg(v) AS m, max(v) AS x FROM hit GROUP BY cell, g HAVING count(*) >= {n})"""
_THR = 200000.0
_EVOD = f"WITH {_OD}, {_EV.format(view='od', thr=_THR, n=2)}"


def _events(s: SparkSession, d: str, n: int = 2) -> tuple[Grid, DataFrame]:
    g = od(s, d)
    return g, events.find_events(g, lambda v: v > _THR, n, od_axis(s, d))


_add("find_events", lambda s, d: events.find_events(eh(s, d), lambda v: v > 50, 1, eh_axis(s, d)), f"WITH {_EH}, {_EV.format(view='eh', thr=50, n=1)} SELECT time, cell, event_duration FROM ev")
_add("find_events_min3", lambda s, d: events.find_events(eh(s, d), F.col("value") > 50, 3, eh_axis(s, d)), f"WITH {_EH}, {_EV.format(view='eh', thr=50, n=3)} SELECT time, cell, event_duration FROM ev")
_CELL = "(SELECT DISTINCT cell, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS BIGINT) AS k FROM od)"
_add("find_events_indexed", lambda s, d: events.find_events(events.indexed(od(s, d)), lambda v: v > _THR, 2, od_axis(s, d)), f"{_EVOD} SELECT time, k AS cell, event_duration FROM ev JOIN {_CELL} c USING (cell)")
_add("event_ids", lambda s, d: events.with_event_id(_events(s, d)[1]), f"{_EVOD} SELECT time, cell, event_duration, CAST(row_number() OVER (ORDER BY time + event_duration, cell) - 1 AS BIGINT) AS event_id FROM ev")
_add("extend_events", lambda s, d: events.extend_events(_events(s, d)[1].withColumn("event", F.col("time"))), f"{_EVOD} SELECT CAST(unnest(range(time, time + event_duration)) AS BIGINT) AS time, cell, time AS event FROM ev")
_add("event_values", lambda s, d: (lambda g, e: events.event_values(g, e.withColumn("event", F.col("time")), od_axis(s, d)))(*_events(s, d)), f"{_EVOD} SELECT od.i AS time, ev.cell, ev.time AS event, v AS value FROM ev JOIN od ON od.cell = ev.cell AND i >= time AND i < time + event_duration")
_add(
    "event_values_stats",
    lambda s, d: (lambda g, e: events.event_stats(g, e, od_axis(s, d), total=F.round(F.sum("value"), 2), mean=F.round(F.avg("value"), 4), largest=F.max("value")))(*_events(s, d)),
    f"{_EVOD} SELECT time, cell, event_duration, round(s, 2) AS total, round(m, 4) AS mean, x AS largest FROM ev",
)
_add(
    "event_summary",
    lambda s, d: events.event_summary(od(s, d), lambda v: v > _THR, 2, od_axis(s, d), total=F.round(F.sum("value"), 2), mean=F.round(F.avg("value"), 4), largest=F.max("value")),
    ORACLE["event_values_stats"],
)
_add(
    "map_events",
    lambda s, d: (lambda g, e: events.map_events(g, e, lambda v: {"first": v.iloc[0], "largest": v.max()}, "first double, largest double", od_axis(s, d)))(*_events(s, d)),
    f"{_EVOD} SELECT ev.time, ev.cell, event_duration, od.v AS first, x AS largest FROM ev JOIN od ON od.cell = ev.cell AND od.i = ev.time",
)
_add(
    "event_coords",
    lambda s, d: (lambda g, e: events.event_coords(g.with_df(g.df, dims=("time",)), e, od_axis(s, d)).withColumns({"time": F.date_format("time", "yyyy-MM-dd"), "event_duration": F.coalesce("event_duration", F.lit(-1).cast("bigint"))}))(*_events(s, d)),
    f"{_EVOD} SELECT strftime((SELECT a FROM ax) + CAST(time AS INTEGER), '%Y-%m-%d') AS time, cell, CASE WHEN time + event_duration < (SELECT count(*) FROM days) THEN event_duration * 86400 ELSE -1 END AS event_duration FROM ev",
)
_add(
    "event_da",
    lambda s, d: (lambda g, e: _shown(events.event_da(g, e, "event_duration", od_axis(s, d))))(*_events(s, d)),
    f"{_EVOD} SELECT od.cell, {_TIME.format('d')} AS time, CAST(event_duration AS DOUBLE) AS value FROM od LEFT JOIN ev ON ev.cell = od.cell AND ev.time = od.i",
)
_add(
    "atleastn",
    lambda s, d: _shown(events.atleastn(od(s, d), 3, od_axis(s, d))),
    f"WITH {_OD}, r AS (SELECT *, i - row_number() OVER (PARTITION BY cell, v IS NULL ORDER BY i) AS g FROM od) SELECT cell, {_TIME.format('d')} AS time, CASE WHEN count(*) OVER (PARTITION BY cell, v IS NULL, g) >= 3 THEN v END AS value FROM r",
)


def _joined(s: SparkSession, d: str) -> DataFrame:
    g = od(s, d)
    rows = events.steps(g.with_df(g.df.filter(F.col("value") > _THR)), od_axis(s, d))
    n = od_axis(s, d).n
    found = [events.find_events_block(rows, ["cell"], a, min(a + 99, n - 1), 2) for a in range(0, n, 100)]
    return events.join_events(found, ["cell"], 2)


_add("join_events", _joined, f"{_EVOD} SELECT time, cell, event_duration FROM ev")
_add(
    "rolling_mean_centered",
    lambda s, d: _shown(od(s, d).smooth(15)),
    f"WITH {_OD} SELECT cell, {_TIME.format('d')} AS time, round(CASE WHEN count(v) OVER w = 15 THEN avg(v) OVER w END, 6) AS value FROM od WINDOW w AS (PARTITION BY cell ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)",
)
_add("select_range", lambda s, d: _shown(od(s, d).select(time=(dt.datetime(1996, 2, 28), dt.datetime(1996, 3, 1)))), f"WITH {_OD} SELECT cell, {_TIME.format('d')} AS time, v AS value FROM od WHERE d BETWEEN DATE '1996-02-28' AND DATE '1996-03-01'")


def heatwave(s: SparkSession, d: str) -> DataFrame:
    """Runs of two days or more above the 90th percentile of their day of the year, with their excess."""
    g = _grouped(s, d)
    excess = g - g.nanpercentile(90)
    return events.event_summary(excess, lambda v: v > 0, 2, od_axis(s, d), total=F.round(F.sum("value"), 4), largest=F.round(F.max("value"), 4))


_add(
    "threshold_events_climatology",
    heatwave,
    f"WITH {_OD}, thr AS (SELECT cell, dayofyear(d) AS k, quantile_cont(v, 0.9) AS q FROM od GROUP BY ALL), an AS (SELECT od.cell, od.i, v - q AS v FROM od JOIN thr ON thr.cell = od.cell AND k = dayofyear(d)), "
    f"{_EV.format(view='an', thr=0, n=2)} SELECT time, cell, event_duration, round(s, 4) AS total, round(x, 4) AS largest FROM ev",
)

# Regridding

_W = [(k, dst, 0.25 * (1 + (k + dst) % 3)) for dst in range(9) for k in range(25) if (k * 7 + dst) % 5 == 0]
_W_SQL = "wt(src, dst, w) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in _W) + ")"


def _t3(mask: np.ndarray | None = None) -> grids.LonLatGrid:
    return grids.LonLatGrid(T3_LAT, T3_LON, mask)


def _n5_grid(mask: np.ndarray | None = None) -> grids.LonLatGrid:
    return grids.LonLatGrid(N5_LAT, N5_LON, mask)


def _regridded(s: SparkSession, d: str, mask: np.ndarray | None, missing: str, hole: bool) -> DataFrame:
    source = n5(s, d).select((F.col("i") * 5 + F.col("j")).alias("src"), F.when(F.lit(hole) & (F.col("j") == 2), None).otherwise(F.col("value")).alias("value"))
    wt = regrid.Weights(s.createDataFrame(_W, "src bigint, dst bigint, w double"), _t3(mask).cells(s))
    return regrid.apply_weights(source, wt, ["value"], missing=missing).select("dst", "lat", "lon", F.round("value", 4).alias("value"))


_T3_SQL = "t3 AS (SELECT CAST(k AS BIGINT) AS dst, [-45.0, 0.0, 45.0][1 + k // 3]::DOUBLE AS lat, [10.0, 130.0, 250.0][1 + k % 3]::DOUBLE AS lon FROM (SELECT unnest(range(9)) AS k))"
_REGRID_SQL = f"WITH {_N5}, {_W_SQL}, {_T3_SQL} SELECT t3.dst, lat, lon, {{shown}} AS value FROM t3 LEFT JOIN (SELECT dst, {{agg}} AS a FROM wt JOIN (SELECT src, {{v}} AS v FROM n5) n USING (src) GROUP BY dst) USING (dst)"
_NULLS = "CASE WHEN count(v) = count(*) THEN sum(w * v) END"
_HOLE = "CASE WHEN j <> 2 THEN v END"
_MASK = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]])
_add("regrid_apply", lambda s, d: _regridded(s, d, None, "null", False), _REGRID_SQL.format(shown="round(a, 4)", agg=_NULLS, v="v"))
_add("regrid_masked", lambda s, d: _regridded(s, d, _MASK, "null", True), _REGRID_SQL.format(shown="CASE WHEN dst NOT IN (2, 6) THEN round(a, 4) END", agg=_NULLS, v=_HOLE))
_add("regrid_renormalize", lambda s, d: _regridded(s, d, None, "renormalize", True), _REGRID_SQL.format(shown="round(a, 4)", agg="sum(w * v) * sum(w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0)", v=_HOLE))


def _weights(s: SparkSession, method: str, **options) -> DataFrame:
    return weights.generate(s, _n5_grid(), _t3(), method, **options).select("src", "dst", F.round("w", 9).alias("w"))


_GRIDS = "s5 AS (SELECT CAST(k AS BIGINT) AS src, -60.0 + 30 * (k // 5) AS la, 72.0 * (k % 5) AS lo FROM (SELECT unnest(range(25)) AS k)), " + _T3_SQL
_PAIRS = f"{_GRIDS}, h AS (SELECT src, dst, round(2 * asin(sqrt(least(1.0, pow(sin(radians(la - lat) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lo - lon) / 2), 2)))), 12) AS r FROM s5 CROSS JOIN t3)"
_add("weights_nearest", lambda s, d: _weights(s, "nn"), f"WITH {_PAIRS} SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY r, src) AS k FROM h) WHERE k = 1")
_add("weights_distance", lambda s, d: _weights(s, "dis"), f"WITH {_PAIRS}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY r, src) AS k FROM h) WHERE k <= 4) SELECT src, dst, round((1 / r) / sum(1 / r) OVER (PARTITION BY dst), 9) AS w FROM n")
_BIL = f"{_GRIDS}, a AS (SELECT src, dst, greatest(0, 1 - abs(la - lat) / 30) AS wy, greatest(0, 1 - least(abs(lo - lon), 360 - abs(lo - lon)) / 72) AS wx FROM s5 CROSS JOIN t3)"
_add("weights_bilinear", lambda s, d: _weights(s, "bil"), f"WITH {_BIL} SELECT src, dst, round(wy * wx, 9) AS w FROM a WHERE wy * wx > 1e-12")
_AREA = f"""{_GRIDS}, b AS (SELECT src, dst,
 sin(radians(least(CASE WHEN la = 60 THEN 90 ELSE la + 15 END, CASE WHEN lat = 45 THEN 90 ELSE lat + 22.5 END))) - sin(radians(greatest(CASE WHEN la = -60 THEN -90 ELSE la - 15 END, CASE WHEN lat = -45 THEN -90 ELSE lat - 22.5 END))) AS hy,
 greatest(0, least(lo + 36, lon + 60) - greatest(lo - 36, lon - 60)) + greatest(0, least(lo + 396, lon + 60) - greatest(lo + 324, lon - 60)) + greatest(0, least(lo - 324, lon + 60) - greatest(lo - 396, lon - 60)) AS wx FROM s5 CROSS JOIN t3),
 ar AS (SELECT src, dst, hy * wx AS x FROM b WHERE hy > 1e-12 AND wx > 1e-9)"""
_CON = f"WITH {_AREA} SELECT src, dst, round(x / sum(x) OVER (PARTITION BY dst), 9) AS w FROM ar"
_add("weights_conservative", lambda s, d: _weights(s, "con"), _CON)
_add("weights_ycon_destarea", lambda s, d: _weights(s, "ycon", remap_norm="destarea"), _CON)
_add("weights_largest_area", lambda s, d: _weights(s, "laf"), f"WITH {_AREA} SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(x, 9) DESC, src) AS k FROM ar) WHERE k = 1")
_add("weights_bicubic", lambda s, d: _weights(s, "bic"))
_add(
    "regrid_bilinear",
    lambda s, d: regrid.regrid(n5(s, d).select("lat", "lon", "value"), ["value"], _t3()).select("lat", "lon", F.round("value", 4).alias("value")),
    f"WITH {_N5}, {_BIL} SELECT t3.lat, t3.lon, round(CASE WHEN count(n5.v) = count(*) THEN sum(wy * wx * n5.v) END, 4) AS value FROM a JOIN t3 USING (dst) JOIN n5 ON n5.src = a.src WHERE wy * wx > 1e-12 GROUP BY t3.lat, t3.lon",
)

# Grids and metadata

_add(
    "grid_to_scrip",
    lambda s, d: _n5_grid().to_scrip(s).df.select("dst", "lat", "lon", "mask", F.concat_ws(",", F.transform("corner_lat", lambda x: x.cast("decimal(9,2)").cast("string"))).alias("corner_lat"), F.concat_ws(",", F.transform("corner_lon", lambda x: x.cast("decimal(9,2)").cast("string"))).alias("corner_lon")),
    """WITH g AS (SELECT CAST(k AS BIGINT) AS dst, (-60.0 + 30 * (k // 5))::DOUBLE AS lat, (72.0 * (k % 5))::DOUBLE AS lon FROM (SELECT unnest(range(25)) AS k)),
    c AS (SELECT *, CAST(CASE WHEN lat = -60 THEN -90 ELSE lat - 15 END AS DECIMAL(9,2)) AS lo, CAST(CASE WHEN lat = 60 THEN 90 ELSE lat + 15 END AS DECIMAL(9,2)) AS hi, CAST(lon - 36 AS DECIMAL(9,2)) AS le, CAST(lon + 36 AS DECIMAL(9,2)) AS ri FROM g)
    SELECT dst, lat, lon, 1 AS mask, concat_ws(',', lo, lo, hi, hi) AS corner_lat, concat_ws(',', le, ri, ri, le) AS corner_lon FROM c""",
)
_add("grid_cells", lambda s, d: _t3(_MASK).cells(s).select("dst", "lat", "lon", "mask"), f"WITH {_T3_SQL} SELECT dst, lat, lon, CASE WHEN dst IN (2, 6) THEN 0 ELSE 1 END AS mask FROM t3")
_add("remove_degenerate_axes", lambda s, d: metadata.remove_degenerate_axes(n5(s, d), "i", "j", "lat"), f"WITH {_N5} SELECT CAST(i AS BIGINT) AS i, CAST(avg(lat) AS DOUBLE) AS lat FROM n5 GROUP BY i")


def _cf(s: SparkSession, d: str) -> DataFrame:
    df = metadata.with_metadata(n5(s, d).withColumnsRenamed({"lat": "y", "lon": "x"}), {"y": {"units": "degrees_north"}, "x": {"standard_name": "longitude"}})
    lat, lon = metadata.identify_lat_lon(df)
    grid = grids.identify_grid(df)
    text = io.BytesIO()
    grid.to_cdo_grid(text)
    return df.agg(F.lit(lat).alias("lat_column"), F.lit(lon).alias("lon_column"), F.countDistinct(lat).alias("n_lat"), F.countDistinct(lon).alias("n_lon"), F.lit(text.getvalue().decode().count("\n")).cast("bigint").alias("lines"))


_add("identify_grid", _cf, f"WITH {_N5} SELECT 'y' AS lat_column, 'x' AS lon_column, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, CAST(5 AS BIGINT) AS lines FROM n5")

# Sources, sinks, blocks and plans

_add(
    "series_split_bounds",
    lambda s, d: tables.series_bounds(od(s, d).df.filter(F.col("value").isNotNull()), "time.year").select(F.col("group").cast("bigint").alias("year"), F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end")),
    f"WITH {_OD} SELECT CAST(year(d) AS BIGINT) AS year, strftime(min(d), '%Y-%m-%d') AS start, strftime(max(d), '%Y-%m-%d') AS \"end\" FROM od WHERE v IS NOT NULL GROUP BY 1",
)


def _block_sums(rows):
    return rows.groupby(["block", "cell"], as_index=False).agg(n=("value", "count"), total=("value", "sum")).assign(total=lambda t: t["total"].round(4))[["block", "cell", "n", "total"]]


_add(
    "block_map",
    lambda s, d: blocks.map_blocks(blocks.time_blocks(eh(s, d), 24), ["block"], _block_sums, "block bigint, cell string, n bigint, total double"),
    f"WITH {_EH} SELECT i // 24 AS block, cell, count(v) AS n, round(coalesce(sum(v), 0), 4) AS total FROM eh GROUP BY ALL",
)
_add(
    "multi_file_scan",
    lambda s, d: tables.scan(s, [f"{d}/nation.parquet", f"{d}/nation.parquet"]).groupBy("n_regionkey").agg(F.count("*").alias("n")),
    "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY 1",
)
_add(
    "plan_report",
    lambda s, d: s.createDataFrame([(int(report.exchanges(events.find_events(od(s, d), lambda v: v > _THR, 2, od_axis(s, d)))) > 0, report.graph_size(od(s, d).df) > 0)], "shuffles boolean, operators boolean"),
    "SELECT true AS shuffles, true AS operators",
)


# Checks, weight files, files and reports


def _scratch(s: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; only a local session without one gets a folder of its own."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and not s.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='gridloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_add("groupby_checked", lambda s, d: _slots(climatology.blocked_groupby(od(s, d), time="dayofyear").mean()), ORACLE["climatology_doy_mean"])


def _refused(f: Callable[[], object]) -> bool:
    try:
        f()
    except (ValueError, NotImplementedError):
        return True
    return False


def _axis_checks(s: SparkSession, d: str) -> DataFrame:
    g = od(s, d)
    some = lambda keep: g.with_df(g.df.filter(keep))
    day = F.date_format(g.time, "MM-dd")
    cases = {
        "daily whole years": lambda: climatology.blocked_groupby(g, time="monthday"),
        "hourly": lambda: climatology.blocked_groupby(eh(s, d), time="dayofyear"),
        "late start": lambda: climatology.blocked_groupby(some(F.col("time") > F.lit(od_axis(s, d).first)), time="dayofyear"),
        "early end": lambda: climatology.blocked_groupby(some(F.col("time") < F.lit(od_axis(s, d).last)), time="dayofyear"),
        "gap": lambda: climatology.blocked_groupby(some(day != "03-05"), time="dayofyear"),
        "by week": lambda: climatology.blocked_groupby(g, time="week"),
        "uneven count": lambda: resample.blocked_resample(eh(s, d), time=7 * eh_axis(s, d).n),
    }
    return s.createDataFrame([(k, _refused(f)) for k, f in cases.items()], "case string, refused boolean")


_add("groupby_checks", _axis_checks, "SELECT * FROM (VALUES ('daily whole years', false), ('hourly', true), ('late start', true), ('early end', true), ('gap', true), ('by week', true), ('uneven count', true)) t(\"case\", refused)")


def _from_file(s: SparkSession, d: str, dialect: str) -> DataFrame:
    """Weights that were written as a weight file's tables and read again."""
    cells = [(i * 3 + j, float(la), float(lo), 1) for i, la in enumerate(T3_LAT) for j, lo in enumerate(T3_LON)]
    links, grid = _scratch(s, "links"), _scratch(s, "cells")
    if dialect == "esmf":
        s.createDataFrame([(src + 1, dst + 1, w) for src, dst, w in _W], "col int, row int, S double").write.parquet(links)
        s.createDataFrame(cells, "cell bigint, yc_b double, xc_b double, mask_b int").write.parquet(grid)
        wt = regrid.Weights.from_esmf(s.read.parquet(links), s.read.parquet(grid), 3)
    else:
        s.createDataFrame([(src + 1, dst + 1, [w, 0.0, 0.0]) for src, dst, w in _W], "src_address int, dst_address int, remap_matrix array<double>").write.parquet(links)
        s.createDataFrame([(k, float(np.radians(a)), float(np.radians(b)), m) for k, a, b, m in cells], "cell bigint, dst_grid_center_lat double, dst_grid_center_lon double, dst_grid_imask int").write.parquet(grid)
        wt = regrid.Weights.from_scrip(s.read.parquet(links), s.read.parquet(grid), 3)
    source = n5(s, d).select((F.col("i") * 5 + F.col("j")).alias("src"), "value")
    return regrid.apply_weights(source, wt, ["value"]).select("dst", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("value", 4).alias("value"))


_add("weights_file_esmf", lambda s, d: _from_file(s, d, "esmf"), ORACLE["regrid_apply"])
_add("weights_file_scrip", lambda s, d: _from_file(s, d, "scrip"), ORACLE["regrid_apply"])


def _many(s: SparkSession, d: str) -> DataFrame:
    """Two variables of several frames through one aggregation."""
    months = n5(s, d).select("lat", "lon", "value", (F.col("value") / 2).alias("half"), F.explode(F.array(F.lit(1), F.lit(2))).alias("month"))
    return regrid.Regridder(_n5_grid(), _t3()).regrid(months, ["value", "half"]).select("month", "lat", "lon", F.round("value", 4).alias("value"), F.round("half", 4).alias("half"))


_add("regrid_many", _many, f"SELECT CAST(m AS INTEGER) AS month, lat, lon, value, half FROM (VALUES (1), (2)) t(m) CROSS JOIN (WITH {_N5}, {_BIL} SELECT t3.lat, t3.lon, round(CASE WHEN count(n5.v) = count(*) THEN sum(wy * wx * n5.v) END, 4) AS value, round(CASE WHEN count(n5.v) = count(*) THEN sum(wy * wx * n5.v / 2) END, 4) AS half FROM a JOIN t3 USING (dst) JOIN n5 ON n5.src = a.src WHERE wy * wx > 1e-12 GROUP BY t3.lat, t3.lon)")
_add(
    "grid_um_header",
    lambda s, d: grids.um_grid(s, 4, 3, 10.0, 20.0, -30.0, 15.0, np.array([[0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 5]])).cells(s),
    "SELECT CAST(k AS BIGINT) AS dst, CAST(k // 4 AS BIGINT) AS i, CAST(k % 4 AS BIGINT) AS j, -30.0::DOUBLE + 15 * (k // 4 + 1) AS lat, 10.0::DOUBLE + 20 * (k % 4 + 1) AS lon, CASE WHEN k IN (1, 11) THEN 0 ELSE 1 END AS mask FROM (SELECT unnest(range(12)) AS k)",
)


def _scrip_file(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s, "scrip")
    _t3(_MASK).to_scrip(s).write(path)
    return grids.identify_grid(s.read.parquet(path)).cells(s).select("dst", "lat", "lon", "mask")


_add("grid_scrip_file", _scrip_file, ORACLE["grid_cells"])


def _written(s: SparkSession, write: Callable[[str], object]) -> DataFrame:
    path = _scratch(s, "written")
    write(path)
    return s.read.parquet(path)


_add("write_throttled", lambda s, d: _written(s, lambda p: tables.write_throttled(s.read.parquet(f"{d}/nation.parquet"), p, 4, 2)).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")
_add("throttled_compute", lambda s, d: blocks.throttled(s.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n")), 2, _scratch(s, "throttled")), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
_add(
    "write_encoding",
    lambda s, d: s.createDataFrame(sorted(tables.encoding(n5(s, d).select("i", "value"), 5, {"maxRecordsPerFile": 10, "other": 1}).items()), "name string, setting string"),
    "SELECT * FROM (VALUES ('compression', 'zstd'), ('parquet.compression.codec.zstd.level', '5'), ('parquet.enable.dictionary#value', 'false'), ('maxRecordsPerFile', '10')) t(name, setting)",
)
_YEARLY = f"WITH {_OD} SELECT CAST(year(d) AS BIGINT) AS year, count(*) AS n, round(sum(v), 2) AS total FROM od WHERE v IS NOT NULL GROUP BY 1"


def _yearly(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("time").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _series_files(s: SparkSession, d: str) -> DataFrame:
    """A file per year by name, each read by itself."""
    paths = tables.write_series(od(s, d).df.filter(F.col("value").isNotNull()), _scratch(s, "series") + "/{start:%Y%m%d}-{end:%Y%m%d}", "time.year")
    first, *rest = [_yearly(s.read.parquet(p)) for p in paths]
    return functools.reduce(DataFrame.union, rest, first)


_add("write_series", _series_files, _YEARLY)
_add("write_partitioned", lambda s, d: _yearly(_written(s, lambda p: tables.write_partitioned(od(s, d).df.filter(F.col("value").isNotNull()), p, "time.year"))), _YEARLY)


def _netcdf(s: SparkSession, d: str) -> DataFrame:
    """Latitude bands written as NetCDF files by the executors and read as one frame; missing values by _FillValue."""
    folder = _scratch(s, "netcdf").removeprefix("file://")
    files = netcdf3.write_series(n5(s, d), folder + "/band{group}.nc", ["lat", "lon"], "value", "i")
    return netcdf3.scan(s, sorted(f.path for f in files), "value")


_add("netcdf_files", _netcdf, f"WITH {_N5} SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, v AS value FROM n5")
_add("identify_time", lambda s, d: s.createDataFrame([(metadata.identify_time(od(s, d).df), metadata.identify_time(metadata.with_metadata(n5(s, d), {"lat": {"axis": "T"}})))], "by_type string, by_axis string"), "SELECT 'time' AS by_type, 'lat' AS by_axis")
_add("filter_block", lambda s, d: events.filter_block(events.find_events(events.indexed(od(s, d)), lambda v: v > _THR, 2, od_axis(s, d)), cell=(1, 2), time=(0, 999)), f"{_EVOD} SELECT time, k AS cell, event_duration FROM ev JOIN {_CELL} c USING (cell) WHERE k BETWEEN 1 AND 2 AND time <= 999")


def _near(s: SparkSession, d: str, got: DataFrame, tolerance: float) -> DataFrame:
    """Whether each percentile's rank among its cell's values is within a tolerance of what it should be."""
    v = eh(s, d).df.filter(F.col("value").isNotNull()).select("cell", F.col("value").alias("x"))
    ranks = got.join(v, "cell").groupBy("cell", "percentile", "value").agg(F.avg((F.col("x") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("value")).cast("double")).alias("upto"), F.count("*").alias("n"))
    slack = F.lit(tolerance) + 1 / F.col("n")
    return ranks.select("cell", "percentile", ((F.col("below") <= F.col("percentile") / 100 + slack) & (F.col("upto") >= F.col("percentile") / 100 - slack)).alias("near"))


_NEAR = "SELECT cell, CAST(p AS DOUBLE) AS percentile, true AS near FROM (SELECT DISTINCT event_type AS cell FROM events WHERE value IS NOT NULL) CROSS JOIN (VALUES (10), (50), (90)) t(p)"
_add("percentile_approx_error", lambda s, d: _near(s, d, quantile.approx_percentile(eh(s, d), [10, 50, 90], "time"), 1e-4), _NEAR)
_add("percentile_sketch_error", lambda s, d: _near(s, d, quantile.from_sketches(quantile.sketch(eh(s, d), ["cell", "time"]), ["cell"], [10, 50, 90]), 0.03), _NEAR)
_add("weights_con2", lambda s, d: _weights(s, "con2"), _CON)
# of a smooth field the four-point weights of either axis keep constants and, away from the ends, straight lines
_add(
    "weights_bicubic_moments",
    lambda s, d: weights.generate(s, _n5_grid(), _t3(), "bic").join(_n5_grid().cells(s).select(F.col("dst").alias("src"), "lat"), "src").groupBy("dst").agg(F.round(F.sum("w"), 6).alias("total"), F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("lat")), 6).alias("mean_lat")).filter("dst BETWEEN 3 AND 5").select("dst", "total", "mean_lat"),
    f"WITH {_T3_SQL} SELECT dst, 1.0::DOUBLE AS total, lat AS mean_lat FROM t3 WHERE dst BETWEEN 3 AND 5",
)


def _reports(s: SparkSession, d: str) -> DataFrame:
    df = events.find_events(od(s, d), lambda v: v > _THR, 2, od_axis(s, d))
    text = report.report(df)
    n, size = report.chunk_count(df), report.chunk_size(df)
    return s.createDataFrame([(n > 0, size > 0, f"partitions {n}, bytes per partition {size}" in text, "Exchange" in report.explain(df) and "sizeInBytes" in report.explain(df, "cost"))], "partitions boolean, size boolean, report boolean, explained boolean")


_add("plan_details", _reports, "SELECT true AS partitions, true AS size, true AS report, true AS explained")


def _profiled(s: SparkSession, d: str) -> DataFrame:
    read = lambda x: x.read.parquet(f"{d}/orders.parquet")
    count = lambda df: df.groupBy("o_orderpriority").count()
    once = profiling.profile_once(s, read, count)
    best = profiling.profile(s, read, count, 2)
    before = s.conf.get("spark.sql.shuffle.partitions")
    bench = profiling.benchmark(s, read, count, [{"spark.sql.shuffle.partitions": 2}, {"spark.sql.shuffle.partitions": 3}], 1)
    timer, facts = profiling.Timer(s), profiling.cluster(s)
    for mark in ("load", "load", "write", "write"):
        timer.mark(mark)
    path = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "times.csv")
    timer.record(path, run=1)
    timer.record(path, run=2)
    lines = Path(path).read_text().splitlines()
    shutil.rmtree(os.path.dirname(path))
    ok = lambda t: t["time_total"] >= t["time_load"] > 0 and t["operators_out"] > t["operators_in"] > 0
    return s.createDataFrame([(ok(once), ok(best) and best["median_time_load"] >= best["time_load"], len(bench) == 2 and s.conf.get("spark.sql.shuffle.partitions") == before, lines[0] == ",".join(["run", *facts, "total", "load", "write"]) and len(lines) == 3 and facts["slots"] == s.sparkContext.defaultParallelism)], "once boolean, least boolean, settings boolean, timer boolean")


_add("profile_runs", _profiled, "SELECT true AS once, true AS least, true AS settings, true AS timer")
_add("session_defaults", lambda s, d: s.createDataFrame([(session.session().sparkContext.applicationId == s.sparkContext.applicationId, s.conf.get("spark.sql.adaptive.enabled"), s.conf.get("spark.sql.session.timeZone"))], "running boolean, adaptive string, zone string"), "SELECT true AS running, 'true' AS adaptive, 'UTC' AS zone")
