"""Resampling, climatologies, percentiles and validation against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import climatology as C
from gridloom.operators import quantile as Q
from gridloom.operators import resample as R


def series(first, last, freq="D", seed=1):
    t = pd.date_range(first, last, freq=freq)
    return pd.Series(np.random.default_rng(seed).random(len(t)), t)


def grid(spark, *data):
    frame = pd.concat([pd.DataFrame({"time": s.index.astype("datetime64[us]"), "x": k, "value": s.to_numpy()}) for k, s in enumerate(data)])
    return Grid.of(spark.createDataFrame(frame, "time timestamp_ntz, x bigint, value double"), ["time", "x"], "value", "time")


def read(g, x=0):
    f = g.df.filter(F.col("x") == x).orderBy("time").toPandas()
    return pd.Series(f["value"].to_numpy(), f["time"])


HOURLY = series("2002-01-01", "2002-03-31 23:00", "h")
DAILY = series("2002-01-01", "2004-12-31")


@pytest.mark.parametrize("by", [{"time": 24}, {"time": "D"}, {"time": "24h"}])
def test_resample(spark, by):
    got = read(R.blocked_resample(grid(spark, HOURLY), by).mean())
    want = HOURLY.resample("D").mean()
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got, want)


def test_resample_missing(spark):
    s = HOURLY.copy()
    s.iloc[5] = np.nan
    r = R.blocked_resample(grid(spark, s), time=24)
    for op in ("mean", "min", "max", "sum"):
        got = read(getattr(r, op)())
        assert np.isnan(got.iloc[0]) and got.iloc[1:].notna().all()
        np.testing.assert_allclose(got.iloc[1:], getattr(HOURLY.resample("D"), op)().iloc[1:])
    np.testing.assert_allclose(read(r.nanmax()), s.resample("D").max())
    np.testing.assert_allclose(read(r.nanmin()), s.resample("D").min())
    np.testing.assert_allclose(read(r.reduce(lambda v: v.median())), s.resample("D").median())


def test_resample_checks(spark):
    g = grid(spark, DAILY[:24])
    with pytest.raises(ValueError, match="evenly"):
        R.blocked_resample(g, time=7)
    with pytest.raises(ValueError, match="one dimension"):
        R.blocked_resample(g, x=2)
    with pytest.raises(ValueError, match="unknown period"):
        R.blocked_resample(g, time="3parsec")
    with pytest.raises(ValueError, match="irregular"):
        R.blocked_resample(grid(spark, pd.concat([DAILY[:15], DAILY[17:26]])), time=24)


@pytest.mark.parametrize("op", ["mean", "min", "max", "sum"])
@pytest.mark.parametrize("last", ["2003-12-31", "2004-12-31"])
def test_dayofyear(spark, op, last):
    s = DAILY[:last]
    got = getattr(C.blocked_groupby(grid(spark, s, s + 1), time="dayofyear"), op)().df.filter("x = 1").orderBy("dayofyear").toPandas()
    assert list(got["dayofyear"]) == list(range(1, 367))
    want = getattr((s + 1).groupby(s.index.dayofyear), op)()
    np.testing.assert_allclose(got["value"][: len(want)], want)
    if len(want) == 365:
        assert got["value"].iloc[365] == 0 if op == "sum" else np.isnan(got["value"].iloc[365])


@pytest.mark.parametrize("op", ["mean", "max"])
def test_monthday(spark, op):
    got = getattr(C.blocked_groupby(grid(spark, DAILY), time="monthday"), op)().df.orderBy("month", "day").toPandas()
    want = getattr(DAILY.groupby(DAILY.index.month * 100 + DAILY.index.day), op)()
    assert list(got["month"] * 100 + got["day"]) == list(want.index)
    np.testing.assert_allclose(got["value"], want)


def test_percentiles(spark):
    g = C.blocked_groupby(grid(spark, DAILY), time="dayofyear")
    want = DAILY.groupby(DAILY.index.dayofyear).quantile(0.9)
    np.testing.assert_allclose(g.nanpercentile(90).df.orderBy("dayofyear").toPandas()["value"], want)
    full = g.percentile(90).df.orderBy("dayofyear").toPandas()["value"]
    np.testing.assert_allclose(full[:365], want[:365])
    assert np.isnan(full[365])


def test_anomaly(spark):
    g = C.blocked_groupby(grid(spark, DAILY), time="dayofyear")
    key = DAILY.index.dayofyear
    norm = DAILY.groupby(key).mean().reindex(key).to_numpy()
    for got, want in ((g - g.mean(), DAILY - norm), (g + g.mean(), DAILY + norm), (g * g.mean(), DAILY * norm), (g / g.mean(), DAILY / norm)):
        np.testing.assert_allclose(read(got), want)
    with pytest.raises(TypeError):
        g - 1
    with pytest.raises(KeyError):
        g - C.blocked_groupby(grid(spark, DAILY), time="monthday").mean()


def test_rank_block_apply(spark):
    years = pd.Series(DAILY.index.year.astype(float), DAILY.index)
    g = C.blocked_groupby(grid(spark, years), time="monthday")
    ranks = read(g.rank())
    assert set(ranks["2002"]) == {1.0} and set(ranks["2003"]) <= {2.0}
    assert ranks["2004-02-29"].item() == 1.0 and ranks["2004-03-01"].item() == 3.0
    assert g.block().count() == 3 * 366
    np.testing.assert_allclose(read(g.unblock(g.block())), years)
    np.testing.assert_allclose(read(g.apply(lambda t: t - t.mean())).loc["2003-05-05"], 0.0)
    counted = g.reduce(lambda v: v.notna().sum()).df
    assert counted.filter("month = 2 AND day = 29").first()["value"] == 1
    with pytest.raises(ValueError):
        g.rank("best")


@pytest.mark.parametrize("part", [DAILY[1:365], DAILY[:364], pd.concat([DAILY[:15], DAILY[17:365]])])
def test_whole_years_only(spark, part):
    with pytest.raises(ValueError):
        C.blocked_groupby(grid(spark, part), time="dayofyear")
    with pytest.raises(NotImplementedError):
        C.blocked_groupby(grid(spark, DAILY[:365]), time="season")


def test_ties_in_ranks(spark):
    t = pd.to_datetime([f"{y}-01-01" for y in range(2001, 2006)])
    g = Grid.of(spark.createDataFrame(pd.DataFrame({"time": t.astype("datetime64[us]"), "value": [2.0, 1.0, 2.0, np.nan, 3.0]}), "time timestamp_ntz, value double"), ["time"], "value", "time")
    b = C.BlockedGroupby(g, "dayofyear", validate=False)
    want = {"average": [2.5, 1, 2.5, None, 4], "min": [2, 1, 2, None, 4], "max": [3, 1, 3, None, 4], "dense": [2, 1, 2, None, 3], "ordinal": [2, 1, 3, None, 4]}
    for method, ranks in want.items():
        assert [r.value for r in b.rank(method).df.orderBy("time").collect()] == ranks


def test_quantiles(spark):
    x = np.random.default_rng(3).random((500, 10))
    x[0, 2] = np.nan
    data = pd.DataFrame({"time": np.repeat(np.datetime64("2000-01-01", "us") + np.arange(500).astype("timedelta64[D]"), 10), "x": np.tile(np.arange(10), 500), "value": x.ravel()})
    g = Grid.of(spark.createDataFrame(data, "time timestamp_ntz, x bigint, value double"), ["time", "x"], "value", "time")
    exact = Q.percentiles(g, [10, 90], "time", exact=True).orderBy("percentile", "x").toPandas()
    np.testing.assert_allclose(exact["value"], np.nanpercentile(x, [10, 90], axis=0).ravel())
    approx = Q.approx_percentile(g, [10, 90], "time").orderBy("percentile", "x").toPandas()
    np.testing.assert_allclose(approx["value"], exact["value"], rtol=0.1)
    strict = Q.percentiles(g, 50, "time", skipna=False, exact=True).orderBy("x").toPandas()["value"]
    assert np.isnan(strict[2]) and strict.drop(2).notna().all()
    merged = Q.from_sketches(Q.sketch(g, ["x", "time"]), ["x"], [50]).orderBy("x").toPandas()
    np.testing.assert_allclose(merged["value"], np.nanpercentile(x, 50, axis=0), rtol=0.1)
    assert Q.percentiles(g, [5, 95]).count() == 2
    with pytest.raises(ValueError):
        Q.percentiles(g, 101)


def test_grid(spark):
    g = grid(spark, DAILY[:10])
    sparse = g.with_df(g.df.filter(F.day("time") != 4))
    with pytest.raises(ValueError, match="irregular"):
        sparse.time_axis()
    assert sparse.densify(g.time_axis()).df.filter("value IS NULL").count() == 1
    smooth = read(g.smooth(3))
    assert smooth.iloc[[0, -1]].isna().all()
    np.testing.assert_allclose(smooth[1:-1], DAILY[:10].rolling(3, center=True).mean()[1:-1])
    assert g.select(time=(dt.datetime(2002, 1, 3), dt.datetime(2002, 1, 5))).df.count() == 3
    with pytest.raises(ValueError):
        g.smooth(4)
