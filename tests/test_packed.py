import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import climatology as C
from gridloom.operators import events as E
from gridloom.operators import packed as P
from gridloom.operators import resample as R
from gridloom.plans import report


@pytest.fixture(scope="module")
def grid(spark):
    t = pd.date_range("2003-01-01", "2004-12-31", freq="D").astype("datetime64[us]")
    rng = np.random.default_rng(4)
    rows = pd.concat([pd.DataFrame({"time": t, "x": x, "value": np.where(rng.random(len(t)) < 0.05 * x, np.nan, rng.random(len(t)))}) for x in range(3)])
    rows = rows[(rows["x"] != 2) | (rows["time"] != pd.Timestamp("2003-05-05"))]
    return Grid.of(spark.createDataFrame(rows, "time timestamp_ntz, x bigint, value double"), ["time", "x"], "value", "time")


@pytest.fixture(scope="module")
def stored(spark, grid, tmp_path_factory):
    p = P.pack(grid)
    path = str(tmp_path_factory.mktemp("packed") / "p")
    p.df.write.parquet(path)
    return P.Packed(spark.read.parquet(path), p.cells, p.axis, p.value)


def rows(df):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_round_trip(grid, stored):
    assert rows(stored.unpack().select("time", "x", "value")) == rows(grid.densify().df.select("time", "x", "value"))


@pytest.mark.parametrize("op", P.OPS)
def test_resample(grid, stored, op):
    dense = grid.densify()
    want = getattr(R.blocked_resample(dense, time=17), op)().df
    key = lambda d: sorted(map(str, rows(d.select("time", "x", "value"))))
    assert key(stored.resample(17, op).unpack()) == key(want) == key(stored.resample_matrix(17, op).unpack())


@pytest.mark.parametrize("grouping", ["dayofyear", "monthday"])
@pytest.mark.parametrize("op", ["mean", "min", "max", "sum"])
def test_climatology(grid, stored, op, grouping):
    slot = ["dayofyear"] if grouping == "dayofyear" else ["month", "day"]
    b = C.BlockedGroupby(grid.densify(), grouping)
    want = getattr(b, op)().df.orderBy("x", *slot).toPandas()["value"].to_numpy()
    for made in (stored.climatology(op, grouping), stored.climatology_matrix(op, grouping)):
        got = np.concatenate([np.array(r.value, float) for r in made.orderBy("x").collect()])
        np.testing.assert_allclose(got, want)


def test_events_without_shuffle(grid, stored):
    holds = lambda v: v > 0.4
    assert rows(stored.find_events(holds, 2).select("time", "x", "event_duration")) == rows(E.find_events(grid, holds, 2, stored.axis).select("time", "x", "event_duration"))
    assert report.exchanges(stored.find_events(holds, 2)) == report.exchanges(stored.resample(17).df) == 0


def test_summary(grid, stored):
    got = E.event_summary(grid, lambda v: v > 0.4, 2, stored.axis, largest=F.max("value"))
    want = E.event_stats(grid, E.find_events(grid, lambda v: v > 0.4, 2, stored.axis), stored.axis, largest=F.max("value"))
    cols = ["time", "x", "event_duration", "largest"]
    assert rows(got.select(cols)) == rows(want.select(cols))


def test_checks(stored):
    with pytest.raises(ValueError):
        stored.resample(50)
    with pytest.raises(ValueError):
        stored.resample(17, "median")
    with pytest.raises(ValueError):
        stored.climatology("median")
    assert stored.resample(17).axis.last == dt.datetime(2003, 1, 1) + dt.timedelta(days=17 * 42)


def test_matrix_of_few_rows_at_a_time(grid, stored, monkeypatch):
    """Runs of rows, cells without a name and missing values don't matter; nothing is shuffled."""
    monkeypatch.setattr(P, "ROWS", 1)
    want = rows(stored.find_events(lambda v: v > 0.4, 2).select("time", "x", "event_duration"))
    got = stored.events_matrix(lambda x: x > 0.4, 2)
    assert rows(got.select("time", "x", "event_duration")) == want and report.exchanges(got) == 0
    bare = P.Packed(stored.df.filter("x = 1").select("value"), (), stored.axis)
    assert rows(bare.events_matrix(lambda x: x > 0.4, 2)) == sorted((t, n) for t, x, n in want if x == 1)
    assert report.exchanges(stored.resample_matrix(17).df) == 0 and stored.df.limit(0).count() == 0
    assert P.Packed(stored.df.limit(0), stored.cells, stored.axis).resample_matrix(17).df.count() == 0
    with pytest.raises(ValueError):
        stored.resample_matrix(18)
