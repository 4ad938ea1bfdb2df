import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import blocks
from gridloom.plans import profiling, report, session
from gridloom.sources import netcdf3, tables
from gridloom.streaming import runs


def cube(path, start, n=4, fill=-999.0):
    t = np.arange(start, start + n)
    v = np.arange(n * 6, dtype="f8").reshape(n, 2, 3) + 100 * start
    v[0, 0, 0] = fill
    netcdf3.write(
        str(path),
        {"time": n, "lat": 2, "lon": 3},
        {
            "time": (("time",), t.astype("i4"), {"units": "days since 2001-01-01 00:00:00"}),
            "lat": (("lat",), np.array([-45.0, 45.0]), {"units": "degrees_north"}),
            "lon": (("lon",), np.array([0.0, 120.0, 240.0]), {"units": "degrees_east"}),
            "tas": (("time", "lat", "lon"), v, {"_FillValue": fill, "long_name": "temperature"}),
        },
        {"title": "test"},
    )


def test_netcdf3(spark, tmp_path):
    cube(tmp_path / "a.nc", 0)
    cube(tmp_path / "b.nc", 4)
    df = netcdf3.scan(spark, [str(tmp_path / "a.nc"), str(tmp_path / "b.nc")])
    assert df.columns == ["time", "lat", "lon", "tas"]
    assert df.schema["lat"].metadata["units"] == "degrees_north"
    assert df.schema["tas"].metadata["_FillValue"] == -999.0
    assert df.count() == 48 and df.filter("tas IS NULL").count() == 2
    g = Grid.of(df, ["time", "lat", "lon"], "tas")
    assert g.time == "time" and g.time_axis().n == 8
    row = df.filter((F.col("time") == F.lit(dt.datetime(2001, 1, 6))) & (F.col("lat") == 45.0) & (F.col("lon") == 120.0)).first()
    assert row.tas == 410.0
    assert netcdf3.scan(spark, str(tmp_path)).count() == 48
    with pytest.raises(ValueError):
        (tmp_path / "c.nc").write_bytes(b"nothing")
        netcdf3.header(str(tmp_path / "c.nc"))


def test_grid_file(spark, tmp_path):
    from gridloom.operators.grids import LonLatGrid, identify_grid

    LonLatGrid(np.array([-1.0, 1.0]), np.array([0.0, 5.0])).to_netcdf(str(tmp_path / "g.nc"))
    got = identify_grid(netcdf3.scan(spark, str(tmp_path / "g.nc"), "value"))
    assert list(got.lats) == [-1, 1] and list(got.lons) == [0, 5]


def test_writes(spark, tmp_path):
    t = pd.date_range("2001-01-01", periods=20, freq="MS").astype("datetime64[us]")
    df = spark.createDataFrame(pd.DataFrame({"time": t, "value": np.arange(20.0)}), "time timestamp_ntz, value double")
    tables.write_throttled(df.repartition(6), str(tmp_path / "t"), 4, 2)
    assert len(list((tmp_path / "t").glob("*.zstd.parquet"))) <= 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    paths = tables.write_series(df, str(tmp_path / "{group}_{start.month:02d}_{end.month:02d}"), "time.year")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["2001_01_12", "2002_01_08"]
    assert [spark.read.parquet(p).count() for p in paths] == [12, 8]
    tables.write_partitioned(df, str(tmp_path / "p"), "time.year")
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("group").count().count() == 2
    assert tables.scan(spark, paths).count() == 20
    assert "shuffle" not in tables.encoding(df, 0, {"shuffle": True, "maxRecordsPerFile": 5})
    with pytest.raises(ValueError):
        tables.write_series(df, "x", "time.fortnight")


def test_blocks(spark, tmp_path):
    t = pd.date_range("2001-01-01", periods=12, freq="D").astype("datetime64[us]")
    g = Grid.of(spark.createDataFrame(pd.DataFrame({"time": t, "x": 0, "value": np.arange(12.0)}), "time timestamp_ntz, x bigint, value double"), ["time", "x"], "value", "time")
    got = blocks.map_blocks(blocks.time_blocks(g, 5), ["block", "offset"], lambda f: f[["block", "offset"]].iloc[:1].assign(n=len(f)), "block bigint, offset bigint, n bigint")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 5), (1, 5, 5), (2, 10, 2)]
    assert blocks.throttled(g.df, 2, str(tmp_path / "x")).count() == 12


def test_plans(spark, tmp_path):
    df = spark.range(100).groupBy(F.col("id") % 7).count()
    assert report.exchanges(df) == 1 and report.graph_size(df) > 2 and report.chunk_count(df) >= 1
    assert "shuffles 1" in report.report(df) and "Exchange" in report.explain(df)
    timer = profiling.Timer()
    timer.mark("a")
    time.sleep(0.01)
    timer.mark("a")
    timer.exclude("b")
    time.sleep(0.02)
    timer.exclude("b")
    assert 0.01 <= timer.times()["a"] <= timer.times()["total"] < 0.02 + timer.times()["a"]
    for _ in range(2):
        timer.record(str(tmp_path / "t.csv"), run=1)
    assert len((tmp_path / "t.csv").read_text().splitlines()) == 3
    got = profiling.benchmark(spark, lambda s: s.range(1000), lambda d: d.selectExpr("sum(id)"), [{"spark.sql.shuffle.partitions": 2}, {"spark.sql.shuffle.partitions": 3}], 2)
    assert len(got) == 2 and (got["time_total"] >= got["time_load"]).all()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert session.session().sparkContext is spark.sparkContext


def test_stream(spark, tmp_path):
    for k, part in enumerate(([0, 1, 1], [1, 0, 1], [1, 0])):
        start = sum((3, 3, 2)[:k])
        spark.createDataFrame([(7, start + i, bool(b)) for i, b in reversed(list(enumerate(part)))], "x bigint, time bigint, holds boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    rows = spark.readStream.schema("x bigint, time bigint, holds boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = runs.stream_events(rows, ["x"], 2).writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("runs").collect())) == [(1, 7, 3), (5, 7, 2)]


def test_netcdf_series(spark, tmp_path):
    """A file per year, written by tasks; missing values by _FillValue, both ways."""
    import datetime as dt

    from gridloom.sources import netcdf3

    rows = [(dt.datetime(2001, 12, 30) + dt.timedelta(days=k), float(y), None if k == 1 and y == 5 else k + y / 10) for k in range(4) for y in (5, 7)]
    df = spark.createDataFrame(rows[:-1], "time timestamp_ntz, lat double, v double")
    files = netcdf3.write_series(df, str(tmp_path / "y{group}-{start:%j}-{end:%j}.nc"), ["time", "lat"], "v", "time.year", "time")
    assert sorted((f.group, f.path.rsplit("/", 1)[1], f.n_values) for f in files) == [("2001", "y2001-364-365.nc", 4), ("2002", "y2002-001-002.nc", 4)]
    assert netcdf3.header(files[0].path).variables["v"].attrs["_FillValue"] == 1e20
    back = netcdf3.scan(spark, sorted(f.path for f in files), "v")
    assert sorted(map(tuple, back.collect())) == sorted([*map(tuple, rows[:-1]), (rows[-1][0], 7.0, None)], key=lambda r: (r[0], r[1]))
