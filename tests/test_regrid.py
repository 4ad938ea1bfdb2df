import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import metadata
from gridloom.operators import grids, regrid, weights

LAT, LON = np.array([-45.0, 45.0]), np.array([0.0, 90.0, 180.0, 270.0])


def matrix(df, n_src, n_dst):
    out = np.zeros((n_dst, n_src))
    for r in df.collect():
        out[r.dst, r.src] += r.w
    return out


def field(spark, lats, lons, values, **extra):
    rows = [(float(a), float(o), None if values[i][j] is None or np.isnan(values[i][j]) else float(values[i][j])) for i, a in enumerate(lats) for j, o in enumerate(lons)]
    return spark.createDataFrame(rows, "lat double, lon double, value double")


@pytest.mark.parametrize("method", weights.METHODS)
def test_onto_itself(spark, method):
    g = grids.LonLatGrid(LAT, LON)
    np.testing.assert_allclose(matrix(weights.generate(spark, g, g, method), 8, 8), np.eye(8), atol=1e-9)


@pytest.mark.parametrize("method", ["nn", "dis", "bil", "bic", "con", "ycon", "laf"])
def test_constant_field(spark, method):
    a = grids.LonLatGrid(np.linspace(-80, 80, 9), np.arange(0, 360, 30.0))
    b = grids.LonLatGrid(np.linspace(-60, 75, 5), np.arange(-180, 180, 50.0))
    w = matrix(weights.generate(spark, a, b, method), 108, 40)
    np.testing.assert_allclose(w.sum(axis=1), 1.0)


def test_longitudes_wrap(spark):
    a, b = grids.LonLatGrid(LAT, LON), grids.LonLatGrid(LAT, np.array([-180.0, -90.0, 0.0, 90.0]))
    want = np.kron(np.eye(2), np.roll(np.eye(4), 2, axis=0))
    for method in ("nn", "bil", "con"):
        np.testing.assert_allclose(matrix(weights.generate(spark, a, b, method), 8, 8), want, atol=1e-9)


def test_nearest_against_all(spark):
    a = grids.LonLatGrid(np.linspace(-85, 85, 8), np.arange(0, 360, 25.0))
    b = grids.LonLatGrid(np.array([-88.0, -20.0, 3.0, 71.0]), np.arange(7, 360, 61.0))
    got = {r.dst: r.src for r in weights.generate(spark, a, b, "nn").collect()}
    for d in range(len(b.lats) * len(b.lons)):
        la, lo = b.lats[d // len(b.lons)], b.lons[d % len(b.lons)]
        far = [round(2 * math.asin(math.sqrt(math.sin(math.radians(x - la) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(la)) * math.sin(math.radians(y - lo) / 2) ** 2)), 12) for x in a.lats for y in a.lons]
        assert got[d] == int(np.argmin(far))


def test_masks(spark):
    open_ = np.ones((2, 4))
    open_[0, 1] = 0
    a, b = grids.LonLatGrid(LAT, LON, open_), grids.LonLatGrid(LAT, LON)
    assert 1 not in {r.src for r in weights.generate(spark, a, b, "dis").collect()}
    assert 1 not in {r.dst for r in weights.generate(spark, b, a, "con").collect()}
    lacking = weights.generate(spark, a, b, "bil")
    assert 1 not in {r.dst for r in lacking.collect()}
    filled = weights.generate(spark, a, b, "bil", extrap_method="nearestidavg")
    assert {r.dst for r in filled.collect()} == set(range(8))
    np.testing.assert_allclose(matrix(filled, 8, 8).sum(axis=1), 1.0)


def test_apply(spark):
    rng = np.random.default_rng(0)
    w = rng.random((9, 25)) * (rng.random((9, 25)) < 0.3)
    x = rng.random((3, 25))
    rows = [(t, k, float(x[t, k])) for t in range(3) for k in range(25)]
    source = spark.createDataFrame(rows, "t bigint, src bigint, value double")
    table = spark.createDataFrame([(int(s), int(d), float(w[d, s])) for d, s in zip(*np.nonzero(w), strict=True)], "src bigint, dst bigint, w double")
    cells = grids.LonLatGrid(np.arange(3.0), np.arange(3.0)).cells(spark)
    got = regrid.apply_weights(source, regrid.Weights(table, cells), ["value"], ["t"]).orderBy("t", "dst").toPandas()
    np.testing.assert_allclose(got["value"].to_numpy().reshape(3, 9), np.where(w.sum(axis=1) > 0, x @ w.T, np.nan), atol=1e-12)


def test_missing(spark):
    cells = grids.LonLatGrid(np.array([0.0]), np.array([0.0, 1.0]), np.array([[1, 0]])).cells(spark)
    table = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5), (2, 0, 0.0), (0, 1, 1.0)], "src bigint, dst bigint, w double")
    wt = regrid.Weights(table, cells)
    source = spark.createDataFrame([(0, 4.0), (1, None), (2, None)], "src bigint, value double")
    first = lambda how: regrid.apply_weights(source, wt, ["value"], missing=how).orderBy("dst").collect()
    assert [r.value for r in first("null")] == [None, None]
    assert [r.value for r in first("renormalize")] == [4.0, None]
    assert first("fill")[0].value == pytest.approx(0.5e20)
    whole = source.fillna(2.0)
    assert [r.value for r in regrid.apply_weights(whole, wt, ["value"]).orderBy("dst").collect()] == [3.0, None]


def test_regrid_frames(spark):
    values = np.arange(12.0).reshape(3, 2, 2)
    lats, lons = np.array([-45.0, 45.0]), np.array([0.0, 180.0])
    rows = [(t, float(a), float(o), float(values[t, i, j])) for t in range(3) for i, a in enumerate(lats) for j, o in enumerate(lons)]
    df = spark.createDataFrame(rows, "t bigint, lat double, lon double, value double")
    same = regrid.regrid(df, ["value"], grids.LonLatGrid(lats, lons))
    assert sorted(map(tuple, same.collect())) == sorted(rows)
    with pytest.raises(ValueError):
        regrid.Regridder()


def test_dialects(spark):
    links = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "col int, row int, S double")
    cells = spark.createDataFrame([(0, 10.0, 20.0, 1), (1, 10.0, 40.0, 0)], "cell int, yc_b double, xc_b double, mask_b int")
    a = regrid.Weights.from_esmf(links, cells, 2)
    scrip = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0])], "src_address int, dst_address int, remap_matrix array<double>")
    r = math.radians
    cells = spark.createDataFrame([(0, r(10.0), r(20.0), 1), (1, r(10.0), r(40.0), 0)], "cell int, dst_grid_center_lat double, dst_grid_center_lon double, dst_grid_imask int")
    b = regrid.Weights.from_scrip(scrip, cells, 2)
    assert sorted(map(tuple, a.matrix.collect())) == sorted(map(tuple, b.matrix.collect())) == [(0, 0, 1.0), (1, 1, 1.0)]
    for x, y in zip(a.cells.orderBy("dst").collect(), b.cells.orderBy("dst").collect(), strict=True):
        assert tuple(x) == pytest.approx(tuple(y))


def test_grids(spark):
    g = grids.LonLatGrid(LAT, LON)
    corners = g.to_scrip(spark).df.orderBy("dst").collect()
    assert (corners[0].corner_lat[0], corners[0].corner_lon[0]) == (-90, -45)
    assert [r.corner_lon[0] for r in corners[:4]] == [-45, 45, 135, 225]
    out = io.BytesIO()
    g.to_cdo_grid(out)
    assert out.getvalue().decode().splitlines()[:2] == ["gridtype = lonlat", "xsize = 4"]
    with pytest.raises(ValueError):
        grids.LonLatGrid(np.zeros((2, 2)), LON)
    um = grids.um_grid(spark, 3, 2, 0.0, 10.0, -10.0, 5.0, np.array([[0, 1, 0], [0, 0, 0]]))
    assert list(um.lats) == [-5, 0] and list(um.lons) == [10, 20, 30]
    assert um.cells(spark).filter("mask = 0").select("dst").collect()[0][0] == 1


def test_metadata(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0)], "y double, x double, v double")
    with pytest.raises(ValueError, match="latitude"):
        metadata.identify_lat_lon(df)
    for lat, lon in (({"units": "degrees_north"}, {"units": "degrees_east"}), ({"axis": "Y"}, {"axis": "X"}), ({"standard_name": "latitude"}, {"standard_name": "longitude"})):
        assert metadata.identify_lat_lon(metadata.with_metadata(df, {"y": lat, "x": lon})) == ("y", "x")
    t = spark.sql("SELECT 1.0D AS step, timestamp_ntz'2001-01-01' AS day")
    assert metadata.identify_time(t) == "day"
    assert metadata.identify_time(metadata.with_metadata(t, {"step": {"units": "days since 2001-01-01"}})) == "step"
    flat = spark.createDataFrame([(i, j, float(i)) for i in range(2) for j in range(3)], "i bigint, j bigint, lat double")
    assert metadata.remove_degenerate_axes(flat, "i", "j", "lat").count() == 2
    assert metadata.remove_degenerate_axes(flat, "j", "i", "lat").count() == 6
    assert isinstance(grids.identify_grid(metadata.with_metadata(df, {"y": {"axis": "Y"}, "x": {"axis": "X"}})), grids.LonLatGrid)
    with pytest.raises(NotImplementedError):
        grids.identify_grid([1, 2])


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_open_cells(spark, seed):
    """With masked cells, the nearest open ones by brute force over all pairs."""
    rng = np.random.default_rng(seed)
    lat, lon = np.linspace(-80, 80, 9), np.arange(0, 360, 24.0)
    mask = (rng.random((9, 15)) > 0.7).astype(int)
    source, target = grids.LonLatGrid(lat, lon, mask), grids.LonLatGrid(np.array([-85.0, -3.0, 40.0]), np.array([-170.0, 1.0, 24.0, 200.0]))
    sla, slo = np.radians(np.repeat(lat, 15)), np.radians(np.tile(lon, 9))
    got = {}
    for r in weights.generate(spark, source, target, "dis").collect():
        got.setdefault(r.dst, {})[r.src] = r.w
    for dst, (la, lo) in enumerate((a, b) for a in np.radians(target.lats) for b in np.radians(target.lons)):
        h = np.sin((sla - la) / 2) ** 2 + np.cos(sla) * np.cos(la) * np.sin((slo - lo) / 2) ** 2
        d = np.round(2 * np.arcsin(np.sqrt(h)), 12)
        near = [k for k in np.lexsort((np.arange(135), d)) if mask.ravel()[k]][:4]
        want = {int(k): 1 / d[k] for k in near} if d[near[0]] > 1e-10 else {int(near[0]): 1.0}
        total = sum(want.values())
        assert got[dst] == pytest.approx({k: w / total for k, w in want.items()})
    assert weights.generate(spark, source, target, "nn").count() == 12
    closed = grids.LonLatGrid(lat, lon, np.zeros((9, 15)))
    assert weights.generate(spark, closed, target, "dis").count() == 0


def brute_nearest(sla, slo, la, lo, k):
    h = np.sin((sla - la) / 2) ** 2 + np.cos(sla) * np.cos(la) * np.sin((slo - lo) / 2) ** 2
    d = np.round(2 * np.arcsin(np.sqrt(h)), 12)
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(d)), d))[:k]]


def test_grids_without_axes(spark):
    """Nearest points of a curvilinear grid to a regular one and back, by brute force."""
    rng = np.random.default_rng(8)
    la, lo = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(0, 360, 300)
    rows = [(k, k, 0, float(a), float(b), int(k % 7 != 0), [0.0], [0.0]) for k, (a, b) in enumerate(zip(la, lo, strict=True))]
    curved = grids.ScripGrid(spark.createDataFrame(rows, "dst bigint, i bigint, j bigint, lat double, lon double, mask int, corner_lat array<double>, corner_lon array<double>"))
    regular = grids.LonLatGrid(np.array([-80.0, 0.0, 30.0]), np.arange(0, 360, 60.0))
    open_ = np.flatnonzero(np.arange(300) % 7)
    got = {}
    for r in weights.generate(spark, curved, regular, "dis").collect():
        got.setdefault(r.dst, {})[r.src] = r.w
    for dst, (a, b) in enumerate((a, b) for a in np.radians(regular.lats) for b in np.radians(regular.lons)):
        near = brute_nearest(np.radians(la)[open_], np.radians(lo)[open_], a, b, 4)
        total = sum(1 / d for _, d in near)
        assert got[dst] == pytest.approx({int(open_[i]): 1 / d / total for i, d in near})
    back = {r.dst: r.src for r in weights.generate(spark, regular, curved, "nn").collect()}
    rla, rlo = np.radians(np.repeat(regular.lats, 6)), np.radians(np.tile(regular.lons, 3))
    assert back == {int(k): brute_nearest(rla, rlo, np.radians(la[k]), np.radians(lo[k]), 1)[0][0] for k in open_}
    values = regrid.Regridder(curved, regular, method="nn").regrid(spark.createDataFrame([(float(a), float(b), float(k)) for k, (a, b) in enumerate(zip(la, lo, strict=True))], "lat double, lon double, v double"), ["v"])
    assert values.count() == 18 and values.filter("v IS NULL").count() == 0
    with pytest.raises(NotImplementedError):
        weights.generate(spark, curved, regular, "con")


def test_other_dialect(spark):
    source = grids.LonLatGrid(np.array([-60.0, 0.0, 60.0]), np.arange(0, 360, 90.0))
    target = grids.LonLatGrid(np.array([-75.0, 10.0, 90.0]), np.array([0.0, 45.0]))
    w = {}
    for r in weights.generate_esmf(spark, source, target, extrap_method=None).collect():
        w.setdefault(r.dst, {})[r.src] = r.w
    assert all(sum(x.values()) == pytest.approx(1) for x in w.values()) and len(w) == 6
    assert w[4] == pytest.approx(dict.fromkeys(range(8, 12), 0.25))  # the pole is the mean of the last row
    assert w[0] == pytest.approx({0: 0.5 + 0.125, 1: 0.125, 2: 0.125, 3: 0.125})
    with pytest.raises(ValueError, match="no weights"):
        weights.generate_esmf(spark, source, target, pole="none", extrap_method="none")
    some = weights.generate_esmf(spark, source, target, pole="none", extrap_method="none", ignore_unmapped=True)
    assert {r.dst for r in some.collect()} == {2, 3}
    for how, n in (("neareststod", 1), ("nearestidavg", 8)):
        one = [r for r in weights.generate_esmf(spark, source, target, pole="none", extrap_method=how).collect() if r.dst == 1]
        assert len(one) == n and sum(r.w for r in one) == pytest.approx(1)
    for wrong in ({"method": "patch"}, {"line_type": "greatcircle"}, {"pole": "teeth"}, {"extrap_method": "creep"}):
        with pytest.raises(NotImplementedError):
            weights.generate_esmf(spark, source, target, **wrong)
