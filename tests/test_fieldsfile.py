"""Fields files written word by word, in every width and order of bytes."""

import numpy as np
import pytest

from gridloom.sources import fieldsfile


def entry(order, stash, shape, kind, at, n, packing=0):
    real = order.replace("i", "f")
    e = np.zeros(64, order)
    for place, value in {1: 2000, 15: n, 18: shape[0], 19: shape[1], 21: packing, 29: at, 30: n if at else 0, 39: kind, 42: stash}.items():
        e[place - 1] = value
    e[58:63] = np.array([-30, 15, 10, 20, -(2.0**30)], real).view(order)
    return e


def write(path, order, placed, packed=False):
    """A real field (code 16) and a land mask (code 30) behind an unused entry."""
    real = order.replace("i", "f")
    heat = np.arange(12.0).reshape(3, 4)
    heat[1, 2] = -(2.0**30)
    land = np.zeros((3, 4), order)
    land[0, 1], land[2, 3] = 1, -1
    data = [heat.astype(real.replace("8", "4") if packed else real).tobytes(), land.tobytes()]
    width = np.dtype(order).itemsize
    words = [len(d) // width for d in data]
    start = 256 + 3 * 64
    unused = np.full(64, -99, order)
    ends = [entry(order, 16, (3, 4), 1, start if placed else 0, words[0] if placed else 12, 2 if packed else 0), entry(order, 30, (3, 4), 3, start + words[0] if placed else 0, words[1])]
    head = np.zeros(256, order)
    head[149:152], head[159] = (257, 64, 3), start + 1
    path.write_bytes(b"".join([head.tobytes(), ends[0].tobytes(), unused.tobytes(), ends[1].tobytes(), *data]))
    return str(path)


@pytest.mark.parametrize("order", [">i8", "<i8", ">i4", "<i4"])
@pytest.mark.parametrize("placed", [True, False])
@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(spark, tmp_path, order, placed, packed):
    if packed and order.endswith("4"):
        pytest.skip("only words of 64 bits have halves")
    path = write(tmp_path / "dump", order, placed, packed)
    got = fieldsfile.fields(spark, path)
    assert [(f.stash, f.rows, f.columns) for f in got] == [(16, 3, 4), (30, 3, 4)]
    heat = fieldsfile.values(spark, "file://" + path, got[0])
    want = np.arange(12.0).reshape(3, 4)
    want[1, 2] = np.nan
    np.testing.assert_array_equal(heat, want)
    grid = fieldsfile.mask_grid(spark, path)
    np.testing.assert_allclose(grid.lats, [-15, 0, 15])
    np.testing.assert_allclose(grid.lons, [30, 50, 70, 90])
    np.testing.assert_array_equal(grid.mask, [[1, 0, 1, 1], [1, 1, 1, 1], [1, 1, 1, 0]])
    assert grid.cells(spark).filter("mask = 0").count() == 2


def test_refused(spark, tmp_path):
    path = write(tmp_path / "dump", ">i8", True)
    with pytest.raises(ValueError, match="code 33"):
        fieldsfile.mask_grid(spark, path, 33)
    raw = bytearray((tmp_path / "dump").read_bytes())
    at = 8 * (256 + 20)
    raw[at : at + 8] = (1).to_bytes(8, "big")
    (tmp_path / "packed").write_bytes(raw)
    field = fieldsfile.fields(spark, str(tmp_path / "packed"))[0]
    with pytest.raises(NotImplementedError, match="packing 1"):
        fieldsfile.values(spark, str(tmp_path / "packed"), field)
    for name, data in (("short", raw[:100]), ("text", b"x" * 5000), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="no fields file"):
            fieldsfile.fields(spark, str(tmp_path / name))
    (tmp_path / "cut").write_bytes(raw[:-8])
    with pytest.raises(ValueError, match="ends within"):
        fieldsfile.mask_grid(spark, str(tmp_path / "cut"))
