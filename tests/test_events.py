import datetime as dt
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import events as E
from gridloom.plans import report

START = dt.datetime(2001, 1, 1)


def grid(spark, rows):
    """A daily grid of a list of series, one per cell x."""
    data = [(START + dt.timedelta(days=t), x, None if v is None else float(v)) for x, series in enumerate(rows) for t, v in enumerate(series)]
    return Grid.of(spark.createDataFrame(data, "time timestamp_ntz, x bigint, value double"), ["time", "x"], "value", "time")


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "text, n, expected",
    [
        ("..##..#", 1, [(2, 0, 2), (6, 0, 1)]),
        ("#.##### ##.#...", 1, [(0, 0, 1), (0, 1, 2), (2, 0, 5), (3, 1, 1)]),
        ("####### #######", 1, [(0, 0, 7), (0, 1, 7)]),
        ("#.##### ##.#...", 2, [(0, 1, 2), (2, 0, 5)]),
        (".......", 1, []),
        ("##?###.", 1, [(0, 0, 2), (3, 0, 3)]),
    ],
)
def test_find_events(spark, text, n, expected):
    """Series drawn as # (holds), . (doesn't) and ? (missing)."""
    rows = [[{"#": 2, ".": -1, "?": None}[c] for c in series] for series in text.split()]
    assert found(E.find_events(grid(spark, rows), lambda v: v > 0, n)) == expected


def islands(series):
    out, t = [], 0
    for hit, run in itertools.groupby(series):
        n = len(list(run))
        if hit:
            out.append((t, n))
        t += n
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=4))
def test_find_events_random(spark, masks):
    g = grid(spark, [[int(b) for b in m] for m in masks])
    expected = sorted((t, x, n) for x, m in enumerate(masks) for t, n in islands(m))
    assert found(E.find_events(g, lambda v: v > 0)) == expected


def test_one_shuffle(spark, tmp_path):
    grid(spark, [[0, 1, 1, 0]] * 3).df.write.parquet(str(tmp_path / "g"))
    g = Grid.of(spark.read.parquet(str(tmp_path / "g")), ["time", "x"], "value", "time")
    assert report.exchanges(E.find_events(g, lambda v: v > 0, 2, g.time_axis())) == 1


def drawn(seed, cells=3, n=40):
    """Random series with gaps, and their runs by :func:`islands`."""
    import random

    r = random.Random(seed)
    rows = [[None if r.random() < 0.1 else float(r.randint(-3, 6)) for _ in range(n)] for _ in range(cells)]
    return rows, [(t, x, k) for x, series in enumerate(rows) for t, k in islands([v is not None and v > 0 for v in series])]


@pytest.mark.parametrize("width", [1, 7, 13, 40])
def test_blocks_and_joins(spark, width):
    """Events found block by block and joined are those of the whole."""
    rows, runs = drawn(11)
    steps = E.steps(grid(spark, rows)).filter("value > 0")
    blocks = [E.find_events_block(steps, ["x"], a, min(a + width - 1, 39), 3) for a in range(0, 40, width)]
    assert found(E.join_events(blocks, ["x"], 3)) == sorted(r for r in runs if r[2] >= 3)
    first = found(blocks[0])
    assert all(k >= 3 or t == 0 or t + k == width for t, _, k in first)


def test_joins_of_tables(spark):
    make = lambda *r: spark.createDataFrame(list(r), "time bigint, x bigint, event_duration bigint")
    assert found(E.join_events([make((4, 8, 2)), make((6, 8, 5)), make((12, 8, 1)), make((6, 9, 1))])) == [(4, 8, 7), (6, 9, 1), (12, 8, 1)]
    moved = [E.offset_events(make((0, 0, 3)), time=10 * k, x=k // 2) for k in range(3)]
    assert found(E.join_events(moved)) == [(0, 0, 3), (10, 0, 3), (20, 1, 3)]
    assert found(E.filter_block(make((9, 2, 1), (9, 7, 1), (9, 4, 1)), x=(2, 4))) == [(9, 2, 1), (9, 4, 1)]


def test_values(spark):
    rows, runs = drawn(5)
    g = grid(spark, rows)
    ev = E.with_event_id(E.find_events(g, lambda v: v > 0))
    order = sorted(runs, key=lambda r: (r[0] + r[2], r[1]))
    assert sorted((r.event_id, r.time, r.x, r.event_duration) for r in ev.collect()) == [(k, *r) for k, r in enumerate(order)]
    values = sorted((r.event_id, r.time, r.value) for r in E.event_values(g, ev).collect())
    assert values == sorted((k, u, rows[x][u]) for k, (t, x, n) in enumerate(order) for u in range(t, t + n))
    stats = E.event_stats(g, ev, total=F.sum("value"), least=F.min("value"))
    assert stats.columns == [*ev.columns, "total", "least"]
    assert sorted((r.event_id, r.total, r.least) for r in stats.collect()) == [(k, sum(rows[x][t : t + n]), min(rows[x][t : t + n])) for k, (t, x, n) in enumerate(order)]


def test_map_events(spark, monkeypatch):
    rows, runs = drawn(23)
    g = grid(spark, rows)
    ev = E.find_events(g, lambda v: v > 0)
    want = sorted((t, x, n, rows[x][t], max(rows[x][t : t + n])) for t, x, n in runs)
    for together in (E.TOGETHER, 3):
        monkeypatch.setattr(E, "TOGETHER", together)
        assert found(E.map_events(g, ev, lambda v: {"first": v.iloc[0], "most": v.max()}, "first double, most double")) == want
    assert found(E.map_events(g, ev, lambda v: float(len(v)))) == sorted((*r, r[2]) for r in runs)


def test_extend_coords_and_da(spark):
    rows, runs = drawn(42, 2, 12)
    g = grid(spark, rows)
    ev = E.find_events(g, lambda v: v > 0)
    assert sorted((r.time, r.x) for r in E.extend_events(ev).collect()) == sorted((u, x) for t, x, n in runs for u in range(t, t + n))
    got = {(r.time, r.event_duration) for r in E.event_coords(g.with_df(g.df, dims=("time",)), ev).collect()}
    assert got == {(START + dt.timedelta(days=t), None if t + n == 12 else n * 86_400) for t, _, n in runs}
    dense = {(r.time, r.x): r.value for r in E.event_da(g, ev.union(ev.limit(1)), "event_duration").df.collect()}
    twice = tuple(ev.limit(1).first())
    assert dense == {(START + dt.timedelta(days=u), x): sum(n * (1 + ((t, x, n) == twice)) for t, y, n in runs if (t, y) == (u, x)) or None for u in range(12) for x in range(2)}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_atleastn(spark, n):
    rows, _ = drawn(77, 2, 25)
    rows[0][4] = float("inf")
    want = []
    for series in rows:
        kept = [None] * len(series)
        for t, k in islands([v is not None and v != float("inf") for v in series]):
            if k >= n:
                kept[t : t + k] = series[t : t + k]
        want.append(kept)
    out = E.atleastn(grid(spark, rows), n).df.orderBy("x", "time").collect()
    assert [r.value for r in out] == want[0] + want[1]


def test_indexed(spark):
    g = grid(spark, [[1, 0], [1, 1]])
    g = g.with_df(g.df.withColumn("x", F.col("x") * 10.0 - 5))
    assert found(E.find_events(E.indexed(g), lambda v: v > 0)) == [(0, 0, 1), (0, 1, 2)]
