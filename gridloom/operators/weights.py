"""Weights between regular grids, made natively.

On regular grids weights are products: an axis of length n needs a few weights
per point, so each axis is worked out on the driver and the product of the two
constant tables is taken by Spark. Distance weights don't factor; they are found
row by row, from the source rows around each destination row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import constants, div
from .grids import LonLatGrid, _edges, _sides

METHODS = ("nn", "dis", "bil", "bic", "con", "con2", "ycon", "laf")


def _around(lon: np.ndarray) -> bool:
    """Whether the longitudes go around the globe."""
    s = np.sort(lon % 360)
    gaps = np.diff(np.append(s, s[0] + 360))
    return len(s) > 1 and gaps.max() < 1.5 * max(np.median(gaps), 1e-12) + 1e-9


def _brackets(src: np.ndarray, dst: np.ndarray, wrap: bool, extrapolate: bool) -> list[tuple[int, int, float]]:
    """Linear weights of the two source points around each destination point."""
    x = src % 360 if wrap else src
    order = np.argsort(x)
    s = x[order]
    out = []
    for d, v in enumerate(dst % 360 if wrap else dst):
        k = int(np.searchsorted(s, v, "right")) - 1
        if wrap and (k < 0 or k == len(s) - 1):
            a, b = len(s) - 1, 0
            gap = (s[0] - s[-1]) % 360 or 360.0
            t = ((v - s[-1]) % 360) / gap
        elif k < 0 or (k == len(s) - 1 and v > s[-1]):
            if not extrapolate:
                continue
            out.append((d, int(order[0 if k < 0 else -1]), 1.0))
            continue
        elif k == len(s) - 1:
            out.append((d, int(order[-1]), 1.0))
            continue
        else:
            a, b = k, k + 1
            t = (v - s[a]) / (s[b] - s[a])
        if t < 1:
            out.append((d, int(order[a]), 1 - t))
        if t > 0:
            out.append((d, int(order[b]), t))
    return out


def _cubic(src: np.ndarray, dst: np.ndarray, wrap: bool, extrapolate: bool) -> list[tuple[int, int, float]]:
    """Weights of the four points around each destination point (convolution with a = -1/2); ends are repeated."""
    linear = _brackets(src, dst, wrap, extrapolate)
    x = src % 360 if wrap else src
    order = np.argsort(x)
    rank = np.argsort(order)
    n = len(src)
    by_dst: dict[int, list[tuple[int, float]]] = {}
    for d, s, w in linear:
        by_dst.setdefault(d, []).append((s, w))
    out: dict[tuple[int, int], float] = {}
    for d, pair in by_dst.items():
        if len(pair) == 1:
            out[d, pair[0][0]] = out.get((d, pair[0][0]), 0.0) + 1.0
            continue
        a, t = int(rank[pair[0][0]]), pair[1][1]
        ws = (-0.5 * t + t**2 - 0.5 * t**3, 1 - 2.5 * t**2 + 1.5 * t**3, 0.5 * t + 2 * t**2 - 1.5 * t**3, -0.5 * t**2 + 0.5 * t**3)
        for k, w in zip(range(a - 1, a + 3), ws, strict=True):
            at = int(order[k % n if wrap else min(max(k, 0), n - 1)])
            out[d, at] = out.get((d, at), 0.0) + w
    return [(d, s, w) for (d, s), w in out.items() if w]


def _overlaps(src: tuple[np.ndarray, np.ndarray], dst: tuple[np.ndarray, np.ndarray], wrap: bool, measure) -> list[tuple[int, int, float]]:
    """Measure of the common part of each pair of intervals that have one."""
    out = []
    for d, (lo, hi) in enumerate(zip(*dst, strict=True)):
        for turn in (-360, 0, 360) if wrap else (0,):
            a, b = np.maximum(src[0] + turn, lo), np.minimum(src[1] + turn, hi)
            for s in np.flatnonzero(b > a + 1e-12):
                out.append((d, int(s), float(measure(b[s]) - measure(a[s]))))
    return out


def _summed(rows: list[tuple[int, int, float]]) -> tuple[list[int], list[int], list[float]]:
    """An axis's weights, each pair of points once."""
    summed: dict[tuple[int, int], float] = {}
    for d, k, w in rows:
        summed[d, k] = summed.get((d, k), 0.0) + float(w)
    return [d for d, _ in summed], [k for _, k in summed], list(summed.values())


def _product(spark: SparkSession, source: LonLatGrid, target: LonLatGrid, lat: list, lon: list) -> DataFrame:
    """(src, dst, w) of the products of two axes' weights, which are constants; made in parallel."""
    nx, mx = len(source.lons), len(target.lons)
    (di, si, wi), (dj, sj, wj) = _summed(lat), _summed(lon)
    n = max(1, len(dj))
    pairs = spark.range(len(di) * len(dj)).select(div(F.col("id"), n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"))
    of = lambda x, k, kind="bigint": F.get(constants(x, kind), F.col(k))
    return pairs.select((of(si, "a") * nx + of(sj, "b")).alias("src"), (of(di, "a") * mx + of(dj, "b")).alias("dst"), (of(wi, "a", "double") * of(wj, "b", "double")).alias("w"))


def _open(spark: SparkSession, grid: LonLatGrid, weights: DataFrame, cell: str) -> DataFrame:
    """Weights without those of masked cells."""
    if grid.mask is None:
        return weights
    return weights.join(grid.cells(spark).filter("mask <> 0").select(F.col("dst").alias(cell)), cell, "left_semi").select("src", "dst", "w")


def _arc(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Angle between points in radians, rounded, so that ties are ties."""
    h = np.sin((lat_a - lat_b) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_a - lon_b) / 2) ** 2
    return np.round(2 * np.arcsin(np.sqrt(np.minimum(h, 1.0))), 12)


def _nearest_open(source: LonLatGrid, target: LonLatGrid, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, src) of the k nearest open source cells of each cell of the target's row i, nearest first; of equals the first cell.

    Rows of the source are taken from the nearest on, until none that is left can hold a nearer cell.
    """
    lat, lons = np.radians(target.lats[i]), target.lons % 360
    best, who = np.full((len(lons), k), np.inf), np.full((len(lons), k), -1)
    rows = np.argsort(np.abs(source.lats - target.lats[i]), kind="stable")
    for r in rows:
        if np.radians(abs(source.lats[r] - target.lats[i])) > best.max() + 1e-9:
            break
        cols = np.flatnonzero(np.ones(len(source.lons)) if source.mask is None else np.asarray(source.mask)[r])
        if not len(cols):
            continue
        x = source.lons[cols] % 360
        order = np.argsort(x, kind="stable")
        cols, x = cols[order], x[order]
        # the nearest of a row lie next to the point on either side
        at = (np.searchsorted(x, lons)[:, None] + np.arange(-k - 1, k + 1)) % len(x) if len(x) > 2 * k + 2 else np.tile(np.arange(len(x)), (len(lons), 1))
        d = np.concatenate([best, _arc(lat, np.radians(lons)[:, None], np.radians(source.lats[r]), np.radians(x[at]))], axis=1)
        src = np.concatenate([who, r * len(source.lons) + cols[at]], axis=1)
        pick = np.lexsort((src, d), axis=1)[:, :k]
        best, who = np.take_along_axis(d, pick, 1), np.take_along_axis(src, pick, 1)
    return best, who


def _inverse(d: np.ndarray, exponent: float) -> np.ndarray:
    """Weights by inverse distance of each row's nearest points, nearest first; one at the very place counts alone, none is infinite."""
    ok = np.isfinite(d)
    ok[d[:, 0] < 1e-10, 1:] = False
    w = np.where(ok, 1 / np.maximum(np.where(ok, d, 1.0), 1e-15) ** exponent, 0.0)
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def _distance(spark: SparkSession, source: LonLatGrid, target: LonLatGrid, k: int, exponent: float = 1.0) -> DataFrame:
    """(src, dst, w): the k nearest open source cells of each destination cell, weighed by inverse distance; a task per run of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in rows["id"]:
                d, src = _nearest_open(source, target, int(i), k)
                w = _inverse(d, exponent)
                a, b = np.nonzero(w)
                yield pd.DataFrame({"src": src[a, b], "dst": int(i) * len(target.lons) + a, "w": w[a, b]})

    n = len(target.lats)
    return spark.range(0, n, 1, max(1, min(n, len(target.lons) * n // 20_000))).mapInPandas(run, "src bigint, dst bigint, w double")


#: Points of a grid without axes that weights can be made from; they are sent to every task, 24 bytes each.
POINTS = 2_000_000


def _scattered(spark: SparkSession, source: DataFrame, target: DataFrame, k: int, exponent: float) -> DataFrame:
    """(src, dst, w): the k nearest open points of ``source`` of each open cell of ``target``, both (dst, lat, lon, mask) in any order."""
    points = source.filter("mask <> 0").select(F.col("dst").cast("bigint").alias("src"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    n = points.count()
    if n > POINTS:
        raise ValueError(f"{n} source cells without axes; at most {POINTS} are sent to every task")
    p = points.orderBy("lat", "src").toPandas()
    ids, deg, lat, lon = p["src"].to_numpy(), p["lat"].to_numpy(), np.radians(p["lat"].to_numpy()), np.radians(p["lon"].to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in batches:
            for lo in range(0, len(cells) if n else 0, 64):
                some = cells.iloc[lo : lo + 64]
                at, width = some["lat"].to_numpy(), 2.0
                while True:  # a band of latitudes that is wide enough to hold all that are nearer than the k-th
                    a, b = np.searchsorted(deg, [at.min() - width, at.max() + width + 1e-9])
                    d = _arc(np.radians(at)[:, None], np.radians(some["lon"].to_numpy())[:, None], lat[None, a:b], lon[None, a:b])
                    src = np.broadcast_to(ids[a:b], d.shape)
                    pick = np.lexsort((src, d), axis=1)[:, :k]
                    d, src = np.take_along_axis(d, pick, 1), np.take_along_axis(src, pick, 1)
                    if b - a == n or (b - a >= k and d[:, -1].max() <= np.radians(width)):
                        break
                    width *= 2
                w = _inverse(d, exponent)
                i, j = np.nonzero(w)
                yield pd.DataFrame({"src": src[i, j], "dst": some["dst"].to_numpy()[i], "w": w[i, j]})

    return target.filter("mask <> 0").select("dst", "lat", "lon").mapInPandas(run, "src bigint, dst bigint, w double")


def _poles(source: LonLatGrid, target: LonLatGrid, lat: list) -> tuple[list, list]:
    """``lat`` without what lies beyond the last latitudes, and (d, s, w) of that: w is the share of the pole, whose value is the mean of the last row."""
    low, high = int(np.argmin(source.lats)), int(np.argmax(source.lats))
    inner, beyond = [], []
    for d, s, w in lat:
        v = target.lats[d]
        if v > source.lats[high] or v < source.lats[low]:
            edge = high if v > source.lats[high] else low
            t = abs(v - source.lats[edge]) / (90 - abs(source.lats[edge]))
            inner.append((d, s, w * (1 - t)))
            beyond.append((d, edge, t))
        else:
            inner.append((d, s, w))
    return inner, beyond


# Names of methods and of ways to extrapolate in the other dialect.
OTHER = {"bilinear": "bil", "neareststod": "nn", "conserve": "con", "conserve2nd": "con2"}


def generate_esmf(spark: SparkSession, source, target, method: str = "bilinear", extrap_method: str | None = "nearestidavg", norm_type: str = "dstarea", line_type: str | None = None, pole: str | None = None, ignore_unmapped: bool = False) -> DataFrame:
    """(src, dst, w) by the other dialect's names and defaults.

    ``pole``: ``none`` leaves what lies beyond the last latitude unmapped, ``all``
    (the default of bilinear) puts the mean of the last row at the pole.
    ``extrap_method``: None or ``none``, ``neareststod``, or ``nearestidavg`` (eight
    points by the inverse square of their distance). Destination cells that stay
    without weights are an error unless ``ignore_unmapped``.
    """
    if method not in OTHER:
        raise NotImplementedError(f"method {method!r}")
    if norm_type not in ("dstarea", "fracarea"):
        raise ValueError(f"norm_type {norm_type!r}")
    if line_type not in (None, "cartesian"):
        raise NotImplementedError(f"line_type {line_type!r}: cells' sides follow latitudes and longitudes")
    if pole not in (None, "none", "all"):
        raise NotImplementedError(f"pole {pole!r}")
    if extrap_method not in (None, "none", "neareststod", "nearestidavg"):
        raise NotImplementedError(f"extrap_method {extrap_method!r}")
    pole = pole or "all"
    options = {"extrapolate": pole == "all", "pole": pole == "all"} if method == "bilinear" else {}
    extrap = None if extrap_method in (None, "none") else "nearestidavg"
    out = generate(spark, source, target, OTHER[method], remap_norm="destarea" if norm_type == "dstarea" else "fracarea", extrap_method=extrap, extrap_points=1 if extrap_method == "neareststod" else 8, extrap_exponent=2.0, **options)
    if not ignore_unmapped:
        lacking = target.cells(spark).filter("mask <> 0").join(out.select("dst").distinct(), "dst", "left_anti").count()
        if lacking:
            raise ValueError(f"{lacking} destination cells have no weights")
    return out


def generate(spark: SparkSession, source: LonLatGrid, target: LonLatGrid, method: str = "bil", extrapolate: bool = True, remap_norm: str = "fracarea", remap_area_min: float = 0.0, extrap_method: str | None = None, extrap_points: int = 4, extrap_exponent: float = 1.0, pole: bool = False) -> DataFrame:
    """(src, dst, w) by nearest cell (nn), distance to the four nearest (dis), bilinear (bil), bicubic (bic),
    conservative area (con, ycon; con2 the same to first order) or largest area fraction (laf).

    Masked source cells have no weight and masked destination cells get none.
    ``remap_norm``: divide areas by the covered part of a cell (fracarea) or by
    the whole of it (destarea); ``remap_area_min``: least covered part.
    ``extrap_method="nearestidavg"`` gives destination cells without weights
    those of their ``extrap_points`` nearest cells, by inverse distance to the
    power of ``extrap_exponent``. ``pole``: beyond the last latitude, bilinear
    weights go on to the pole, which has the mean of the last row. Grids given by
    their cells (:class:`ScripGrid`) have nn and dis weights, to and from any grid.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    if remap_norm not in ("fracarea", "destarea"):
        raise ValueError(f"remap_norm {remap_norm!r}")
    if not (isinstance(source, LonLatGrid) and isinstance(target, LonLatGrid)):
        if method not in ("nn", "dis"):
            raise NotImplementedError(f"method {method!r} of grids without axes; nn and dis there are")
        return _scattered(spark, source.cells(spark), target.cells(spark), 1 if method == "nn" else 4, 1.0)
    wrap = _around(source.lons)
    if method in ("nn", "dis"):
        out = _distance(spark, source, target, 1 if method == "nn" else 4)
    elif method in ("bil", "bic"):
        axis = _brackets if method == "bil" else _cubic
        turned = wrap or bool(np.any(source.lons < 0) != np.any(target.lons < 0))
        lon_s, lon_d = (source.lons % 360, target.lons % 360) if turned else (source.lons, target.lons)
        lat, lon = axis(source.lats, target.lats, False, extrapolate), axis(lon_s, lon_d, wrap, extrapolate)
        inner, beyond = _poles(source, target, lat) if pole and method == "bil" else (lat, [])
        full = _product(spark, source, target, inner, lon)
        if beyond:
            n = len(source.lons)
            around = [(d, k, 1 / n) for d in range(len(target.lons)) for k in range(n)]
            full = full.union(_product(spark, source, target, beyond, around)).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        out = _open(spark, source, full, "src")
        # a cell with a masked neighbour has no bilinear weights
        if source.mask is not None:
            complete = full.groupBy("dst").agg(F.count("*").alias("n")).join(out.groupBy("dst").agg(F.count("*").alias("m")), "dst").filter("n = m").select("dst")
            out = out.join(complete, "dst", "left_semi").select("src", "dst", "w")
    else:
        lat = _overlaps(_edges(source.lats), _edges(target.lats), False, lambda v: np.sin(np.radians(v)))
        lon = _overlaps(_sides(source.lons % 360), _sides(target.lons % 360), True, np.radians)
        area = _open(spark, source, _product(spark, source, target, lat, lon), "src")
        low, high = _edges(target.lats)
        left, right = _sides(target.lons % 360)
        band, strip = np.sin(np.radians(high)) - np.sin(np.radians(low)), np.radians(right - left)
        k = F.col("id")
        size = spark.range(len(band) * len(strip)).select(k.alias("dst"), (F.get(constants(band), div(k, len(strip)).cast("int")) * F.get(constants(strip), (k % len(strip)).cast("int"))).alias("size"))
        covered = area.groupBy("dst").agg(F.sum("w").alias("covered")).join(size, "dst").filter(F.col("covered") > remap_area_min * F.col("size"))
        if method == "laf":
            best = area.groupBy("dst").agg(F.max(F.struct(F.round("w", 14).alias("w"), (-F.col("src")).alias("s"))).alias("m"))
            out = best.join(covered, "dst", "left_semi").select((-F.col("m.s")).alias("src"), "dst", F.lit(1.0).alias("w"))
        else:
            out = area.join(covered, "dst").select("src", "dst", (F.col("w") / F.col("covered" if remap_norm == "fracarea" else "size")).alias("w"))
    out = _open(spark, target, out, "dst")
    if extrap_method == "nearestidavg":
        lacking = target.cells(spark).filter("mask <> 0").select("dst").join(out.select("dst").distinct(), "dst", "left_anti")
        out = out.unionByName(_distance(spark, source, target, extrap_points, extrap_exponent).join(lacking, "dst", "left_semi").select("src", "dst", "w"))
    elif extrap_method is not None:
        raise NotImplementedError(f"extrap_method {extrap_method!r}")
    return out.select("src", "dst", "w")
