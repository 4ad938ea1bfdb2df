"""Horizontal grids: identification, cell tables, corners, text and Parquet forms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import IO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import constants, div
from ..functions.metadata import identify_lat_lon

_CELL = "dst bigint, i bigint, j bigint, lat double, lon double, mask int"


def _edges(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper edge of each latitude: half way to its neighbours, and the poles at the ends."""
    order = np.argsort(lat)
    s = lat[order]
    mid = (s[1:] + s[:-1]) / 2
    low, high = np.append(-90.0, mid), np.append(mid, 90.0)
    back = np.argsort(order)
    return low[back], high[back]


def _sides(lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right edge of each longitude (0 to 360), half way to its neighbours around the globe."""
    left = lon - ((lon - np.roll(lon, 1)) % 360) / 2
    right = lon + ((np.roll(lon, -1) - lon) % 360) / 2
    if len(lon) == 1:
        left, right = lon - 180, lon + 180
    return left, right


@dataclass(frozen=True)
class LonLatGrid:
    """Latitudes and longitudes of a regular grid, and cells that are masked out. The axes are short; the cells needn't be."""

    lats: np.ndarray
    lons: np.ndarray
    mask: np.ndarray | None = None

    def __post_init__(self):
        if np.ndim(self.lats) != 1 or np.ndim(self.lons) != 1:
            raise ValueError("latitudes and longitudes must be one-dimensional")
        object.__setattr__(self, "lats", np.asarray(self.lats, float))
        object.__setattr__(self, "lons", np.asarray(self.lons, float))
        if self.mask is not None and np.shape(self.mask) != (len(self.lats), len(self.lons)):
            raise ValueError("the mask must be latitudes x longitudes")

    def numbered(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """``df`` with ``src``, the number of the cell that its coordinates name; other rows go. The axes are joined, not the cells."""
        rows = lambda x: [(k, float(v)) for k, v in enumerate(x)]
        spark = df.sparkSession
        i, j = spark.createDataFrame(rows(self.lats), f"lat_index bigint, `{lat}` double"), spark.createDataFrame(rows(self.lons), f"lon_index bigint, `{lon}` double")
        return df.join(F.broadcast(i), lat).join(F.broadcast(j), lon).withColumn("src", F.col("lat_index") * len(self.lons) + F.col("lon_index")).drop("lat_index", "lon_index")

    def cells(self, spark: SparkSession) -> DataFrame:
        """(dst, i, j, lat, lon, mask), numbered along longitudes first; made in parallel, from the axes as constants."""
        n = len(self.lons)
        out = spark.range(len(self.lats) * n).select(F.col("id").alias("dst"), div(F.col("id"), n).alias("i"), (F.col("id") % n).alias("j"))
        out = out.select("dst", "i", "j", F.get(constants(self.lats), F.col("i").cast("int")).alias("lat"), F.get(constants(self.lons), F.col("j").cast("int")).alias("lon"))
        if self.mask is None:
            return out.select("*", F.lit(1).alias("mask"))
        closed = [(int(k),) for k in np.flatnonzero(np.asarray(self.mask).ravel() == 0)]
        masked = spark.createDataFrame(closed, "dst bigint").withColumn("closed", F.lit(True))
        return out.join(masked, "dst", "left").select("dst", "i", "j", "lat", "lon", F.when(F.col("closed"), 0).otherwise(1).alias("mask"))

    def to_scrip(self, spark: SparkSession) -> ScripGrid:
        """Centres and four corners of every cell, counter-clockwise from the lower left; longitudes from 0 to 360."""
        lon = self.lons % 360
        low, high = _edges(self.lats)
        left, right = _sides(lon)
        of = lambda x, k: F.get(constants(x), F.col(k).cast("int"))
        out = self.cells(spark).withColumns({"low": of(low, "i"), "high": of(high, "i"), "centre": of(lon, "j"), "left": of(left, "j"), "right": of(right, "j")})
        return ScripGrid(
            out.select(
                "dst", "i", "j", "lat", F.col("centre").alias("lon"), "mask", F.array("low", "low", "high", "high").alias("corner_lat"), F.array("left", "right", "right", "left").alias("corner_lon")
            )
        )

    def to_cdo_grid(self, out: IO[bytes]) -> None:
        """The grid description as text."""
        listed = lambda x: ",".join(f"{v:f}" for v in x)
        lines = ["gridtype = lonlat", f"xsize = {len(self.lons)}", f"xvals = {listed(self.lons)}", f"ysize = {len(self.lats)}", f"yvals = {listed(self.lats)}"]
        out.write("".join(f"{x}\n" for x in lines).encode())
        out.flush()

    def to_netcdf(self, path: str) -> None:
        """A file of zeros on the grid, with units on its axes."""
        from ..sources.netcdf3 import write

        write(path, {"lat": len(self.lats), "lon": len(self.lons)}, {"lat": (("lat",), self.lats, {"units": "degrees_north"}), "lon": (("lon",), self.lons, {"units": "degrees_east"}), "value": (("lat", "lon"), np.zeros((len(self.lats), len(self.lons))), {})})


@dataclass(frozen=True)
class ScripGrid:
    """Cells with corners: dst, i, j, lat, lon, mask, corner_lat, corner_lon."""

    df: DataFrame

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.df.select("dst", "i", "j", "lat", "lon", "mask")

    def to_scrip(self, spark: SparkSession | None = None) -> ScripGrid:
        return self

    def write(self, path: str) -> None:
        self.df.write.parquet(path)


def um_grid(spark: SparkSession, nx: int, ny: int, x0: float, dx: float, y0: float, dy: float, mask: np.ndarray | None = None) -> LonLatGrid:
    """The grid that a fields-file header describes: point n + 1 of an axis lies at origin + (n + 1) * step; nonzero mask cells are closed."""
    lat, lon = y0 + dy * np.arange(1, ny + 1), x0 + dx * np.arange(1, nx + 1)
    return LonLatGrid(lat, lon, None if mask is None else (np.asarray(mask) == 0).astype(int))


def identify_grid(grid, lat: str | None = None, lon: str | None = None) -> LonLatGrid | ScripGrid:
    """The horizontal grid of a frame by its latitude and longitude columns; grids pass through."""
    if isinstance(grid, LonLatGrid | ScripGrid):
        return grid
    if not isinstance(grid, DataFrame):
        raise NotImplementedError(f"no grid in {type(grid).__name__}")
    if {"corner_lat", "corner_lon"} <= set(grid.columns):
        return ScripGrid(grid)
    if lat is None or lon is None or lat not in grid.columns or lon not in grid.columns:
        lat, lon = identify_lat_lon(grid)
    values = lambda c: np.array([r[0] for r in grid.select(c).distinct().orderBy(c).collect()], float)  # an axis
    return LonLatGrid(values(lat), values(lon))
