"""Regridding: a sparse matrix of weights applied to the horizontal grid.

Weights are a table (src, dst, w) of cell numbers from 0, beside a table of the
destination cells (dst, i, j, lat, lon, mask). Applying them is a join and a sum
by (kept dimensions, dst); all of a row's variables go through one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weights as generators
from .grids import LonLatGrid, identify_grid

#: What reference files put in place of missing values.
FILL = 1e20
#: Cells of a grid, 44 bytes each, that may be broadcast.
FEW = 1_000_000


@dataclass(frozen=True)
class Weights:
    matrix: DataFrame
    cells: DataFrame
    #: Whether the cells are known to be few enough to be broadcast.
    few: bool = False

    @classmethod
    def from_esmf(cls, links: DataFrame, cells: DataFrame, nx: int) -> Weights:
        """From tables (col, row, S), counted from 1, and (yc_b, xc_b, mask_b) by ``cell`` counted from 0, in degrees."""
        matrix = links.select((F.col("col") - 1).cast("bigint").alias("src"), (F.col("row") - 1).cast("bigint").alias("dst"), F.col("S").cast("double").alias("w"))
        return cls(matrix, _cells(cells, "yc_b", "xc_b", "mask_b", nx, False))

    @classmethod
    def from_scrip(cls, links: DataFrame, cells: DataFrame, nx: int) -> Weights:
        """From tables (src_address, dst_address, remap_matrix), counted from 1, and the dst_grid_* columns by ``cell``, in radians.

        A ``remap_matrix`` of several weights per link counts by its first.
        """
        first = F.col("remap_matrix")
        if links.schema["remap_matrix"].dataType.typeName() == "array":
            first = F.get("remap_matrix", F.lit(0))
        matrix = links.select((F.col("src_address") - 1).cast("bigint").alias("src"), (F.col("dst_address") - 1).cast("bigint").alias("dst"), first.cast("double").alias("w"))
        return cls(matrix, _cells(cells, "dst_grid_center_lat", "dst_grid_center_lon", "dst_grid_imask", nx, True))


def _cells(cells: DataFrame, lat: str, lon: str, mask: str, nx: int, radians: bool) -> DataFrame:
    degrees = F.degrees if radians else lambda c: c
    cell = F.col("cell").cast("bigint")
    return cells.select(cell.alias("dst"), F.floor(cell / nx).cast("bigint").alias("i"), (cell % nx).alias("j"), degrees(F.col(lat).cast("double")).alias("lat"), degrees(F.col(lon).cast("double")).alias("lon"), F.col(mask).cast("int").alias("mask"))


def apply_weights(source: DataFrame, weights: Weights, values: Sequence[str], keep: Sequence[str] = (), missing: str = "null") -> DataFrame:
    """(keep, dst, i, j, lat, lon, values): ``source`` has ``keep``, the cell number ``src`` and the values.

    A missing value makes all cells that it weighs in missing (``null``), is left
    out and the other weights enlarged (``renormalize``), or counts as 1e20
    (``fill``). Cells with mask 0 are missing; a cell without weights is 0 with
    ``fill`` and else missing.
    """
    if missing not in ("null", "renormalize", "fill"):
        raise ValueError(f"missing {missing!r}")
    joined = source.join(weights.matrix, "src")
    aggs = []
    for v in values:
        x, w = F.col(v), F.col("w")
        if missing == "fill":
            agg = F.sum(w * F.coalesce(x, F.lit(FILL)))
        elif missing == "renormalize":
            agg = F.try_divide(F.sum(w * x) * F.sum(w), F.sum(F.when(x.isNotNull(), w)))
        else:
            # weights of 0 don't count, whatever they are weights of
            agg = F.when(F.count(F.when(x.isNull() & (w != 0), 1)) == 0, F.sum(w * x))
        aggs.append(agg.alias(v))
    summed = joined.groupBy(*keep, "dst").agg(*aggs)
    # every frame has every cell, whether it has weights or not
    spine = source.select(*keep).distinct().join(F.broadcast(weights.cells) if weights.few else weights.cells) if keep else weights.cells
    out = spine.join(summed, [*keep, "dst"], "left")
    if missing == "fill":
        # a joined cell that came out missing is not one without weights
        out = out.join(weights.matrix.select("dst", F.lit(True).alias("weighed")).distinct(), "dst", "left")
        shown = [F.when(F.col("mask") != 0, F.when(F.col("weighed").isNull(), F.lit(0.0)).otherwise(F.col(v))).alias(v) for v in values]
    else:
        shown = [F.when(F.col("mask") != 0, F.col(v)).alias(v) for v in values]
    return out.select(*keep, "dst", "i", "j", "lat", "lon", *shown)


class Regridder:
    """Weights made or given once, applied to any number of frames.

    A frame has latitude and longitude columns, by metadata or by name, and any
    other columns; those in ``values`` are regridded, the rest is kept.
    """

    def __init__(self, source_grid: LonLatGrid | DataFrame | None = None, target_grid: LonLatGrid | DataFrame | None = None, weights: Weights | None = None, method: str = "bil", **options):
        if weights is None and (source_grid is None or target_grid is None):
            raise ValueError("give weights, or both grids")
        self.source = identify_grid(source_grid) if source_grid is not None else None
        if weights is None:
            target = identify_grid(target_grid)
            spark = _session(source_grid, target_grid)
            matrix = generators.generate(spark, self.source, target, method, **options)
            weights = Weights(matrix, target.cells(spark), isinstance(target, LonLatGrid) and len(target.lats) * len(target.lons) <= FEW)
        self.weights = weights

    def regrid(self, df: DataFrame, values: Sequence[str], lat: str = "lat", lon: str = "lon", missing: str = "null") -> DataFrame:
        keep = [c for c in df.columns if c not in (lat, lon, *values)]
        source = self.source or identify_grid(df, lat, lon)
        if isinstance(source, LonLatGrid):
            numbered = source.numbered(df, lat, lon)
        else:
            numbered = df.join(source.cells(df.sparkSession).select(F.col("dst").alias("src"), F.col("lat").alias(lat), F.col("lon").alias(lon)), [lat, lon])
        out = apply_weights(numbered.select(*keep, "src", *values), self.weights, values, keep, missing)
        return out.select(*keep, F.col("lat").alias(lat), F.col("lon").alias(lon), *values)


def _session(*grids):
    from pyspark.sql import SparkSession

    for g in grids:
        if isinstance(g, DataFrame):
            return g.sparkSession
    return SparkSession.getActiveSession()


def regrid(df: DataFrame, values: Sequence[str], target_grid: LonLatGrid | DataFrame | None = None, weights: Weights | None = None, lat: str = "lat", lon: str = "lon", **options) -> DataFrame:
    """One-off regridding of a frame to a target grid, bilinear unless ``method`` says otherwise."""
    missing = options.pop("missing", "null")
    source = identify_grid(df, lat, lon) if weights is None else None
    if weights is not None:
        if not {"src"} & set(df.columns):
            source = identify_grid(df, lat, lon)
        return Regridder(source, weights=weights).regrid(df, values, lat, lon, missing)
    return Regridder(source, target_grid, **options).regrid(df, values, lat, lon, missing)
