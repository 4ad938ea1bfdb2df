"""Percentiles of a grid over some of its dimensions, exact or from mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import whole
from ..grid import Grid


def percentiles(grid: Grid, q: float | Sequence[float], dim: str | Sequence[str] | None = None, skipna: bool = True, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(remaining dimensions, percentile, value) for each q from 0 to 100.

    The approximate form merges partial summaries of bounded size and returns
    values of the data, within 1 / accuracy of the rank; the exact form
    interpolates linearly and holds a group's distinct values.
    """
    qs = [float(q)] if isinstance(q, int | float) else [float(x) for x in q]
    if not all(0 <= x <= 100 for x in qs):
        raise ValueError("percentiles are from 0 to 100")
    over = list(grid.dims) if dim is None else [dim] if isinstance(dim, str) else list(dim)
    keep = [d for d in grid.dims if d not in over]
    v, at = F.col(grid.value), F.array(*(F.lit(x / 100) for x in qs))
    agg = F.percentile(v, at) if exact else F.percentile_approx(v, at, accuracy)
    if not skipna:
        agg = whole(agg, v)
    rows = grid.df.groupBy(*keep).agg(agg.alias("all"))
    pairs = F.arrays_zip(F.array(*(F.lit(x) for x in qs)).alias("percentile"), F.col("all").alias("value"))
    # a group without values still has its percentiles, all missing
    none = F.array(*(F.struct(F.lit(x).alias("percentile"), F.lit(None).cast("double").alias("value")) for x in qs))
    return rows.select(*keep, F.explode(F.when(F.col("all").isNull(), none).otherwise(pairs)).alias("p")).select(*keep, F.col("p.percentile").alias("percentile"), F.col("p.value").alias(grid.value))


def approx_percentile(grid: Grid, q: float | Sequence[float], dim: str | Sequence[str] | None = None, skipna: bool = True) -> DataFrame:
    return percentiles(grid, q, dim, skipna)


def sketch(grid: Grid, by: Sequence[str], k: int = 200) -> DataFrame:
    """(by, sketch, n): KLL sketches that can be stored, and merged by :func:`from_sketches`."""
    return grid.df.filter(F.col(grid.value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(grid.value, k).alias("sketch"), F.count("*").alias("n"))


def from_sketches(sketches: DataFrame, by: Sequence[str], q: Sequence[float]) -> DataFrame:
    """(by, percentile, value) of stored sketches merged over everything but ``by``."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    one = lambda x: F.struct(F.lit(float(x)).alias("percentile"), F.kll_sketch_get_quantile_double("sketch", F.lit(x / 100)).alias("value"))
    return merged.select(*by, F.explode(F.array(*map(one, q))).alias("p")).select(*by, "p.percentile", "p.value")
