"""Functions over blocks of a grid: each block of cells and time as one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid


def map_blocks(df: DataFrame, by: Sequence[Column | str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``func`` of each block, a table of the rows that agree in ``by``; results follow each other in any order."""
    return df.groupBy(*by).applyInPandas(func, schema)


def time_blocks(grid: Grid, size: int) -> DataFrame:
    """The grid's rows with ``block`` (number of ``size`` steps) and ``offset`` (index of the block's first step)."""
    from ..functions.columns import div

    axis = grid.time_axis()
    block = div(axis.index(F.col(grid.time)), size)
    return grid.df.withColumn("block", block).withColumn("offset", F.col("block") * size)


def throttled(df: DataFrame, tasks: int, path: str) -> DataFrame:
    """Writes a frame with at most ``tasks`` tasks at a time into a table, and reads it; what makes its rows stays parallel."""
    df.repartition(tasks).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
