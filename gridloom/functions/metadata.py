"""CF conventions: which column is latitude, longitude or time, by column metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the CF units.
NORTH = frozenset("degrees_north degree_north degree_N degrees_N degreeN degreesN".split())
EAST = frozenset("degrees_east degree_east degree_E degrees_E degreeE degreesE".split())


def with_metadata(df: DataFrame, attrs: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``df`` with CF attributes on its columns."""
    for name, values in attrs.items():
        df = df.withMetadata(name, dict(df.schema[name].metadata) | dict(values))
    return df


def identify_lat_lon(df: DataFrame) -> tuple[str, str]:
    """Names of the latitude and longitude columns; the last match wins, as a later coordinate refines an earlier one."""
    lat = lon = None
    for f in df.schema.fields:
        m = f.metadata
        if m.get("standard_name") == "latitude" or m.get("units") in NORTH or m.get("axis") == "Y":
            lat = f.name
        if m.get("standard_name") == "longitude" or m.get("units") in EAST or m.get("axis") == "X":
            lon = f.name
    if lat is None or lon is None:
        raise ValueError(f"no {'latitude' if lat is None else 'longitude'} column among {df.columns}")
    return lat, lon


def identify_time(df: DataFrame) -> str:
    """Name of the time column: the first by metadata, else the only column of a temporal type."""
    for f in df.schema.fields:
        m = f.metadata
        if m.get("standard_name") == "time" or " since " in m.get("units", "") or m.get("axis") == "T":
            return f.name
    temporal = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    if len(temporal) != 1:
        raise ValueError(f"no time column among {df.columns}" if not temporal else f"several time columns: {temporal}")
    return temporal[0]


def remove_degenerate_axes(df: DataFrame, keep: str, over: str, value: str, tolerance: float = 1e-8) -> DataFrame:
    """(keep, value) of a coordinate that doesn't vary along ``over``; all rows if it does.

    A two-dimensional latitude that is the same in every column is really one-dimensional.
    """
    spread = df.groupBy(keep).agg((F.max(value) - F.min(value)).alias("spread"), F.avg(value).alias(value))
    if spread.filter(F.col("spread") > tolerance).head(1):
        return df.select(keep, over, value)
    return spread.select(keep, value)
