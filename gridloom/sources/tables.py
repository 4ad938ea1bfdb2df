"""Parquet as the first-class format: scans of many files, bounded writes, one file per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writer options that a caller may pass on.
ENCODING = frozenset("compression parquet.block.size parquet.page.size parquet.enable.dictionary parquet.compression.codec.zstd.level maxRecordsPerFile".split())


def scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One frame of a path, a pattern or several of them, whatever the order of their columns."""
    first, *rest = [paths] if isinstance(paths, str) else list(paths)
    out = spark.read.parquet(first)
    for p in rest:
        out = out.unionByName(spark.read.parquet(p))
    return out


def encoding(df: DataFrame, complevel: int = 4, extra: Mapping[str, object] | None = None) -> dict[str, str]:
    """Writer options: zstd at a level, dictionaries for what isn't a number, and those of ``extra`` that a writer takes."""
    if not 0 <= complevel <= 22:
        raise ValueError("complevel is from 0 to 22")
    out = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(complevel)} if complevel else {"compression": "none"}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[f"parquet.enable.dictionary#{name}"] = "false"
    return out | {k: str(v) for k, v in (extra or {}).items() if k in ENCODING}


def write_throttled(df: DataFrame, path: str, complevel: int = 4, max_tasks: int | None = None, rows_per_file: int | None = None) -> None:
    """Write a frame with at most ``max_tasks`` tasks at a time; without a bound, Spark's task slots are the bound.

    Rows are dealt anew to the writing tasks, so that what makes them stays as parallel as it was.
    """
    options = encoding(df, complevel, {"maxRecordsPerFile": rows_per_file} if rows_per_file else None)
    (df.repartition(max_tasks) if max_tasks else df).write.options(**options).parquet(path)


def _group(df: DataFrame, groupby: str) -> tuple[str, F.Column]:
    """Column and group of ``time.year`` or of a plain column."""
    name, _, part = groupby.partition(".")
    parts = {"year": F.year, "month": F.month, "day": F.day, "dayofyear": F.dayofyear, "hour": F.hour, "quarter": F.quarter, "date": F.to_date}
    if part and part not in parts:
        raise ValueError(f"no part {part!r} of a time")
    return name, parts[part](name) if part else F.col(name)


def series_bounds(df: DataFrame, groupby: str, time: str | None = None) -> DataFrame:
    """(group, start, end): the first and last time that each group has."""
    name, group = _group(df, groupby)
    t = time or name
    return df.groupBy(group.alias("group")).agg(F.min(t).alias("start"), F.max(t).alias("end"))


def write_series(df: DataFrame, path: str, groupby: str, time: str | None = None, complevel: int = 4) -> list[str]:
    """One Parquet folder per group at ``path``, a template of {start}, {end} and {group}; returns the folders.

    There is a job per group, as there is a file per group: for as many groups
    as someone wants files by name. ``write_partitioned`` is one job for any
    number.
    """
    name, group = _group(df, groupby)
    bounds = series_bounds(df, groupby, time).orderBy("group").collect()  # one row per output
    options = encoding(df, complevel)
    out = []
    for r in bounds:
        to = path.format(start=pd.Timestamp(r["start"]), end=pd.Timestamp(r["end"]), group=r["group"])
        df.filter(group.eqNullSafe(F.lit(r["group"]))).coalesce(1).write.options(**options).parquet(to)
        out.append(to)
    return out


def write_partitioned(df: DataFrame, path: str, groupby: str, complevel: int = 4) -> None:
    """All groups in one job, a folder ``group=...`` for each."""
    _, group = _group(df, groupby)
    grouped = df.withColumn("group", group)
    grouped.hint("rebalance", F.col("group")).write.options(**encoding(df, complevel)).partitionBy("group").parquet(path)
