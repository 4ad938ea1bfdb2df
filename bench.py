"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and drained to a no-op sink. The first round warms the JVM;
a query's time is the least of the rounds after it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "resample_mean",
    "climatology_doy_mean",
    "climatology_monthday_mean",
    "climatology_nanpercentile",
    "climatology_rank_average",
    "anomaly_sub",
    "find_events",
    "event_values_stats",
    "threshold_events_climatology",
    "rolling_mean_centered",
    "percentile_approx",
    "regrid_bilinear",
]
#: With BENCH_GRID=1 also gridded series of the published benchmarks' shapes: years and steps a day, on CELLS cells.
GRID = {"grid_resample_6h_daily": (2, 4), "grid_dayofyear_mean": (5, 1), "grid_monthday_mean": (5, 1), "grid_find_events": (1, 1)}
CELLS = 10_000
#: The same in packed form, one row per cell, which is written once.
PACKED = {f"packed_{k.removeprefix('grid_')}": v for k, v in GRID.items()}


def grid_table(spark, years: int, per_day: int, folder: str) -> str:
    """A table of uniform values on CELLS cells, written once."""
    path = f"{folder}/grid-{years}-{per_day}"
    if not os.path.exists(f"{path}/_SUCCESS"):
        from pyspark.sql import functions as F

        days = sum(366 if y % 4 == 0 else 365 for y in range(2001, 2001 + years))
        step = 86_400 // per_day
        start = F.lit("2001-01-01").cast("timestamp_ntz")
        steps = spark.range(days * per_day, numPartitions=8).withColumn("time", start + F.make_dt_interval(F.floor(F.col("id") * step / 86_400).cast("int"), F.lit(0), F.lit(0), (F.col("id") * step % 86_400).cast("decimal(18,6)")))
        steps.select("time", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")).withColumn("value", F.rand(1)).write.mode("overwrite").parquet(path)
    return path


def grid_query(spark, name: str, folder: str):
    import datetime as dt

    from gridloom import catalog
    from gridloom.grid import Grid
    from gridloom.operators import climatology, events, resample

    years, per_day = GRID[name]
    df = spark.read.parquet(grid_table(spark, years, per_day, folder))
    days = sum(366 if y % 4 == 0 else 365 for y in range(2001, 2001 + years))
    g = Grid(df, ("time", "cell"), "time", "value")
    axis = catalog._axis(dt.datetime(2001, 1, 1), 86_400 // per_day, days * per_day)
    if "resample" in name:
        return resample.Resampler(g, per_day, axis).mean().df
    if "find" in name:
        return events.find_events(g, lambda v: v > 0.9, 4, axis)
    c = climatology.BlockedGroupby(g, "dayofyear" if "dayofyear" in name else "monthday", validate=False)
    c.check(axis)
    return c.mean(full=False).df


def packed_query(spark, name: str, folder: str):
    import datetime as dt

    from gridloom import catalog
    from gridloom.grid import Grid
    from gridloom.operators import packed

    years, per_day = PACKED[name]
    days = sum(366 if y % 4 == 0 else 365 for y in range(2001, 2001 + years))
    axis = catalog._axis(dt.datetime(2001, 1, 1), 86_400 // per_day, days * per_day)
    path = f"{folder}/packed-{years}-{per_day}"
    if not os.path.exists(f"{path}/_SUCCESS"):
        long = Grid(spark.read.parquet(grid_table(spark, years, per_day, folder)), ("time", "cell"), "time", "value")
        packed.pack(long, axis).df.repartition(32).write.mode("overwrite").option("parquet.enable.dictionary", "false").option("compression", "lz4").parquet(path)
    p = packed.Packed(spark.read.parquet(path), ("cell",), axis)
    if "resample" in name:
        return p.resample_matrix(per_day).df
    if "find" in name:
        return p.events_matrix(lambda x: x > 0.9, 4)
    return p.climatology_matrix("mean", "dayofyear" if "dayofyear" in name else "monthday")


def main() -> None:
    from pyspark.sql import SparkSession

    from gridloom import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(len(os.sched_getaffinity(0))))
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    folder = os.environ.get("BENCH_TMP", "/tmp/gridloom-bench")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda n=n: catalog.QUERIES[n](spark, sf)) for n in HEADLINE}
    if os.environ.get("BENCH_GRID") == "1":
        for n, (years, per_day) in GRID.items():
            grid_table(spark, years, per_day, folder)
            runs[n] = lambda n=n: grid_query(spark, n, folder)
        for n in PACKED:
            packed_query(spark, n, folder)
            runs[n] = lambda n=n: packed_query(spark, n, folder)
    times: dict[str, float] = {}
    for k in range(rounds + 1):
        for name, f in runs.items():
            start = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if k:
                times[name] = min(times.get(name, took), took)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()}, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
