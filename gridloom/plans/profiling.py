"""Timing of a read and a computation, over runs and settings."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .report import chunk_count, graph_size


def cluster(spark: SparkSession) -> dict[str, object]:
    """What a session runs on: application, master, executors that are up, task slots, memory of an executor."""
    sc = spark.sparkContext
    executors = len(sc._jsc.sc().statusTracker().getExecutorInfos())
    memory = sc.getConf().get("spark.executor.memory", "1g") if executors > 1 else sc.getConf().get("spark.driver.memory", "1g")
    return {"application": sc.applicationId, "master": sc.master, "executors": max(1, executors - 1), "slots": sc.defaultParallelism, "memory": memory}


class Timer:
    """Named sections of time; a mark starts a section and, given again, ends it. With a session, records say what it runs on."""

    def __init__(self, spark: SparkSession | None = None):
        self._cluster = cluster(spark) if spark is not None else {}
        self._start: dict[str, float] = {}
        self._total: dict[str, float] = {}
        self._excluded: set[str] = set()
        self._began = time.perf_counter()

    def mark(self, name: str) -> None:
        now = time.perf_counter()
        if name in self._start:
            self._total[name] = self._total.get(name, 0.0) + now - self._start.pop(name)
        else:
            self._start[name] = now

    def exclude(self, name: str) -> None:
        """Like :meth:`mark`, for time that doesn't count in the total."""
        self._excluded.add(name)
        self.mark(name)

    def times(self) -> dict[str, float]:
        total = time.perf_counter() - self._began - sum(v for k, v in self._total.items() if k in self._excluded)
        return {"total": total} | {k: v for k, v in self._total.items() if k not in self._excluded}

    def record(self, path: str, **also: object) -> None:
        """Appends a row to a CSV file, with a header if the file is new."""
        row = dict(also) | self._cluster | self.times()
        new = not os.path.exists(path)
        with open(path, "a", newline="") as f:
            w = csv.DictWriter(f, row)
            if new:
                w.writeheader()
            w.writerow(row)


def profile_once(spark: SparkSession, read: Callable[[SparkSession], DataFrame], function: Callable[[DataFrame], DataFrame]) -> dict[str, float]:
    """Seconds to open, build, optimize and load, with the sizes of input and output."""
    out: dict[str, float] = {}

    def timed(name: str, f: Callable):
        start = time.perf_counter()
        got = f()
        out[f"time_{name}"] = time.perf_counter() - start
        return got

    began = time.perf_counter()
    source = timed("open", lambda: read(spark))
    result = timed("function", lambda: function(source))
    timed("optimize", lambda: result._jdf.queryExecution().executedPlan())
    timed("load", lambda: result.write.format("noop").mode("overwrite").save())
    out["time_total"] = time.perf_counter() - began
    return out | {"chunks_in": chunk_count(source), "operators_in": graph_size(source), "operators_out": graph_size(result)}


def profile(spark: SparkSession, read: Callable, function: Callable, run_count: int = 3) -> dict[str, float]:
    """The least of each time over the runs; medians beside them."""
    runs = pd.DataFrame([profile_once(spark, read, function) for _ in range(run_count)])
    spent = [c for c in runs if c.startswith("time_")]
    return runs[[c for c in runs if c not in spent]].iloc[0].to_dict() | runs[spent].min().to_dict() | runs[spent].median().add_prefix("median_").to_dict()


def benchmark(spark: SparkSession, read: Callable, function: Callable, settings: Iterable[Mapping[str, object]], run_count: int = 3) -> pd.DataFrame:
    """A profile for each of several sets of session settings, which are put back."""
    rows = []
    for s in settings:
        before = {k: spark.conf.get(k, None) for k in s}
        try:
            for k, v in s.items():
                spark.conf.set(k, str(v))
            rows.append(dict(s) | profile(spark, read, function, run_count))
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)
    return pd.DataFrame(rows)
