"""What a frame's plan looks like: partitions, sizes, operators."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def chunk_count(df: DataFrame) -> int:
    """Partitions of the frame as planned; nothing is run."""
    n = df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions()
    return n or df.rdd.getNumPartitions()  # a scan knows its partitions once its files are listed


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def chunk_size(df: DataFrame) -> int:
    return plan_bytes(df) // max(1, chunk_count(df))


def operators(df: DataFrame) -> Counter:
    """Physical operators by name, as first planned."""
    text = df._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]
    return Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M))


def graph_size(df: DataFrame) -> int:
    return sum(operators(df).values())


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan."""
    return operators(df)["Exchange"]


def report(df: DataFrame) -> str:
    return f"partitions {chunk_count(df)}, bytes per partition {chunk_size(df)}, operators {graph_size(df)}, shuffles {exchanges(df)}"


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text, e.g. ``formatted`` or ``cost``."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
