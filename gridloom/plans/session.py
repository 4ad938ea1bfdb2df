"""Sessions with the settings that the library is meant for."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Adaptive execution decides on partitions, joins and skew; times have no zone.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "gridloom", master: str | None = None, options: Mapping[str, str] | None = None) -> SparkSession:
    """The running session, or a new one; without a master, one on this machine's CPUs that this process may use."""
    b = SparkSession.builder.appName(name)
    if master or not SparkSession.getActiveSession():
        b = b.master(master or f"local[{len(os.sched_getaffinity(0))}]")
    for k, v in (DEFAULTS | dict(options or {})).items():
        b = b.config(k, v)
    return b.getOrCreate()
