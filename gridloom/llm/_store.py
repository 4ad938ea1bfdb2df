"""Scratch tables in the folder that every executor shares.

Lineage is cut by writing Parquet there and reading it back, so that a lost
executor costs the rerun of a few tasks and never of an earlier stage.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only a local session without one gets a folder of its own (tests)."""
    path = spark.conf.get(CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CONF} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CONF, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the paths of new scratch tables are noted, the innermost scope last.
_scopes: list[list[str]] = []


def new_table(spark: SparkSession, name: str) -> str:
    """Path for a scratch table, noted in the scopes that are open."""
    path = new_path(spark, name)
    for paths in _scopes:
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a frame that reads it."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables, as :func:`materialise` gave them, once nothing that is still to be computed reads them."""
    for t in tables:
        delete(t.sparkSession, t.scratch)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of all scratch tables that are made within."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes[:] = [x for x in _scopes if x is not paths]


def tidied(spark: SparkSession, make: Callable[[], DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """``make()``, after which the scratch tables are deleted that its result doesn't read; those named in ``keep`` stay.

    What the result reads is left to whoever owns the shared folder, as the result is only computed later.
    """
    with scope() as used:
        out = make()
    read = out.inputFiles()
    for path in used:
        name = path.rpartition("/")[2]
        if not any(f"/{name}/" in x for x in read) and name.rpartition("-")[0] not in keep:
            delete(spark, path)
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path object) of a path in any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Bytes of a table that may be broadcast. Larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows of their types' usual size allow; no arrays."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * (16 + sum(_WIDTH.get(f.dataType.typeName(), 64) for f in df.schema)) <= BROADCAST_BYTES else df


#: Bytes of a value; others, such as paths, count as 64.
_WIDTH = {"long": 8, "integer": 8, "double": 8, "boolean": 8}


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A scratch copy of ``df`` whose rows have a number each, and the number's column."""
    row = fresh(df, "row_number")
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), name), row


def without(held: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of ``held`` but those whose number is in ``gone``, a one-column frame; the number's column goes too."""
    gone = small_side(materialise(gone.toDF("gone_row"), "gone"))
    return held.join(gone, held[row] == gone["gone_row"], "left_anti").drop(row)
