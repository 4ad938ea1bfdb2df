"""Immutable shards under a versioned manifest, with size-tiered compaction.

``append`` writes an arrival as it comes, one small file per task, without a
shuffle. ``compact`` sorts the files below the target size into tiers, each
``FAN_IN`` times as large as the one before, and merges runs of files of one
tier into files of about the target size, a task to a run; files of other tiers,
and what no run needs, stay as they are. No file is ever changed. A version is a
table of the files that make it up, written aside and then renamed to its
number; a rename never replaces a version, so of two writers that make one
version one is late, and readers see a version whole or not at all. A late
append is made again on top of the other version, and so is a late compaction
whose files are all still there; else it fails with :class:`Conflict`, and
nothing has changed. (The store's folder must be on a file system whose renames
are atomic.)

``vacuum`` forgets old versions and deletes files that are in no version. A
writer's files are in no version until it commits, so files younger than
``lease`` seconds stay; a writer must not take longer.

All of it is DataFrame functions and file-system calls. The list of a version's
files is held by the driver, as the list of a table's files is in any scan.

Null and empty texts, null keys, very long texts and repeated rows are stored as
they are; ties in size go by path; an empty frame appends no file but makes a
version; columns may have any names, as long as no two versions disagree on a
column's type.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import delete, discard, fresh, hadoop_path, materialise, new_table, small_side
from .mixing import number

#: Bytes of a merged file; growth from tier to tier; size of the first tier; files of a tier that are worth a merge.
TARGET, FAN_IN, FIRST, LEAST = 128 << 20, 4, 1 << 20, 2
#: Files that one task of the planning looks at together.
LANE = 4096
#: Seconds for which files that no version has are left alone; times that a late writer tries again.
LEASE, ATTEMPTS = 86_400, 20
_FILES = "path string, bytes bigint, n_rows bigint, since bigint"


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


class Lost(Conflict):
    """Another writer has replaced files that this one has read."""


class ShardStore:
    """A folder of shards; ``schema`` is needed to read a store without files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # versions

    def _folder(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit())

    def latest(self) -> int:
        """Number of the latest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def files(self, version: int | None = None) -> DataFrame:
        """The files of a version (the latest): path below the root, bytes, n_rows, and the version they came with."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).parquet(self._folder(version))

    def _commit(self, files: DataFrame, version: int) -> int:
        aside = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        files.select("path", "bytes", "n_rows", "since").coalesce(1 + files.count() // 1_000_000).write.parquet(aside)
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        _, a = hadoop_path(self.spark, aside)
        _, b = hadoop_path(self.spark, self._folder(version))
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the version exists
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, options)
        except Exception as e:
            delete(self.spark, aside)
            if version in self.versions():
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _on_top(self, make: Callable[[int], DataFrame]) -> int:
        """Commits ``make(version)`` as the next version, again if another writer was first."""
        for attempt in range(ATTEMPTS):
            version = self.latest() + 1
            try:
                return self._commit(make(version), version)
            except Lost:
                raise
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    # data

    def _written(self, folder: str) -> DataFrame:
        """The files that a job has left in a folder, from their footers; those without rows are left out."""
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], "path string, bytes bigint, n_rows bigint")
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}")
        base = f"/{folder}/"
        path = F.concat(F.lit(folder + "/"), F.substring_index(F.col("_metadata.file_path"), base, -1))
        return found.groupBy(path.alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))

    def append(self, df: DataFrame) -> int:
        """Adds an arrival; returns the version that has it."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        new = materialise(self._written(folder), "shard-files")
        version = self._on_top(lambda v: self.files(v - 1).union(new.withColumn("since", F.lit(v).cast("bigint"))))
        discard(new)
        return version

    def plan(self, target: int = TARGET, fan_in: int = FAN_IN, first: int = FIRST, least: int = LEAST, version: int | None = None) -> DataFrame:
        """(path, bytes, shard): the files of a version (the latest) to merge, and the number of the run that each goes to, from 0."""
        small = self.files(version).filter(F.col("bytes") < target)
        lanes = -(-max(1, small.count()) // LANE)
        tier = F.floor(F.log(F.greatest(F.col("bytes") / first, F.lit(1.0))) / F.log(F.lit(float(fan_in)))).cast("int")
        tiered = small.withColumn("tier", tier).withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes)))
        run = Window.partitionBy("tier", "lane").orderBy("bytes", "path")
        before = F.sum("bytes").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
        runs = tiered.withColumn("run", F.floor(before / target))
        whole = Window.partitionBy("tier", "lane", "run")
        kept = runs.withColumn("n", F.count("*").over(whole)).filter(F.col("n") >= least)
        # runs, of which each is about a target's size, numbered one after another
        numbers = kept.select("tier", "lane", "run").distinct().withColumn("shard", F.row_number().over(Window.orderBy("tier", "lane", "run")) - 1)
        return kept.join(numbers, ["tier", "lane", "run"]).select("path", "bytes", "shard")

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, first: int = FIRST, least: int = LEAST) -> int | None:
        """One round of merges; the version that has them, or None if there was nothing to merge."""
        spark = self.spark
        base = self.latest()
        plan = materialise(self.plan(target, fan_in, first, least, base), "compaction")
        planned = plan.select("path", "shard").collect()  # the scan's list of files
        if not planned:
            discard(plan)
            return None
        folder = f"data/{uuid.uuid4().hex}"
        old = spark.read.parquet(*(f"{self.root}/{r.path}" for r in planned))
        shard, key = fresh(old, "shard"), fresh(old, "shard_file")
        runs = small_side(plan.select(F.col("path").alias(key), F.col("shard").alias(shard)), len(planned))
        rows = old.select("*", self._file().alias(key)).join(runs, key).drop(key)
        # one task to a run, which makes one file
        dealt = rows.repartitionById(1 + max(r.shard for r in planned), F.col(shard))
        dealt.drop(shard).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        new = materialise(self._written(folder), "shard-files")

        def merged(version: int) -> DataFrame:
            files = self.files(version - 1)
            if version - 1 != base and files.join(small_side(plan.select("path"), len(planned)), "path", "left_semi").count() < len(planned):
                raise Lost(f"files that version {base} had are gone in version {version - 1}")
            stay = files.join(small_side(plan.select("path"), len(planned)), "path", "left_anti")
            return stay.select("path", "bytes", "n_rows", "since").union(new.withColumn("since", F.lit(version).cast("bigint")))

        try:
            return self._on_top(merged)
        finally:
            discard(plan, new)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version (the latest)."""
        paths = [r[0] for r in self.files(version).select("path").collect()]  # the scan's list of files
        if not paths:
            if schema is None:
                raise ValueError("a store without files has no schema")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/{p}" for p in paths))

    def _file(self) -> Column:
        """Path below the root of the file that a scanned row is in."""
        return F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), f"{self.root.rpartition('/')[2]}/data/", -1))

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version that has files, each with its file's path below the root, ``file``."""
        return self.read(version).select("*", self._file().alias("file"))

    def vacuum(self, keep: int = 1, lease: float = LEASE) -> int:
        """Forgets all but the last versions and deletes the files that none of those has and that are older than ``lease`` seconds; returns how many."""
        before = 1000 * (time.time() - lease)
        fs, p = hadoop_path(self.spark, f"{self.root}/data")
        # files first and versions after, so that a file which is committed meanwhile is known
        old, it = [], fs.listFiles(p, True) if fs.exists(p) else None
        while it is not None and it.hasNext():
            at = it.next()
            if at.getPath().getName().endswith(".parquet") and at.getModificationTime() <= before:
                old.append("data/" + at.getPath().toString().rpartition("/data/")[2])
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            delete(self.spark, self._folder(v))
        live = {r[0] for v in self.versions() for r in self.files(v).select("path").collect()}
        gone = [path for path in old if path not in live]
        for path in gone:
            delete(self.spark, f"{self.root}/{path}")
        fs, p = hadoop_path(self.spark, f"{self.root}/manifest")
        for s in fs.listStatus(p) if fs.exists(p) else []:  # what lost writers had not yet renamed
            if s.getPath().getName().startswith("_") and s.getModificationTime() <= before:
                delete(self.spark, s.getPath().toString())
        return len(gone)


#: Arrivals of the query by the share of documents in each, in sixteenths.
ARRIVALS = (8, 4, 2, 1, 1)
SEED = "arrival-1/"


def arrival(doc_id: Column) -> Column:
    """Number, from 1, of the arrival that a document comes with; a null doc_id comes with the first."""
    x = F.coalesce(F.pmod(number(F.concat(F.lit(SEED), doc_id.cast("string"))), F.lit(sum(ARRIVALS))), F.lit(0))
    out = F.lit(1)
    for k in range(1, len(ARRIVALS)):
        out = out + (x >= sum(ARRIVALS[:k])).cast("int")
    return out.cast("bigint")


def shard(docs: DataFrame, target: int = TARGET) -> tuple[ShardStore, DataFrame]:
    """A new store with ``docs`` appended and compacted, and its rows read back."""
    store = ShardStore(docs.sparkSession, new_table(docs.sparkSession, "shards"))
    store.append(docs)
    store.compact(target)
    rows = store.read(schema=docs.schema)
    return store, rows


def query(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Every document as a compacted store of five arrivals returns it: doc_id, source, lang, n_bytes of its text, the arrival it came with and the version that first had it.

    ``since`` is looked up in the manifests as they were before the compaction;
    files that the compaction has replaced are found through the old version.
    """
    store = ShardStore(docs.sparkSession, new_table(docs.sparkSession, "shards"))
    narrow = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"), arrival(F.col("doc_id")).alias("arrival"))
    for k in range(len(ARRIVALS)):
        last = store.append(narrow.filter(F.col("arrival") == k + 1))
    store.compact(target)
    came = store.located(last).select("arrival", "file").distinct().join(store.files(last), F.col("file") == F.col("path")).groupBy("arrival").agg(F.min("since").alias("since")) if store.files(last).head(1) else docs.sparkSession.createDataFrame([], "arrival bigint, since bigint")
    came = materialise(came, "shard-since")  # a row per arrival
    rows = store.read(schema=narrow.schema).join(F.broadcast(came), "arrival")
    return rows.select("doc_id", "source", "lang", F.octet_length("text").cast("bigint").alias("n_bytes"), "arrival", "since")
