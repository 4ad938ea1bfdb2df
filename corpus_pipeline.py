"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a frame; all but the last return the columns of ``documents``. A stage's
result is written and read again before the next.

Every stage takes null, empty and very long texts, null keys, ties, repeated
rows, empty tables and further columns; what becomes of each is said by the
operator that the stage calls. Null and empty texts don't pass the first stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_rules, mixing, near_dedup, sharding
from gridloom.llm._store import delete, discard, documents, materialise, scope, table
from gridloom.llm.pipeline_sql import PIPELINE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables that the last stage's result reads.
_left: list[str] = []


def _stage(f: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the one before, but for those that its input still reads.

    The first stage deletes nothing: the last result of an earlier run may still be wanted.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if run_stage is STAGES[0][1]:
            _left.clear()
        elif _left:
            read = docs.inputFiles()
            for path in _left:
                if not any(path.removeprefix("file://") in x for x in read):
                    delete(spark, path)
            _left.clear()
        with scope() as paths:
            out = f(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are not depleted of lines that their host repeats, without those lines."""
    return line_rules.remove_lines(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup.deduplicate(docs, 5)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, repeats included."""
    return mixing.mix(docs)


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as read back from its compacted shards, with each text's bytes."""
    _, rows = sharding.shard(docs)
    return rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mix),
    ("sharding", shards),
]

ORACLE_SQL: str | None = PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, before, sf_dir), f"stage-{name}")
        if k:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
