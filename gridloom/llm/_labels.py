"""Labelled rows for training, and the split that keeps every fifth document out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of labelled texts that training may use.
SAMPLE_BYTES = 64 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; a null doc_id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, most: int = SAMPLE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Whole texts and 0/1 labels of at most ``limit`` labelled documents outside the held-out fold, of ``most`` bytes in all.

    The documents are those whose doc_id has the smallest MD5, whatever the
    table's size or order, but for those that would exceed the bytes. Conflicting
    labels of one doc_id count as their maximum, of different texts the smallest
    by hash. Only ``limit`` doc_ids are ever broadcast, and their texts collected
    after their lengths.
    """
    key = F.col("doc_id").cast("bigint")
    chosen = (
        labels.select(key.alias("label_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
        .filter(fold(F.col("label_id")) != 0)
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id")
        .limit(limit)
    )
    ids = dict(map(tuple, chosen.collect()))
    spark = docs.sparkSession
    narrow = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = F.broadcast(spark.createDataFrame(list(ids.items()), "label_id bigint, label int"))
    facts = narrow.join(few, F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("f"))
    of = {r[0]: (r[1], r[2] or 0) for r in facts.select("label_id", "f.h", "f.n").collect()}
    rows, left = [], most
    for i, y in ids.items():
        if i in of and of[i][1] <= left:
            left -= of[i][1]
            rows.append((i, of[i][0], y))
    few = F.broadcast(spark.createDataFrame(rows, "label_id bigint, h bigint, label int"))
    # of rows with one text one is taken
    got = narrow.join(few, (F.col("doc_id") == F.col("label_id")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["label_id"]).orderBy("label_id")
    table = got.select("text", "label").toArrow()
    text = table.column("text").combine_chunks()
    return (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), table.column("label").to_numpy().astype(np.int8)
