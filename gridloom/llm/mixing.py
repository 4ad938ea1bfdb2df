"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are dealt to shards by a seeded hash. Within a shard the documents of
one source, in seeded order, form a stream of words that is cut into blocks of
``block`` words (the last may be shorter). Every block is a seat: each shard
apportions its seats to its sources by the highest quotients v / (2 k + 1),
where v is the number of blocks that the source's target calls for there. Of a
source's n blocks in a shard, a quota q takes every block q // n times and q % n
of them once more, evenly spaced from a seeded start.

A source takes part in as many shards as its target has SEATS seats for, at most
in all, so that rounding to whole seats weighs little in every shard; a source
with few rows or a low target is in few. So a stream holds no more than
``shard_rows`` documents on average, or SEATS seats' worth of a source that is
thinned out, whatever a source's share of the rows.

Targets share ``share`` of all words by weight; a target stops at ``repeats``
times its source's size and the excess is shared again by weight.

Null or blank text has size 0 and is never taken; a very long text is one
document, of which blocks are taken like of others; a null source is a source of
its own, last in order. Rows with a null doc_id are dealt by their text and
number, so that they don't meet in one shard; rows that share a doc_id stand
beside each other in a stream in order of their text's hash, repeated rows in
any order, and each is taken as a document of its own. Ties in quotients go to
the first source. An empty table gives an empty result; other columns are
ignored by :func:`plan` and kept by :func:`mix`.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words in a block; rows in a shard; most times a word is taken.
BLOCK, SHARD_ROWS, REPEATS = 32, 1024, 3
#: Seats that a source has in a shard, at least, unless it is in one shard only.
SEATS = 64
SEED = "mix-1"


def number(text: Column) -> Column:
    """A number below 2**60 from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient of whole numbers that aren't negative."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order).cast("bigint"))
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    # by the level at which each source is full; the level sought is that before the first source that it doesn't fill
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("rest", rest).withColumn("open", open_weight).withColumn("place", F.row_number().over(by_level))
    fits = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("open")
    level = F.min_by(F.when(fits, F.col("rest") / F.col("open")), F.when(fits, F.col("place"))).over(whole)
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "rank", "weight", "target")


def seats(value: np.ndarray, cap: np.ndarray, total: int) -> np.ndarray:
    """Sainte-Lague: ``total`` seats to the highest value / (2 k + 1), at most ``cap`` each; ties go to the first."""
    q = np.minimum(np.floor(value + 0.5).astype(np.int64), cap)
    short = total - int(q.sum())
    if short > 0:
        heap = [(-v / (2 * k + 1), i) for i, (v, k, c) in enumerate(zip(value.tolist(), q.tolist(), cap.tolist(), strict=True)) if k < c]
        heapq.heapify(heap)
        for _ in range(short):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            q[i] += 1
            if q[i] < cap[i]:
                heapq.heappush(heap, (-float(value[i]) / (2 * int(q[i]) + 1), i))
    elif short < 0:
        heap = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(value.tolist(), q.tolist(), strict=True)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            q[-i] -= 1
            if q[-i] > 0:
                heapq.heappush(heap, (float(value[-i]) / (2 * int(q[-i]) - 1), i))
    return q


def _apportion(repeats: int):
    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        value = rows["value"].to_numpy(float)
        rows["quota"] = seats(value, repeats * rows["n"].to_numpy(np.int64), int(np.floor(value.sum() + 0.5)))
        return rows[["shard", "rank", "n", "quota"]]

    return shard


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard_rows: int = SHARD_ROWS, repeats: int = REPEATS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, taken, shard, and its place in the mix.

    ``start`` is the document's first word in its stream; ``n``, ``quota`` and
    ``turn`` say which blocks of the stream are taken. ``row`` names a column
    that identifies rows; without it rows are numbered.
    """
    text = F.col("text").cast("string")
    sized = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), number(F.coalesce(text, F.lit(""))).alias("text_key"))
    sized = materialise(sized, "mix-sizes")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", F.col("text_key"), F.col("row")))
    shards = max(1, -(-sized.count() // shard_rows))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    # one row per source; written, so that its true size decides how it is joined
    most = F.least(F.floor(F.col("target") / (block * SEATS)).cast("bigint"), F.lit(shards).cast("bigint"))
    by_source = materialise(by_source.withColumn("spread", F.greatest(most, F.lit(1).cast("bigint"))), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = sized.join(by_source, same(sized, by_source)).drop(by_source["source"])
    # a source's shards follow each other from a seeded first
    first = number(F.concat_ws("/", F.lit(seed), F.lit("source"), F.col("rank")))
    dealt = dealt.withColumn("shard", (first % shards + number(F.concat(F.lit(seed), key)) % F.col("spread")) % shards)
    streams = dealt.groupBy("shard", "rank").agg(div(F.sum("size") + (block - 1), block).alias("n"), F.first("target").alias("t"), F.first("source_size").alias("z"))
    streams = streams.filter("n > 0").withColumn("value", F.col("t") / F.col("z") * F.col("n"))
    quotas = materialise(streams.groupBy("shard").applyInPandas(_apportion(repeats), "shard bigint, rank bigint, n bigint, quota bigint"), "mix-quotas")

    stream = Window.partitionBy("shard", "rank").orderBy(number(F.concat(F.lit(seed + "/"), key)), "doc_id", "text_key", "row")
    placed = dealt.withColumn("start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(quotas, ["shard", "rank"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("quota", F.coalesce("quota", F.lit(0)))
    placed = placed.withColumn("turn", F.pmod(number(F.concat_ws("/", F.lit(seed), F.col("shard"), F.col("rank"))), F.col("n")))

    def upto(x: Column) -> Column:
        """Words taken of the first x words of a stream."""
        extra = F.col("quota") % F.col("n")
        picked = lambda m: div((m + F.col("turn")) * extra, F.col("n"))
        whole = div(x, block)
        return div(F.col("quota"), F.col("n")) * x + (picked(whole) - picked(F.lit(0))) * block + (picked(whole + 1) - picked(whole)) * (x % block)

    placed = placed.withColumn("taken", (upto(F.col("start") + F.col("size")) - upto(F.col("start"))).cast("bigint"))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", "taken", "shard", "start", "n", "quota", "turn")


def query(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document taken whole comes with its text as it is; one taken in part comes
    with the words of its taken blocks, one space between them.
    """
    row = fresh(docs, "mix_row")
    taken_text = fresh(docs, f"{row}_text")
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    take = plan(held, block=block, row=row, **options).filter("taken > 0").select(F.struct("size", "start", "n", "quota", "turn", div(F.col("quota"), F.col("n")).alias("times")).alias("p"), F.col("row").alias("r"))
    j = held.join(take, held[row] == take["r"])
    p = take["p"]
    picked = lambda k: div((k + p["turn"]) * (p["quota"] % p["n"]), p["n"])
    first, last = div(p["start"], block), div(p["start"] + p["size"] - 1, block)
    blocks = F.filter(F.sequence(first, last), lambda k: picked(k + 1) > picked(k))
    words = F.regexp_extract_all(held["text"].cast("string"), F.lit(f"({WORD})"))
    begin = lambda k: F.greatest(k * block - p["start"], F.lit(0).cast("bigint"))
    cut = lambda ws, k: F.slice(ws, (begin(k) + 1).cast("int"), (F.least((k + 1) * block - p["start"], p["size"]) - begin(k)).cast("int"))
    # the words are a variable, so that they are found once and not once a block
    some = F.get(F.transform(F.array(words), lambda ws: F.flatten(F.transform(blocks, lambda k: cut(ws, k)))), F.lit(0))
    part = F.when(F.size(blocks) == last - first + 1, held["text"].cast("string")).when(F.size(blocks) > 0, F.array_join(some, " "))
    copies = F.concat(F.array_repeat(held["text"].cast("string"), p["times"].cast("int")), F.array_compact(F.array(part)))
    out = j.select(*(held[f"`{c}`"] for c in docs.columns), F.explode(copies).alias(taken_text))
    text = F.col(taken_text)
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(*(f"`{c}`" for c in docs.columns))
