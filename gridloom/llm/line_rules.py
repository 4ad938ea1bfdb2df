"""Quality rules by cross-document line frequency.

A line's identity is its words, A-Z lower-cased, whatever white space stands
between them. For each host the distinct documents that hold a line are
counted; exact copies of one text count once. A line held by more than
``max_docs`` distinct documents of its host is removed from all of them, but for
the one with the smallest doc_id if ``keep_first``, so that something of a large
group stays. A document that has lost more than ``max_lost`` of its words is rejected, as is
one that fails the base rules.

Words, lines and documents are known by 64-bit hashes; of n distinct lines two
share one with a chance of about n * n / 2**65, and then count as one line. A
very long text is measured whole, in one task; what it counts for elsewhere is
one row a line. There are no ties but of the smallest doc_id, whose rows all keep
their lines. Null text counts as empty and fails the base rules; a null host is a host of
its own; rows that agree in all columns get one verdict each, the same one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks, mix, pair
from ._store import BROADCAST_BYTES, materialise, small_side

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Distinct documents of a host that may hold a line; share of its words that a document may lose.
MAX_DOCS, MAX_LOST = 20, 0.8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("at", pa.int32())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("content", pa.int64()), ("lines", _LINES)])
SCHEMA = "doc_id bigint, host string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content bigint, lines array<struct<h:bigint,w:int,at:int>>"


def repeats(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equals an earlier one of its owner, equals another one of its owner) for each key; owners ascend."""
    n = len(key)
    order = np.lexsort((np.arange(n), key, owner)) if n else np.zeros(0, np.int64)
    k, o = key[order], owner[order]
    same = np.zeros(n, bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    either = same.copy()
    either[:-1] |= same[1:]
    again, twice = np.zeros(n, bool), np.zeros(n, bool)
    again[order], twice[order] = same, either
    return again, twice


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, t in chunks(batch.column("text")):
            ws, we = t.words()
            owner = t.owner(ws)
            n_words = np.bincount(owner, minlength=t.n)
            first = np.zeros(t.n + 1, np.int64)
            np.cumsum(n_words, out=first[1:])
            lead = (t.raw & 0xC0) != 0x80  # one byte of each character
            chars = np.bincount(owner, t.count(lead, ws, we), minlength=t.n).astype(np.int64)
            h, as_is = t.hashes(ws, we), t.hashes(ws, we, fold=False)
            # three-word windows, each by its first word
            covered = np.zeros(len(ws) + 2, np.int64)
            if len(ws) > 2:
                at = np.flatnonzero(owner[2:] == owner[:-2])
                twice = repeats(owner[at], pair(pair(as_is[at], as_is[at + 1]), as_is[at + 2]))[1]
                for k in range(3):
                    covered[at[twice] + k] = 1
            n_repeat = np.bincount(owner, covered[: len(ws)], minlength=t.n).astype(np.int64)
            # lines with a word: exact text for duplicates, words for the line's identity
            ls, le = t.lines()
            lo = t.owner(ls)
            wl = np.searchsorted(ls, ws, "right") - 1
            n_in = np.bincount(wl, minlength=len(ls))
            has = np.flatnonzero(n_in)
            exact = t.hashes(ls[has], le[has], fold=False)
            n_dup = np.bincount(lo[has], repeats(lo[has], exact)[0], minlength=t.n).astype(np.int64)
            rank = np.arange(len(ws)) - (np.cumsum(n_in) - n_in)[wl] if len(ws) else np.zeros(0, np.int64)
            line_key = _fold(h, rank, n_in[has], np.flatnonzero(rank == 0))
            content = np.zeros(t.n, np.uint64)
            some = np.flatnonzero(n_words)
            content[some] = _fold(h, np.arange(len(ws)) - first[owner], n_words[some], first[some])
            per = np.bincount(lo[has], minlength=t.n)
            offsets = np.zeros(t.n + 1, np.int32)
            np.cumsum(per, out=offsets[1:])
            items = pa.StructArray.from_arrays([pa.array(line_key.view(np.int64)), pa.array(n_in[has].astype(np.int32)), pa.array((has - np.searchsorted(lo, lo[has])).astype(np.int32))], fields=list(_LINES.value_type))
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), rows.column("host").cast(pa.string()), rows.column("text_key"), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, t.count(_SYMBOL[t.raw], t.start, t.end), n_dup, n_repeat)), pa.array(content.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items)],
                schema=_OUT,
            )


def _fold(h: np.ndarray, rank: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each run of word hashes; rank is a word's place in its run."""
    if not len(first):
        return np.zeros(0, np.uint64)
    part = mix(h + mix(rank.astype(np.uint64)))
    return mix(np.add.reduceat(part, first) + size.astype(np.uint64))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures and hashed lines of every row; ``text_key`` and doc_id find the row again."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        # the prefix keeps a null host apart from every named one
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
    )
    return narrow.mapInArrow(_measure, SCHEMA)


def _judged(docs: DataFrame, host: str, max_docs: int, max_lost: float, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` with its figures and verdict, and (row, at, w) for each line that goes; ``at`` counts a row's lines from 0."""
    rows = materialise(measure(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-rules")
    lines = rows.select("row", "doc_id", "host", "content", F.explode("lines").alias("line")).select("row", "doc_id", "host", "content", F.col("line.at").alias("at"), F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    counts = lines.groupBy("host", "h", "content").agg(F.min("doc_id").alias("first")).groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    # the lines above the limit are the hot ones; they are few, and a shuffle of them is only made if they aren't
    above = materialise(counts.filter(F.col("n_docs") > max_docs).select("host", "h", "first"), "lines-above")
    gone = lines.join(small_side(above), ["host", "h"])
    if keep_first:
        gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.select("row", "at", "w")
    lost = gone.groupBy("row").agg(F.sum("w").alias("lost"))
    out = rows.drop("lines").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_removed_words") > max_lost * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("lost", "content"), gone


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, keep_first: bool = True) -> DataFrame:
    """One row per row of ``docs`` with its figures, the words it loses and the verdict."""
    return _judged(docs, host, max_docs, max_lost, keep_first)[0].drop("row", "host")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    bad = judge(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = small_side(materialise(bad, "rejected"))
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["bad_id"]) & (key == bad["bad_key"]), "left_anti")


def remove_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, keep_first: bool = True) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines that go; n_chars, if there, is counted anew."""
    judged, gone = _judged(docs, host, max_docs, max_lost, keep_first)
    # rows that agree in these three have the same lines and verdict
    places = gone.groupBy("row").agg(F.collect_list("at").alias("gone_at"))
    keys = [F.col("doc_id").alias("gone_id"), F.col("host").alias("gone_host"), F.col("text_key").alias("gone_key")]
    marked = judged.filter(~F.col("kept") | (F.col("n_removed_words") > 0)).join(places, "row", "left").select(*keys, "kept", "gone_at")
    marked = materialise(marked.dropDuplicates(["gone_id", "gone_host", "gone_key"]), "lines-gone")
    size = marked.agg(F.sum(80 + 2 * F.octet_length("gone_host") + 8 * F.coalesce(F.size("gone_at"), F.lit(0)))).first()[0] or 0
    marked = F.broadcast(marked) if size <= BROADCAST_BYTES else marked
    own_host = F.coalesce(F.concat(F.lit("="), docs[host].cast("string")), F.lit(""))
    same = docs["doc_id"].cast("bigint").eqNullSafe(marked["gone_id"]) & (own_host == marked["gone_host"]) & (F.xxhash64(docs["text"].cast("string")) == marked["gone_key"])
    # the lines are a variable, so that the text is split once and not once a line
    some = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), marked["gone_at"])
    left = F.get(F.transform(F.array(F.split(docs["text"], "\n", -1)), lambda ls: F.array_join(F.transform(some(ls), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    text = F.when(marked["gone_at"].isNull(), docs["text"]).otherwise(left)
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(marked["gone_at"].isNull(), docs["n_chars"]).otherwise(F.length(text).cast(kind)).alias("n_chars")
    joined = docs.join(marked, same, "left").filter(F.coalesce(marked["kept"], F.lit(True)))
    return joined.select(*(changed.get(c, docs[f"`{c}`"]) for c in docs.columns))
