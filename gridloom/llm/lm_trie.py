"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training word: its hash in an Elias-Fano sequence, its count
beside it; a word's id is its place. Level k holds all k-grams that occur, in
order of their context, a place in level k - 1, and of the last word's id. For
every context there is a monotone pointer to the range of its successors and a
quantised weight of the shorter context; for every successor its id and its
quantised probability. Successor ids are kept relative to their context: each
range counts on from the last value of the range before, which makes the whole
one Elias-Fano sequence. So a k-gram is found by reading its context's two
pointers and the value before the range, and by a search between the pointers.
Levels lie in files of the shared folder, a file per range of k-grams, which
every executor maps into memory rather than reads; a context with more
successors than a file holds goes on in the next.

Model: interpolated absolute discounting up to ``order`` words,
P(w | h) = max(count(h w) - D, 0) / count(h) + weight(h) P(w | shorter h), where
weight(h) is all that the first terms leave and P(w) = (count(w) + 0.5) /
(N + 0.5 (V + 1)). Nothing is pruned. Quantised numbers are rounded down, so
that the probabilities that follow a context never sum to more than 1. A text is
its words with A-Z lower-cased, after a start mark, and then one end, which is a
token.

Counts and places are 64-bit numbers. A word is known by a 64-bit hash: of n
distinct words two share one with a chance of about n * n / 2**65, and then count
as one word.

Null and empty texts have one token, the end. A very long text is counted and
scored whole, in one task. A null doc_id is scored and, as its fold says, learnt
from; repeated rows count each; ties don't arise, as nothing is ranked; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _elias_fano as ef
from ._bytes import chunks, give_back
from ._labels import fold
from ._store import discard, materialise, new_table

HELD_OUT = 1
ORDER, DISCOUNT = 3, 0.75
#: Steps of a quantised logarithm to one power of ten, of probabilities (one byte) and of weights (two bytes).
STEPS, WEIGHT_STEPS = 32, 4000
#: Entries of a file before equal ones are added up; tokens counted together in a task before they are passed on.
PART, FLUSH = 1_000_000, 1 << 19
#: Sampled pairs to each boundary between files; it decides their sizes, never what they hold.
SAMPLE = 128


def quantise(p: np.ndarray, steps: int = STEPS, kind: type = np.uint8) -> np.ndarray:
    """A number of ``kind`` for each probability, rounded down; the largest stands for all that is smaller."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) * steps - 1e-9), 0, np.iinfo(kind).max).astype(kind)


LEVELS = np.append(10.0 ** (-np.arange(255) / STEPS), 0.0)


def weight_of(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(float) / WEIGHT_STEPS)


# Files of the shared folder, which may be a mounted path or any store that Arrow reaches.


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name of its own, whole or not at all; a task's second attempt writes another."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(f"{p}.part") as f:
        f.write(data)
    fs.move(f"{p}.part", p)
    return path


def _file_system(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _map(path: str) -> np.ndarray:
    """The bytes of a file as a memory map; what isn't on a mounted path is mapped from an unnamed copy, which ends with the map."""
    fs, p = _file_system(path)
    if fs.type_name == "local":
        return np.memmap(p, np.uint8, "r").view(np.ndarray)
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(p) as f:
        while data := f.read(1 << 24):
            copy.write(data)
        copy.flush()
        return np.memmap(copy, np.uint8, "r").view(np.ndarray)


#: Open files of this worker.
_open: dict[str, object] = {}
_MOST_OPEN = 4096


def _opened(path: str, kind: type):
    if path not in _open:
        if len(_open) >= _MOST_OPEN:
            _open.clear()
        _open[path] = kind(_map(path))
    return _open[path]


class WordFile:
    """Ascending hashes, and the count of each."""

    def __init__(self, raw: np.ndarray):
        self.hashes = ef.Sequence(raw)
        self.counts = raw[self.hashes.size : self.hashes.size + 8 * self.hashes.n].view(np.int64)

    @staticmethod
    def encode(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        return ef.encode(hashes - hashes[0]) + counts.astype("<i8").tobytes()


class GramFile:
    """A range of one level: pointers and weights of contexts, relative ids and probabilities of successors."""

    def __init__(self, raw: np.ndarray):
        self.pointers = ef.Sequence(raw)
        at = self.pointers.size
        self.successors = ef.Sequence(raw, at)
        at += self.successors.size
        self.contexts = self.pointers.n - 1
        self.weights = raw[at : at + 2 * self.contexts].view(np.uint16)
        at += 2 * self.contexts
        self.probabilities = raw[at : at + self.successors.n]

    @staticmethod
    def encode(context: np.ndarray, size: np.ndarray, token: np.ndarray, count: np.ndarray, whole: dict[int, tuple[int, int]]) -> bytes:
        """``context`` ascends, each with ``size`` successors; ``whole``: (size, total) of contexts that go on in other files."""
        first = np.cumsum(size) - size
        total = np.add.reduceat(count, first)
        distinct = size.copy()
        for k in (0, len(context) - 1):
            if (w := whole.get(int(context[k]))) is not None:
                distinct[k], total[k] = w
        n = int(context[-1] - context[0]) + 1
        sizes, weights = np.zeros(n, np.int64), np.zeros(n, np.uint16)
        sizes[context - context[0]] = size
        weights[context - context[0]] = quantise(DISCOUNT * distinct / total, WEIGHT_STEPS, np.uint16)
        last = token[first + size - 1]
        values = token + np.repeat(np.cumsum(last) - last, size)
        probabilities = quantise((count - DISCOUNT) / np.repeat(total, size))
        return ef.encode(np.append(0, np.cumsum(sizes))) + ef.encode(values) + weights.tobytes() + probabilities.tobytes()

    def ranges(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last place of the successors of each context, the value that they count on from, and the bit place after that."""
        at, lo = self.pointers.place(k)
        lo, hi = lo.astype(np.int64), self.pointers.after(k + 1, at).astype(np.int64)
        base, bit = np.zeros(len(k), np.uint64), np.zeros(len(k), np.int64)
        on = np.flatnonzero((lo > 0) & (hi > lo))
        bit[on], base[on] = self.successors.place(lo[on] - 1)
        bit[on] += 1
        return lo, hi, base, bit

    def find(self, k: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place of each successor, or -1; contexts ascend."""
        new = np.append(True, k[1:] != k[:-1])
        which = np.cumsum(new) - 1
        lo, hi, base, bit = self.ranges(k[new])
        zeros = np.where(bit > 0, (base >> np.uint64(self.successors.l)).astype(np.int64), 0)
        return self.successors.find(base[which] + token.astype(np.uint64), lo[which], hi[which], (bit[which], zeros[which]))


@dataclass
class Words:
    """Level 1: first hash and first id of each file."""

    paths: list[str] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, or -1."""
        u, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        cut = np.append(np.searchsorted(u, self.first), len(u))
        for i in np.flatnonzero(np.diff(cut)):
            a, b = cut[i], cut[i + 1]
            at = _opened(self.paths[i], WordFile).hashes.find(u[a:b] - self.first[i])
            out[a:b] = np.where(at >= 0, at + self.place[i], -1)
        return out[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each id; 0 for -1."""
        u, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(u), np.int64)
        cut = np.searchsorted(u, self.place)
        for i in np.flatnonzero(np.diff(cut)):
            a, b = cut[i], cut[i + 1]
            out[a:b] = _opened(self.paths[i], WordFile).counts[u[a:b] - self.place[i]]
        return out[back]


@dataclass
class Level:
    """Level 2 or above: of each file, its first (context, successor), its last context and its first place."""

    paths: list[str]
    context: np.ndarray
    token: np.ndarray
    last: np.ndarray
    place: np.ndarray

    def _files(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The file in which each pair would lie, -1 before the first."""
        out = np.searchsorted(self.context, context, "right") - 1
        # contexts that go on over several files: by their successor
        late = np.flatnonzero((out >= 0) & (self.context[out] == context) & (token < self.token[out]))
        for c in np.unique(context[late]):
            a, b = np.searchsorted(self.context, [c, c + 1])
            here = late[context[late] == c]
            out[here] = a - 1 + np.searchsorted(self.token[a:b], token[here], "right")
        return out

    def find(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the level, or -1, and its probability's byte; pairs ascend."""
        out, byte = np.full(len(context), -1, np.int64), np.full(len(context), 255, np.uint8)
        if not self.paths or not len(context):
            return out, byte
        file = self._files(context, token)
        for i in np.unique(file[file >= 0]):
            a, b = np.searchsorted(file, [i, i + 1])
            b = a + np.searchsorted(context[a:b], self.last[i], "right")  # what has no successor here
            if a < b:
                f = _opened(self.paths[i], GramFile)
                at = f.find(context[a:b] - self.context[i], token[a:b])
                hit = np.flatnonzero(at >= 0)
                out[a + hit] = at[hit] + self.place[i]
                byte[a + hit] = f.probabilities[at[hit]]
        return out, byte

    def weights(self, context: np.ndarray) -> np.ndarray:
        """Weight of the shorter context after each context; 1 where nothing follows it. Contexts ascend."""
        out = np.ones(len(context))
        file = np.searchsorted(self.last, context)
        for i in np.unique(file[file < len(self.paths)]):
            a, b = np.searchsorted(file, [i, i + 1])
            a += np.searchsorted(context[a:b], self.context[i])
            if a < b:
                out[a:b] = weight_of(_opened(self.paths[i], GramFile).weights[context[a:b] - self.context[i]])
        return out


@dataclass
class Model:
    """Where the levels are, and the totals: tokens, distinct tokens, documents learnt from."""

    tokens: int
    distinct: int
    documents: int
    words: Words
    levels: list[Level] = field(default_factory=list)

    @property
    def end(self) -> int:
        return int(self.words.place[-1])

    @property
    def start(self) -> int:
        return self.end + 1

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each token."""
        out = self.words.counts(np.where(ids < self.end, ids, -1))
        out[ids == self.end] = self.documents
        return out

    def shorter(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of tokens with the training counts c, without context."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Numbers that are in order as the pairs are."""
    if not len(context):
        return np.zeros(0, np.int64)
    width, low = int(token.max()) + 1, int(context.min())
    if (int(context.max()) - low + 1) * width >= 1 << 63:
        context, low = np.unique(context, return_inverse=True)[1], 0
    return (context - low) * width + token


def grouped(context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and where in it each distinct pair begins."""
    k = keys(context, token)
    order = np.argsort(k)
    k = k[order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


class Stream:
    """Tokens of some texts, one text after another, each after a start mark and before an end."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, model: Model):
        last = np.cumsum(n + 2) - 1
        self.first = last - n - 1
        self.token = np.empty(int((n + 2).sum()), np.int64)
        word = np.ones(len(self.token), bool)
        word[last] = word[self.first] = False
        self.token[word] = ids
        self.token[last], self.token[self.first] = model.end, model.start

    def climb(self, levels: list[Level], weigh: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level, of each token: the place of its context and it, which tokens have a context, and of those probability and weight."""
        at = self.token
        # the start mark is a successor of nothing
        token = np.where(self.token >= 0, self.token, self.token[0])
        for level in levels:
            context = self.contexts(at)
            ask = np.flatnonzero(context >= 0)
            order, first = grouped(context[ask], token[ask])
            order = ask[order]
            one = order[first]
            size = np.diff(np.append(first, len(order)))
            c = context[one]
            found, byte = level.find(c, token[one])
            at = np.full(len(at), -1, np.int64)
            at[order] = np.repeat(found, size)
            weight = byte
            if weigh:
                new = np.append(True, c[1:] != c[:-1]) if len(c) else np.zeros(0, bool)
                weight = np.repeat(level.weights(c[new])[np.cumsum(new) - 1], size)
            yield at, order, np.repeat(byte, size), weight

    def contexts(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        out[1:] = at[:-1]
        out[self.first] = -1
        return out

    def pairs(self, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
        """(context, token) of the next level's k-grams; ``levels`` are those before it."""
        at = self.token
        for at, *_ in self.climb(levels):
            pass
        context = self.contexts(at)
        ok = np.flatnonzero((context >= 0) & (self.token >= 0))
        return context[ok], self.token[ok]

    def scores(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability of every token, start marks too."""
        count = model.counts(self.token)
        p = 10.0 ** model.shorter(count)
        for _, at, byte, weight in self.climb(model.levels, True):
            p[at] = p[at] * weight + LEVELS[byte]
        return count, np.log10(p)


# Training


def _ints(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column, and how many each row has."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _binary(data: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column of rows of n numbers each."""
    offsets = (np.append(0, np.cumsum(n)) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(x: np.ndarray) -> np.ndarray:
    """Whole numbers, none below 0, in one, four or eight bytes each."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<i8")


def _unpacked(cell: pa.Array, n: int) -> np.ndarray:
    """The n numbers of a cell as :func:`_packed` gave them."""
    data = _ints(cell, "u1")[0]
    return data.view({1: "u1", 4: "<u4", 8: "<i8"}[len(data) // max(n, 1)]).astype(np.int64)


def _id_kind(model: Model) -> str:
    return "<i4" if model.start < (1 << 31) - 1 else "<i8"


def _streams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Stream]]:
    """(rows, number of words of each, stream) of runs of rows of about FLUSH tokens."""
    for batch in batches:
        ids, n = _ints(batch.column("ids"), _id_kind(model))
        upto = np.append(0, np.cumsum(n))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + FLUSH, "right")) - 1)
            yield batch.slice(lo, hi - lo), n[lo:hi], Stream(ids[upto[lo] : upto[hi]].astype(np.int64), n[lo:hi], model)
            lo = hi
        give_back()


_BLOB = "part bigint, n bigint, first bigint, step binary, token binary, count binary"


def _blobs(context: np.ndarray, token: np.ndarray, count: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row per part for entries in order: the first context, steps from context to context, tokens, counts."""
    k = keys(np.append(context, bounds[0]), np.append(token, bounds[1]))
    cut = np.concatenate([[0], np.searchsorted(k[: len(context)], k[len(context) :]), [len(context)]])
    size = np.diff(cut)
    part = np.flatnonzero(size)
    step = np.diff(context, prepend=0)
    step[cut[part]] = 0
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (part, size[part], context[cut[part]])), *(_binary(_packed(x), size[part]) for x in (step, token, count))], names=[f.split()[0] for f in _BLOB.split(", ")])


def _counted(pairs_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], bounds: tuple[np.ndarray, np.ndarray]):
    """Counts of all pairs, added up over runs of FLUSH of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            context, token = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = grouped(context, token)
            return _blobs(context[order[first]], token[order[first]], np.diff(np.append(first, len(order))), bounds)

        for context, token in pairs_of(batches):
            held.append((context, token))
            size += len(context)
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


_MERGED = "part bigint, first_context bigint, first_token bigint, last_context bigint, first_size bigint, first_total bigint, last_size bigint, last_total bigint, n bigint, n_contexts bigint, total bigint, step binary, size binary, token binary, count binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part, from blobs that stand together by part."""
    part, held = None, []

    def out() -> pa.RecordBatch:
        context, token, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = grouped(context, token)
        count = np.add.reduceat(n[order], first)
        context, token = context[order[first]], token[order[first]]
        start = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size = np.diff(np.append(start, len(context)))
        total = np.add.reduceat(count, start)
        facts = [part, context[0], token[0], context[-1], size[0], total[0], size[-1], total[-1], len(context), len(start), count.sum()]
        many = [_binary(_packed(x), np.array([len(x)])) for x in (np.append(0, np.diff(context[start])), size, token, count)]
        return pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in facts), *many], names=[f.split()[0] for f in _MERGED.split(", ")])

    for batch in batches:
        for i, p in enumerate(batch.column("part").to_pylist()):
            if p != part:
                if held:
                    yield out()
                part, held = p, []
            step, token, count = (_unpacked(batch.column(c).slice(i, 1), batch.column("n")[i].as_py()) for c in ("step", "token", "count"))
            held.append((np.cumsum(step) + batch.column("first")[i].as_py(), token, count))
    if held:
        yield out()
    give_back()


def _level(blobs: DataFrame, parts: int, folder: str, encode: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict], bytes]) -> tuple[list[str], list]:
    """Files of a level, and the facts of each, in order."""
    dealt = blobs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part")
    merged = materialise(dealt.mapInArrow(_merge, _MERGED), "lm-merged")
    facts = sorted(merged.drop("step", "size", "token", "count").collect())  # one row per file
    # a context that goes on over several files has one total
    whole: dict[int, tuple[int, int]] = {}
    for k, f in enumerate(facts):
        if k and facts[k - 1].last_context == f.first_context:
            before = whole.get(f.first_context, (facts[k - 1].last_size, facts[k - 1].last_total))
            whole[f.first_context] = before[0] + f.first_size, before[1] + f.first_total

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, n, m = (batch.column(c)[i].as_py() for c in ("first_context", "n", "n_contexts"))
                step, size, token, count = (_unpacked(batch.column(c).slice(i, 1), k) for c, k in (("step", m), ("size", m), ("token", n), ("count", n)))
                path = _put(folder, "level", encode(np.cumsum(step) + first, size, token, count, whole))
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(i, 1), pa.array([path])], names=["part", "path"])
            give_back()

    paths = dict(merged.select("part", "first_context", "n", "n_contexts", "step", "size", "token", "count").mapInArrow(write, "part bigint, path string").collect())
    discard(merged)
    return [paths[f.part] for f in facts], facts


def _places(facts: list) -> np.ndarray:
    return np.append(0, np.cumsum([f.n for f in facts])).astype(np.int64)


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, _, t in chunks(batch.column("text")):
            ws, we = t.words()
            h = t.hashes(ws, we)
            # a hash as a pair of smaller numbers, in the same order
            yield (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _write_words(context: np.ndarray, size: np.ndarray, token: np.ndarray, count: np.ndarray, _: dict) -> bytes:
    return WordFile.encode(np.repeat(context, size).astype(np.uint64) << np.uint64(32) | token.astype(np.uint64), count)


def _count_words(learnt: DataFrame, folder: str) -> tuple[Words, int, int]:
    """Level 1, the number of words counted and that of texts."""
    documents, size = learnt.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-(size or 0) // (6 * PART)))
    bounds = np.arange(1, parts, dtype=object) * (1 << 32) // parts, np.zeros(parts - 1, np.int64)
    blobs = learnt.mapInArrow(_counted(_word_pairs, (bounds[0].astype(np.int64), bounds[1])), _BLOB)
    paths, facts = _level(blobs, parts, folder, _write_words)
    first = np.array([f.first_context << 32 | f.first_token for f in facts], np.uint64)
    return Words(paths, first, _places(facts)), sum(f.total for f in facts), documents


def _count_grams(learnt: DataFrame, model: Model, folder: str) -> Level:
    """The level after those that the model has."""
    before = list(model.levels)
    parts = max(1, -(-model.tokens // PART))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, s in _streams(batches, model):
            yield s.pairs(before)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for context, token in pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(context[::8]), pa.array(token[::8])], names=["context", "token"])

    bounds = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if parts > 1:
        sample = learnt.sample(min(1.0, 8.0 * SAMPLE * parts / model.tokens), 1).mapInArrow(some, "context bigint, token bigint").toArrow()
        context, token = (sample.column(c).to_numpy() for c in ("context", "token"))
        order = np.argsort(keys(context, token))
        at = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
        bounds = context[at], token[at]
    paths, facts = _level(learnt.mapInArrow(_counted(pairs, bounds), _BLOB), parts, folder, GramFile.encode)
    of = lambda name: np.array([f[name] for f in facts], np.int64)
    return Level(paths, of("first_context"), of("first_token"), of("last_context"), _places(facts))


def _tokens(model: Model):
    """Each text as the ids of its words."""
    kind = _id_kind(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in chunks(batch.column("text"), 4 << 20):
                ws, we = t.words()
                ids = model.words.ids(t.hashes(ws, we)).astype(kind)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), _binary(ids, np.bincount(t.owner(ws), minlength=t.n))], names=["doc_id", "held_out", "ids"])

    return run


def train(docs: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """The model of the documents outside the held-out fold, and all documents as ids (doc_id, held_out, ids)."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    folder = new_table(docs.sparkSession, "trie")
    words, total, documents = _count_words(narrow.filter(~F.col("held_out")).select("text"), folder)
    model = Model(total + documents, int(words.place[-1]) + (documents > 0), documents, words)
    path = new_table(docs.sparkSession, "lm-tokens")
    narrow.mapInArrow(_tokens(model), "doc_id bigint, held_out boolean, ids binary").write.option("compression", "zstd").parquet(path)
    tokens = docs.sparkSession.read.parquet(path)
    learnt = tokens.filter(~F.col("held_out")).select("ids")
    for _ in range(2, order + 1):
        model.levels.append(_count_grams(learnt, model, folder))
    return model, tokens


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def apply(tokens: DataFrame, model: Model) -> DataFrame:
    """Scores of all documents; ``tokens`` as :func:`train` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n, s in _streams(batches, model):
            count, score = s.scores(model)
            real = np.ones(len(count), bool)
            real[s.first] = False
            owner = np.repeat(np.arange(len(n)), n + 1)
            add = lambda x: np.bincount(owner, x[real], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(n + 1), pa.array(add(count > 0).astype(np.int64)), pa.array(np.full(len(n), model.tokens)), pa.array(add(model.shorter(count))), pa.array(add(score))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return tokens.mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    model, tokens = train(docs)
    return apply(tokens, model)
