"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential comes from features of the line
and of the lines before and after it, and neighbouring labels have a potential
of their own. The field is trained on lines that take their document's label;
a document's quality is the mean of its lines' marginal chances of being good,
by forward-backward, weighted by their length.

A very long text is one chain, scored whole in one task, and its lines' chances
are scaled line by line, so that no number of lines underflows; a line whose
chance is exactly one half counts as good. Lines without a word are left out, except that a text without any word counts
as one empty line, as does null; such texts are scored like all others. A null
doc_id is scored; repeated rows are scored alike; an empty table gives an empty
result; without labels every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Texts, chunks
from ._labels import fold, sample
from .line_rules import repeats

#: Labelled documents that training may use; passes over them; pull of the weights to 0.
SAMPLE, STEPS, SHRINK = 3000, 150, 1e-3
THRESHOLD = 0.3


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_LETTER = _UPPER | _class(bytes(range(97, 123))) | (np.arange(256) >= 128)
_SYMBOL, _SHOUT, _END, _INNER = _class(b"#*$%&|<>{}[]\\/=_~^@"), _class(b"!"), _class(b".!?\"')"), _class(b",;:")


def lines_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight, features of the line alone) of every line that counts."""
    ws, we = t.words()
    ls, le = t.lines()
    of = np.searchsorted(ls, ws, "right") - 1
    n_words = np.bincount(of, minlength=len(ls))
    owner = t.owner(ls)
    blank = np.bincount(owner, n_words, minlength=t.n) == 0
    first_line = np.append(True, owner[1:] != owner[:-1]) if len(ls) else np.zeros(0, bool)
    use = np.flatnonzero((n_words > 0) | (blank[owner] & first_line))
    size = (le - ls).astype(float)
    h = t.hashes(ws, we)
    again, _ = repeats(of, h)
    next_to = np.zeros(len(ws), bool)
    next_to[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    nw, sz = np.maximum(n_words, 1), np.maximum(size, 1)
    share = lambda marks: t.count(marks[t.raw], ls, le) / sz
    last = t.raw[np.maximum(le - 1, 0)]
    letters = np.maximum(share(_LETTER), 1e-9)
    of_words = lambda marks: np.bincount(of, marks, minlength=len(ls)) / nw
    tail = t.raw[we - 1] if len(ws) else np.zeros(0, np.uint8)
    dup = np.zeros(len(ls))
    dup[use] = repeats(owner[use], t.hashes(ls[use], le[use]))[1]
    x = np.stack(
        [
            np.log1p(size), np.log1p(n_words), np.minimum(size / nw, 30), letters, share(_UPPER) / letters, share(_DIGIT), share(_SYMBOL), share(_SHOUT), share(_INNER),
            _END[last] & (size > 0), of_words(_SYMBOL[tail]), of_words(_SHOUT[tail]), of_words(again), of_words(next_to), dup, size == 0,
        ],
        axis=1,
    ).astype(float)
    return owner[use], np.maximum(size[use], 1.0), x[use]


def with_neighbours(owner: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after; a missing neighbour is marked."""
    n, k = x.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k] = x
    if n:
        same = owner[1:] == owner[:-1]
        out[1:, k : 2 * k][same] = x[:-1][same]
        out[:-1, 2 * k : 3 * k][same] = x[1:][same]
        out[0, -3] = out[-1, -2] = 1
        out[1:, -3], out[:-1, -2] = ~same, ~same
    out[:, -1] = 1
    return out


@dataclass
class Model:
    """Feature scales, weights of good against bad, and log potentials of (label, next label)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def potentials(self, owner: np.ndarray, x: np.ndarray) -> np.ndarray:
        u = with_neighbours(owner, (x - self.mean) / self.scale) @ self.weights
        return np.clip(u, -30, 30)


def marginals(owner: np.ndarray, u: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for each line, and the expected count of each (label, next label) by line; lines of a text stand together."""
    n = len(u)
    p = np.empty((n, 2))
    p[:, 1] = 1 / (1 + np.exp(-u))
    p[:, 0] = 1 - p[:, 1]
    p = np.maximum(p, 1e-13)
    t = np.exp(moves)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    a, b = np.empty((n, 2)), np.ones((n, 2))
    longest = int(size[0]) if n else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts with so many lines
    for k in range(longest):
        i = first[: live[k]] + k
        x = p[i] if k == 0 else (a[i - 1] @ t) * p[i]
        a[i] = x / x.sum(axis=1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        i = first[: live[k + 1]] + k
        x = (b[i + 1] * p[i + 1]) @ t.T
        b[i] = x / x.sum(axis=1, keepdims=True)
    m = a * b
    m /= m.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    if n > 1:
        i = np.flatnonzero(owner[1:] == owner[:-1])
        joint = a[i][:, :, None] * t[None] * (p[i + 1] * b[i + 1])[:, None, :]
        pairs[i] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return m[:, 1], pairs


def train(text: pa.Array, label: np.ndarray, steps: int = STEPS) -> Model:
    """Weights by Adam on the conditional likelihood of the lines' labels."""
    k = 16
    bare = Model(np.zeros(k), np.ones(k), np.zeros(3 * k + 3), np.zeros((2, 2)))
    if not len(label) or label.all() or not label.any():
        return bare
    owners, xs = [], []
    for i, _, t in chunks(text):
        owner, _, x = lines_of(t)
        owners.append(owner + i)
        xs.append(x)
    owner, x = np.concatenate(owners), np.concatenate(xs)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    f = with_neighbours(owner, (x - mean) / scale)
    y = label[owner].astype(float)
    # a text counts as the square root of its lines
    each = 1 / np.sqrt(np.bincount(owner, minlength=len(label)))[owner]
    each /= each.sum()
    same = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[same].astype(int), y[same + 1].astype(int)), each[same])
    w, moves = np.zeros(f.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, pairs = marginals(owner, np.clip(f @ w, -30, 30), moves)
        g = np.append(f.T @ ((good - y) * each) + SHRINK * w, ((pairs * each[:, None, None]).sum(axis=0) - seen + SHRINK * moves).ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-4]
        moves = np.clip(moves - move[-4:].reshape(2, 2), -8, 8)
    return Model(mean, scale, w, moves)


def score(t: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality of each text; then the text and the chance of good of each line that counts."""
    owner, weight, x = lines_of(t)
    good, _ = marginals(owner, model.potentials(owner, x), model.moves)
    total = np.bincount(owner, weight * good, minlength=t.n) / np.bincount(owner, weight, minlength=t.n)
    return np.clip(total, 0.0, 1.0), owner, good


SCHEMA = "doc_id bigint, held_out boolean, score double, n_lines bigint, n_bad_lines bigint, line_scores array<double>"


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """Per document its quality and the chance of good of each of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in chunks(batch.column("text")):
                total, owner, good = score(t, model)
                n = np.bincount(owner, minlength=t.n)
                offsets = np.zeros(t.n + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(total), pa.array(n.astype(np.int64)), pa.array(np.bincount(owner, good < 0.5, minlength=t.n).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(good))],
                    names=["doc_id", "held_out", "score", "n_lines", "n_bad_lines", "line_scores"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    return train(*sample(docs, labels, "quality", limit))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = apply(docs, fit(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
