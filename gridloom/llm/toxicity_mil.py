"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from the
words it holds; a document is toxic if any sentence is, so that the sentences'
scores p combine by noisy-or, 1 - prod(1 - p). Word weights are trained through
that combination from document labels alone, and the sentence scores then say
where the offence lies.

A very long text is one bag, scored whole in one task; a sentence that scores
exactly THRESHOLD offends; words are known by 64-bit hashes. Null, empty and
wordless texts have no sentence and score 0; a null doc_id is
scored like any other; repeated rows are scored alike; an empty table gives an
empty result; without labels every score is the bare prior; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Texts, chunks, mix
from ._labels import fold, sample

#: Labelled documents that training may use; passes over them.
SAMPLE, STEPS = 4000, 200
#: Features: words, and their first so many bytes, so that inflected forms share weight.
PREFIXES = (4, 5, 6, 7)
#: Documents that must hold a feature, and the chi-square with the label that it must reach, to have a weight.
MIN_DOCS, MIN_CHI2 = 5, 10.0
#: Prior log-odds of a sentence at first; variance of weights around 0.
PRIOR, VARIANCE = -6.0, 8.0
THRESHOLD = 0.5

_BREAK = np.ones(256, bool)  # what isn't a letter, a digit or part of a character beyond ASCII
_BREAK[128:] = _BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the prior log-odds."""

    words: np.ndarray
    weights: np.ndarray
    prior: float

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(h.shape)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.weights[at], 0.0)


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.zeros(len(marks) + 2, bool)
    w[1:-1] = marks
    edge = np.flatnonzero(w[1:] != w[:-1])
    return edge[::2], edge[1::2]


def features(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of feature hashes per word; a prefix that isn't shorter than its word is the hash 0."""
    cols = [t.hashes(start, end)]
    for k in PREFIXES:
        cols.append(np.where(end - start > k, mix(t.hashes(start, np.minimum(end, start + k)) + np.uint64(k)), np.uint64(0)))
    return np.stack(cols, axis=1)


def instances(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each sentence, each word's sentence, word features, each sentence's text; no sentence without a word."""
    ws, we = _runs(~_BREAK[t.raw])
    ss, se = _runs(~_STOP[t.raw])
    of = np.searchsorted(ss, ws, "right") - 1
    used, of = np.unique(of, return_inverse=True)
    ss, se = ss[used], se[used]
    return ss, se, of, features(t, ws, we), t.owner(ss)


def associated(text: pa.Array, label: np.ndarray, min_docs: int, min_chi2: float) -> np.ndarray:
    """Sorted hashes of the features whose presence in a document goes with its label."""
    all_h, all_y = [], []
    for i, _, t in chunks(text):
        _, _, of, h, owner = instances(t)
        one = np.unique(np.stack([np.repeat(owner[of] + i, h.shape[1]).astype(np.uint64), h.ravel()]), axis=1)
        one = one[:, one[1] != 0]
        all_h.append(one[1])
        all_y.append(label[one[0].astype(np.int64)])
    h, y = np.concatenate(all_h), np.concatenate(all_y)
    order = np.argsort(h, kind="stable")
    h, y = h[order], y[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64)
    n = np.diff(np.append(first, len(h))).astype(float)
    bad = np.add.reduceat(y.astype(float), first)
    share = label.mean()
    chi2 = (bad - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9) * len(label) / np.maximum(len(label) - n, 1)
    return h[first][(n >= min_docs) & (chi2 >= min_chi2)]


def train(text: pa.Array, label: np.ndarray, steps: int = STEPS, min_docs: int = MIN_DOCS, min_chi2: float = MIN_CHI2) -> Model:
    """Weights by Adam on the noisy-or likelihood of the documents' labels."""
    if not len(label) or not label.any() or label.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), PRIOR)
    names = associated(text, label, min_docs, min_chi2)
    n_docs, sentences = len(label), 0
    plain = np.zeros(n_docs)  # sentences without any feature
    s_parts, f_parts, doc_parts = [], [], []
    for i, _, t in chunks(text):
        _, _, of, h, owner = instances(t)
        at = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
        hit = names[at] == h if len(names) else np.zeros(h.shape, bool)
        some, s = np.unique(np.repeat(of, h.shape[1]).reshape(h.shape)[hit], return_inverse=True)
        plain += np.bincount(owner + i, minlength=n_docs) - np.bincount(owner[some] + i, minlength=n_docs)
        one = np.unique(s * np.int64(max(len(names), 1)) + at[hit])
        s_parts.append(one // max(len(names), 1) + sentences)
        f_parts.append(one % max(len(names), 1))
        doc_parts.append(owner[some] + i)
        sentences += len(some)
    s, f, doc = map(np.concatenate, (s_parts, f_parts, doc_parts))
    y = label.astype(float)
    weights, prior = np.zeros(len(names)), PRIOR
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = prior + np.bincount(s, weights[f], minlength=sentences)
        # -log of the chance that no sentence offends
        total = np.bincount(doc, np.logaddexp(0, z), minlength=n_docs) + plain * np.logaddexp(0, prior)
        total = np.maximum(total, 1e-9)
        slope = (1 - y) - y * np.exp(-total) / -np.expm1(-total)
        dz = slope[doc] * _logistic(z)
        g = np.append(np.bincount(f, dz[s], minlength=len(names)) + weights / VARIANCE, dz.sum() + (slope * plain).sum() * _logistic(prior)) / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        prior -= move[-1]
    return Model(names, weights, float(prior))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(t: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document scores; then each sentence's start, end, text and score."""
    ss, se, of, h, owner = instances(t)
    z = model.prior + np.bincount(of, model.weigh(h).sum(axis=1), minlength=len(ss))
    total = np.bincount(owner, np.logaddexp(0, z), minlength=t.n)
    return -np.expm1(-total), ss, se, owner, _logistic(z)


SCHEMA = "doc_id bigint, held_out boolean, score double, n_offending bigint, spans array<struct<start:bigint,end:bigint,score:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """Per document its score and ``spans``: byte offsets and scores of the offending sentences, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in chunks(batch.column("text")):
                total, ss, se, owner, p = score(t, model)
                bad = np.flatnonzero(p >= THRESHOLD)
                n = np.bincount(owner[bad], minlength=t.n)
                offsets = np.zeros(t.n + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                at = t.start[owner[bad]]
                items = pa.StructArray.from_arrays([pa.array(ss[bad] - at), pa.array(se[bad] - at), pa.array(p[bad])], fields=list(_SPAN))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(total), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc_id", "held_out", "score", "n_offending", "spans"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    return train(*sample(docs, labels, "toxic", limit))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = apply(docs, fit(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending", "spans")
