import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import _elias_fano as ef
from gridloom.llm import lm_trie as lm

from .conftest import words


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=200), st.integers(0, 63))
def test_elias_fano(values, shift):
    v = np.sort(np.array([x >> shift for x in values], np.uint64))
    data = ef.encode(v)
    s = ef.Sequence(np.frombuffer(b"\0" * 8 + data, np.uint8), 8)
    assert s.size == len(data) and s.n == len(v)
    if len(v):
        assert (s.access(np.arange(len(v))) == v).all()
    first = {int(x): i for i, x in reversed(list(enumerate(v.tolist())))}
    if len(v) > 1:
        i = np.arange(len(v) - 1)
        at, x = s.place(i)
        assert (x == v[:-1]).all() and (s.after(i + 1, at) == v[1:]).all()
        # from the element before, wherever the next lies
        zeros = (x >> np.uint64(s.l)).astype(np.int64)
        assert (s.find(v[1:], i + 1, i + 2, (at + 1, zeros)) == i + 1).all()
    ask = np.unique(np.concatenate([v, v + np.uint64(1), np.array([0, 5, (1 << 64) - 1], np.uint64)]))
    assert s.find(ask).tolist() == [first.get(int(x), -1) for x in ask]


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 50_000, dtype=np.uint64))
    assert len(ef.encode(v)) * 8 / len(v) < (40 - np.log2(len(v))) + 3


def test_bounded_search():
    """Equal values in neighbouring ranges are told apart by the bounds."""
    s = ef.Sequence(np.frombuffer(ef.encode(np.array([3, 7, 7, 9, 9, 9, 12], np.uint64)), np.uint8))
    lo, hi = np.array([0, 2, 3, 5, 6]), np.array([2, 3, 5, 6, 7])
    assert s.find(np.array([7, 7, 9, 9, 9]), lo, hi).tolist() == [1, 2, 3, 5, -1]


@given(st.floats(1e-12, 1.0))
def test_quantise(p):
    q = lm.LEVELS[lm.quantise(np.array([p]))[0]]
    assert q <= p * (1 + 1e-9) and (q == 0 or q >= p * 10 ** (-1.001 / lm.STEPS))
    w = lm.weight_of(lm.quantise(np.array([p]), lm.WEIGHT_STEPS, np.uint16))[0]
    assert w <= p * (1 + 1e-9) and w >= p * 10 ** (-1.001 / lm.WEIGHT_STEPS)


def reference(rows, order):
    """(held_out, n_tokens, n_known, N, base, score) of each row by plain counting."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for _, t, _ in rows]
    out_ = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    c, grams = Counter(), Counter()
    for ws, held in zip(tokens, out_, strict=True):
        if not held:
            c.update(ws)
            s = ["<s>", *ws]
            grams.update(tuple(s[i - k : i + 1]) for i in range(1, len(s)) for k in range(1, order) if i - k >= 0)
    n, v = sum(c.values()), len(c)
    total, size = Counter(), Counter()
    for g, k in grams.items():
        total[g[:-1]] += k
        size[g[:-1]] += 1
    q = lambda p: lm.LEVELS[lm.quantise(np.array([p]))[0]]
    short = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    weight = {h: lm.weight_of(lm.quantise(np.array([lm.DISCOUNT * size[h] / total[h]]), lm.WEIGHT_STEPS, np.uint16))[0] for h in total}

    def p(history, w):
        out = short(w)
        for k in range(1, order):
            h = tuple(history[-k:])
            if len(h) == k and h in total:
                out = out * weight[h] + (q((grams[*h, w] - lm.DISCOUNT) / total[h]) if (*h, w) in grams else 0.0)
        return out

    rows_ = []
    for ws, held in zip(tokens, out_, strict=True):
        s = ["<s>", *ws]
        rows_.append((held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(short(w)) for w in ws), sum(math.log10(p(s[:i], s[i])) for i in range(1, len(s)))))
    own: dict = defaultdict(float)
    for g, k in grams.items():
        own[g[:-1]] += q((k - lm.DISCOUNT) / total[g[:-1]])
    assert all(own[h] + weight[h] <= 1 + 1e-9 for h in total)
    return rows_


def check(got, rows, order=lm.ORDER):
    want = sorted(zip([r[0] is None for r in rows], [r[0] or 0 for r in rows], reference(rows, order), strict=True))
    have = sorted((r.doc_id is None, r.doc_id or 0, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    for (a, i, x), (b, j, y) in zip(have, want, strict=True):
        assert (a, i) == (b, j) and x == pytest.approx(y, rel=1e-9, abs=1e-9)


def sample_rows():
    rows = [(k, " ".join(words(3 + 5 * k % 60, k, 25)).replace("w3", "W3"), "s") for k in range(60)]
    return rows + [(100, None, "s"), (101, "", "s"), (102, "never seen", "s"), (None, "w1 w2 w3", "s"), (5, rows[5][1], "s")]


@pytest.mark.parametrize("order, part", [(1, 40), (2, 7), (2, 10**6), (3, 40), (3, 7), (4, 100)])
def test_brute_force(spark, docs, monkeypatch, order, part):
    monkeypatch.setattr(lm, "PART", part)  # many files, and contexts that go on over several
    rows = sample_rows()
    model, tokens = lm.train(docs(rows), order)
    assert len(model.levels) == order - 1 and (part > 7 or order < 2 or len(set(model.levels[0].context)) < len(model.levels[0].context))
    check(lm.apply(tokens, model).collect(), rows, order)


def test_search_is_by_pointers(spark, docs, monkeypatch):
    """Without the pointers, successors aren't found: ids are relative to their context."""
    rows = sample_rows()
    model, tokens = lm.train(docs(rows), 3)
    want = {(r.doc_id, r.n_tokens): r.score for r in lm.apply(tokens, model).collect()}
    paths = [model.levels[0].paths[0], model.levels[1].paths[0]]
    f = lm.GramFile(lm._map(paths[0]))
    context = np.repeat(np.arange(f.contexts), [h - lo for lo, h in zip(*(x.tolist() for x in f.ranges(np.arange(f.contexts))[:2]), strict=True)])
    lo, _, base, _ = f.ranges(context)
    place = np.arange(f.successors.n)
    token = (f.successors.access(place) - base).astype(np.int64)
    assert (f.find(context, token) == place).all() and token.max() <= model.end
    flat = lambda self, k: (np.zeros(len(k), np.int64), np.full(len(k), self.successors.n), np.zeros(len(k), np.uint64), np.zeros(len(k), np.int64))
    monkeypatch.setattr(lm.GramFile, "ranges", flat)
    assert (f.find(context, token) == place).mean() < 0.2
    assert want


def test_single_pairs_count(spark, docs):
    """A pair that occurs once is in the trie, and counts for a held-out text."""
    held, learnt = (next(k for k in range(50) if (zlib.crc32(str(k).encode()) % 5 == 1) is x) for x in (True, False))
    got = {r.doc_id: r for r in lm.query(docs([(learnt, "one two three four", "s"), (held, "one two three four", "s")])).collect()}
    assert got[held].score > got[held].base_score + 1


def test_odd(spark, docs, odd):
    assert lm.query(odd).count() == odd.count()
    assert lm.query(odd.limit(0)).count() == 0
    held = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = [(held, "nothing to learn from", "s")]
    check(lm.query(docs(rows)).collect(), rows)


def test_better_than_words_alone(spark):
    from ..helpers import DATA

    got = lm.query(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1] + 1000


def test_numbers_beyond_four_bytes():
    """Contexts and successors of any size that 64 bits hold."""
    context, size = np.array([1 << 40, (1 << 40) + 3]), np.array([2, 1])
    token, count = np.array([5, 1 << 45, 7]), np.array([1 << 41, 3, 1])
    f = lm.GramFile(np.frombuffer(lm.GramFile.encode(context, size, token, count, {}), np.uint8))
    assert f.find(np.array([0, 0, 3]), token).tolist() == [0, 1, 2] and f.find(np.array([1, 3]), np.array([5, 8])).tolist() == [-1, -1]
    big = np.array([1 << 61, 3, 1 << 61]), np.array([9, 1 << 40, 2])
    assert np.argsort(lm.keys(*big)).tolist() == [1, 2, 0]
    w = lm.WordFile(np.frombuffer(lm.WordFile.encode(np.array([4, 9], np.uint64), np.array([1 << 40, 2])), np.uint8))
    assert w.counts.tolist() == [1 << 40, 2]
