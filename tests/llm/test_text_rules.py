"""Line rules, and the byte scanner under them."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import _bytes, line_rules

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None, max_examples=80)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB ñ文\n\t.é ", max_size=40)), max_size=6), st.integers(1, 50))
def test_words_and_lines(texts, limit):
    found, lines, hashes = {}, {}, {}
    for i, _, t in _bytes.chunks(pa.array(texts, pa.string()), limit):
        s, e = t.words()
        for o, a, b, h in zip(t.owner(s), s, e, t.hashes(s, e), strict=True):
            w = t.raw[a:b].tobytes().decode()
            found.setdefault(i + int(o), []).append(w)
            assert hashes.setdefault(w.translate(LOW), h) == h
        s, e = t.lines()
        for o, a, b in zip(t.owner(s), s, e, strict=True):
            lines.setdefault(i + int(o), []).append(t.raw[a:b].tobytes().decode())
    for k, x in enumerate(texts):
        assert found.get(k, []) == WORD.findall(x or "")
        assert lines[k] == (x or "").split("\n")
    assert len(set(hashes.values())) == len(hashes)


def brute(rows, max_docs, max_lost):
    holders: dict = {}
    for i, text, host in rows:
        body = tuple(w.translate(LOW) for w in WORD.findall(text or ""))
        for line in (text or "").split("\n"):
            if key := tuple(w.translate(LOW) for w in WORD.findall(line)):
                holders.setdefault((host, key), []).append((body, i))
    out = []
    for i, text, host in rows:
        ws = WORD.findall(text or "")
        tri = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        covered = {k + j for k, g in enumerate(tri) if tri.count(g) > 1 for j in range(3)}
        lost = 0
        for line in (text or "").split("\n"):
            key = tuple(w.translate(LOW) for w in WORD.findall(line))
            h = holders.get((host, key), [])
            if key and len({b for b, _ in h}) > max_docs and i != min((j for _, j in h if j is not None), default=None):
                lost += len(key)
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        seen: list = []
        dup = 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.append(line)
        out.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), lost, failed, not failed and not lost > max_lost * len(ws)))
    return sorted(map(repr, out))


def test_brute_force(spark, docs):
    shared = " ".join(words(45, 77))
    rows = []
    for k in range(40):
        own = [" ".join(words(9, 100 * k + j, 30)) for j in range(3 + k % 4)]
        host = None if k % 7 == 0 else f"h{k % 2}"
        text = "\n".join([*own, shared.upper() if k % 3 else f"  {shared} ", "A line|of all", "A line|of all"])
        rows.append((k, text, host))
    rows += [(50, shared + "\nx", "h1"), (51, shared + "\nx", "h1"), (None, shared + "\ny z", "h1"), (1, None, "h0"), (2, "", None)]
    got = line_rules.judge(docs(rows), "source", 5, 0.6).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == brute(rows, 5, 0.6)
    assert any(r["n_removed_words"] for r in got)


def test_filter(spark, odd):
    kept = line_rules.filter_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, *range(100, 112)]
    assert line_rules.filter_documents(odd.limit(0)).count() == 0
    assert line_rules.query(odd).count() == odd.count()


def test_remove_lines(spark, docs, odd):
    shared = " ".join(words(12, 77))
    own = [[" ".join(words(30, 10 * k + j)) for j in range(2)] for k in range(30)]
    rows = [(k, f"{own[k][0]}\n\n  {shared.upper() if k % 2 else shared}\n{own[k][1]}\n{shared}\n", "h" if k < 25 else "other") for k in range(30)]
    rows += [(7, rows[7][1], "h"), (40, shared, "h"), (None, rows[9][1], "h")]
    frame = docs(rows)
    out = line_rules.remove_lines(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect())
    # the smallest doc_id keeps its lines, as do documents of a host with few of them
    bare = lambda k: f"{own[k][0]}\n\n{own[k][1]}\n"
    assert got == sorted([(-1, bare(9)), (7, bare(7)), (0, rows[0][1]), *((k, bare(k)) for k in range(1, 25)), *((k, rows[k][1]) for k in range(25, 30))])
    assert out.filter("n_chars <> length(text)").count() == 0
    assert line_rules.remove_lines(odd).count() == line_rules.filter_documents(odd).count()
    assert line_rules.remove_lines(odd.limit(0)).count() == 0


def test_repeats():
    owner, key = np.array([0, 0, 0, 1, 1]), np.array([5, 6, 5, 5, 7])
    again, twice = line_rules.repeats(owner, key)
    assert again.tolist() == [False, False, True, False, False] and twice.tolist() == [True, False, True, False, False]
