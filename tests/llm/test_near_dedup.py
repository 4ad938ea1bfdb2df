import random

import numpy as np
import pytest

from gridloom.llm import near_dedup
from gridloom.llm._graph import components

from .conftest import words


def sets(text, k):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def brute(rows, k):
    s = [sets(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    comp: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            comp[find(i)] = min(comp.get(find(i), r[0]), r[0])
    return sorted(repr((r[0], len(s[i]), comp.get(find(i)))) for i, r in enumerate(rows))


def mutated(ws, share, seed):
    r = random.Random(seed)
    return [f"m{seed}_{i}" if r.random() < share else w for i, w in enumerate(ws)]


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(spark, docs, k):
    rows, i = [], 0
    for g in range(8):
        base = words(30 + 23 * g, g)
        for c in range(1 + g % 5 * 3):
            rows.append((i, " ".join(mutated(base, 0.012 * c, 1000 * g + c)), "s"))
            i += 1
    rows += [(i + k, " ".join(words(n, 500 + n)), "s") for k, n in enumerate((1, 1, 2, 3, 4, 5, 6, 7))]
    rows += [(i + 20, rows[0][1].upper(), "s"), (i + 21, None, "s"), (i + 22, "", "s"), (i + 23, "Word", "s"), (i + 24, "word", "s"), (None, rows[3][1], "s"), (0, rows[0][1], "s")]
    got = near_dedup.resolve(docs(rows), k).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, k)


def test_smallest_sets(spark, docs):
    """A 5-word text and its 6-word extension share 4 of 5 shingles, exactly 80 percent; 3 of 4 aren't enough."""
    rows = [(10 * n + j, " ".join(words(n + j, n, 10**6)), "s") for n in (2, 3, 4, 5, 6) for j in (0, 1)]
    rows += [(100 + 10 * s + j, " ".join(words(5 + j, 60 + s, 10**6)), "s") for s in range(6) for j in (1, 0, 2)]
    got = near_dedup.resolve(docs(rows), 2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, 2)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[51] == by_id[50] == 50 and by_id[41] == 41 and by_id[102] == by_id[101] == by_id[100] == 100


def test_large_cluster(spark, docs):
    """More members than a chunk holds; links among them are few and reach across chunks."""
    base = words(300, 1)
    rows = [(i, " ".join(mutated(base, 0.01 + 0.0006 * i, i)), "s") for i in range(260)]
    got = near_dedup.resolve(docs(rows), 2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, 2)


def test_one_left(spark, docs, odd):
    base = words(80, 3)
    rows = [(9 - i, " ".join(mutated(base, 0.01, i)), "s") for i in range(4)] + [(2, "other text", "s"), (2, "other text", "s"), (None, "left alone", "s"), (None, "left alone", "s")]
    out = near_dedup.deduplicate(docs(rows), 2)
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 2), (False, 6), (True, None)]
    # texts without a word link with nothing, so all three stay; of the repeated row one does
    assert near_dedup.deduplicate(odd).count() == odd.count() - 1
    assert near_dedup.deduplicate(odd.limit(0)).count() == 0


def test_shared_and_components(spark):
    rng = np.random.default_rng(0)
    many = [np.unique(rng.integers(0, 40, n, dtype=np.uint64)) for n in (5, 30, 0, 12)]
    got = near_dedup.shared(many)
    assert got[0, 1] == len(np.intersect1d(many[0], many[1])) and got[1, 3] == len(np.intersect1d(many[1], many[3])) and got[2].sum() == 0
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    roots = dict(map(tuple, components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()))
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_many_small_sets(spark, docs, k):
    """Sets of 1 to 12 shingles, many pairs of them at exactly 80 percent; no link lost or made up."""
    rng = random.Random(k)
    rows = []
    for n in range(1, 13):
        for g in range(6):
            ws = words(n + k - 1, 1000 * n + g, 10**6)
            for variant in (ws, [*ws, "tail"], ["head", *ws], [*ws, "tail", "more"], ws[: max(1, len(ws) - 1)], ws[::-1]):
                rows.append((len(rows), " ".join(variant), "s"))
    rng.shuffle(rows)
    got = near_dedup.resolve(docs(rows), k).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, k)
