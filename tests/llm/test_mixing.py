import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.llm import mixing

from .conftest import words


def highest(value, cap, total):
    """Seats one after another."""
    q = [0] * len(value)
    for _ in range(total):
        best = max((i for i in range(len(value)) if q[i] < cap[i]), key=lambda i: (value[i] / (2 * q[i] + 1), -i), default=None)
        if best is None:
            break
        q[best] += 1
    return q


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.floats(0.01, 50), st.integers(0, 60)), min_size=1, max_size=8))
def test_seats(parts):
    value, cap = np.array([v for v, _ in parts]), np.array([c for _, c in parts])
    total = int(value.sum() + 0.5)
    assert mixing.seats(value, cap, total).tolist() == highest(value, cap, total)


def test_targets(spark):
    sources = spark.createDataFrame([("b", 100), ("a", 10), (None, 1000), ("c", 50)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    # a (weight 5) is full at 30; the rest share 1130 by their weights
    assert got == {"a": 30.0, "b": 282.5, "c": 141.25, None: 706.25}


def test_mix(spark, docs):
    rows = [(k, " ".join(words(5 + 37 * k % 400, k)), f"s{k % 4}") for k in range(120)]
    frame = docs(rows)
    taken = {r.doc_id: r.taken for r in mixing.query(frame).collect()}
    again = {r.doc_id: r.taken for r in mixing.query(frame.repartition(7)).collect()}
    assert taken == again
    sizes = {k: len(t.split()) for k, t, _ in rows}
    assert all(0 <= taken[k] <= 3 * n for k, n in sizes.items())
    plan = mixing.query(frame).groupBy("source", "target").sum("taken").collect()
    for r in plan:
        assert abs(r["sum(taken)"] - r["target"]) <= 0.02 * r["target"] + mixing.BLOCK
    out = mixing.mix(frame).collect()
    got: dict = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(dict((k, t) for k, t, _ in rows)[r.doc_id].split()) and r.n_chars == len(r.text)
    assert got == {k: n for k, n in taken.items() if n}


def test_odd(spark, odd):
    got = mixing.query(odd).collect()
    assert len(got) == odd.count()
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert mixing.query(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_many_sources(spark, docs):
    """Targets of few seats are met too, none short in all shards alike; by the contract alone, from the words of the mix."""
    rows = [(k, " ".join(words(3 + k % 9, k)), f"s{k % 150:03d}") for k in range(150 * 40)]
    got = mixing.query(docs(rows)).groupBy("source", "target", "source_size").sum("taken").collect()
    assert len(got) == 150
    for w in range(3):
        some = [r for r in got if int(r.source[1:]) % 3 == w]
        # half a block of rounding is 8 percent of the least target
        assert abs(sum(r["sum(taken)"] for r in some) / sum(r.target for r in some) - 1) < 0.05
    assert all(abs(r["sum(taken)"] - r.target) <= 1.5 * mixing.BLOCK for r in got)


def test_rows_without_key(spark, docs):
    """Null doc_ids are spread over the shards; rows that share one are taken alike however the input lies."""
    frame = docs([(None, f"a b c {k}", "s") for k in range(4000)])
    sizes = [r["count"] for r in mixing.plan(frame).groupBy("shard").count().collect()]
    assert max(sizes) < 1500 and len(sizes) == 4
    twins = docs([(k // 4, " ".join(words(20 + k % 17, k)), f"s{k % 2}") for k in range(400)])
    of = lambda f: sorted((r.doc_id, r.size, r.taken) for r in mixing.query(f).collect())
    assert of(twins) == of(twins.repartition(5).orderBy("n_chars"))


def water(sizes, weights, repeats):
    """Targets by pouring: all words to all sources by weight, again and again until none is above its brim."""
    target, rest, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and rest > 1e-9:
        share = rest / sum(weights[s] for s in open_)
        rest = 0.0
        for s in sorted(open_):
            target[s] += share * weights[s]
            if target[s] >= repeats * sizes[s]:
                rest += target[s] - repeats * sizes[s]
                target[s] = float(repeats * sizes[s])
                open_.discard(s)
    return target


@settings(deadline=None, max_examples=6, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=9))
def test_targets_by_pouring(spark, sizes):
    by = {f"s{k}": n for k, n in enumerate(sizes)}
    frame = spark.createDataFrame(list(by.items()), "source string, source_size bigint")
    want = water(by, {f"s{k}": mixing.WEIGHTS[k % 3] for k in range(len(sizes))}, 3)
    assert {r.source: r.target for r in mixing.targets(frame).collect()} == pytest.approx(want)
