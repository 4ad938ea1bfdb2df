"""Held-out accuracy, and the conditional random field against enumeration."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import quality_crf as crf
from gridloom.llm import toxicity_mil as mil

from ..helpers import DATA


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")


@pytest.mark.parametrize("module, label, least", [(crf, "quality", 0.99), (mil, "toxic", 0.96)])
def test_held_out(spark, tables, module, label, least):
    docs, labels = tables
    got = module.query(docs, labels)
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    both = got.join(labels, "doc_id").filter("held_out").selectExpr(f"avg(int(predicted = {label}))", "count(*)").first()
    assert both[1] > 500 and both[0] >= least


def test_labels_and_other_columns_are_no_input(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    docs = docs.filter("doc_id < 2000")
    for module in (crf, mil):
        a = {r.doc_id: r.score for r in module.query(docs, labels).collect()}
        changed = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
        b = {r.doc_id: r.score for r in module.query(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), changed).collect()}
        assert a == pytest.approx(b)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    owner = np.array([0, 0, 0, 0, 1, 2, 2])
    u, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pairs = crf.marginals(owner, u, moves)
    for o in range(3):
        at = np.flatnonzero(owner == o)
        total, each, joint = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(u[i] * b for i, b in zip(at, y, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += w
            each += w * np.array(y)
            for k, (a, b) in enumerate(itertools.pairwise(y)):
                joint[k, a, b] += w
        np.testing.assert_allclose(good[at], each / total, atol=1e-9)
        np.testing.assert_allclose(pairs[at], joint / total, atol=1e-9)


def test_noisy_or():
    texts = pa.array(["fine words. an idiotx here! more", "fine words. more", None, "", "idiotx idiotx"])
    base = ["good words only here.\nnothing bad", "all fine. really"]
    train = pa.array([*(f"{b} {k}. you idiotx {k}" for k in range(20) for b in base), *(f"{b} {k}" for k in range(40) for b in base)])
    model = mil.train(train, np.array([1] * 40 + [0] * 80, np.int8))
    from gridloom.llm._bytes import chunks

    _, _, t = next(iter(chunks(texts)))
    total, start, end, owner, p = mil.score(t, model)
    assert total[0] > 0.5 > total[1] and total[2] == total[3] == 0 and total[4] > 0.5
    for k in range(5):
        assert total[k] == pytest.approx(1 - np.prod(1 - p[owner == k]))
    worst = np.flatnonzero(owner == 0)[np.argmax(p[owner == 0])]
    assert t.raw[start[worst] : end[worst]].tobytes().decode().strip() == "an idiotx here"


def test_odd(spark, odd):
    labels = spark.createDataFrame([(100 + k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (5, None, None), (100, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (crf, mil):
        for known in (labels, labels.limit(0)):
            got = module.query(odd, known).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert module.query(odd.limit(0), labels).count() == 0
        spans = module.apply(odd, module.fit(odd, labels))
        assert spans.count() == odd.count()
