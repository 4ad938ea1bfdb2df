"""Every query against its SQL, or for its shape, on the smallest tables."""

import pytest

from gridloom.llm import queries

from ..helpers import DATA, duck, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE:
        same(got, con.execute(queries.ORACLE[name]).fetchdf())
    else:
        table = "pages" if name.startswith("op2_") else "documents"
        assert len(got) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_scratch_is_deleted(spark, name):
    """Of a query's scratch tables only those stay that its result reads."""
    from gridloom.llm._store import hadoop_path, scope

    with scope() as used:
        out = queries.QUERIES[name](spark, SF)
    left = [p for p in used if hadoop_path(spark, p)[0].exists(hadoop_path(spark, p)[1])]
    assert len(left) <= 4 and out.count() >= 0


def test_pipeline(spark, con):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    same(p.run(spark, SF).toPandas(), con.execute(p.ORACLE_SQL).fetchdf())


def test_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (None, None), (2, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(p.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= 3 * odd.count()
