"""Every core query against its SQL on the smallest tables."""

import pytest

from gridloom import catalog
from gridloom.plans import report

from .helpers import DATA, duck, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE:
        same(got, con.execute(catalog.ORACLE[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name, scans, shuffles",
    [
        ("resample_mean", 1, 2),
        ("climatology_doy_mean", 1, 2),
        ("climatology_nanpercentile", 1, 2),
        ("climatology_rank_average", 1, 2),
        ("anomaly_sub", 1, 2),
        ("threshold_events_climatology", 1, 2),
        ("event_values_stats", 2, 4),
        ("regrid_bilinear", 2, 3),
    ],
)
def test_plans(spark, name, scans, shuffles):
    """One shuffle makes the series; what an operator adds to it, and no cross join."""
    got = report.operators(catalog.QUERIES[name](spark, SF))
    assert got["FileScan"] <= scans and got["Exchange"] <= shuffles and not got["CartesianProduct"] and not got["BroadcastNestedLoopJoin"]
