"""Every query of the catalog against its SQL, on the smallest tables."""

import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if got[c].dtype.kind in "fiu":
            assert ((got[c] - want[c]).abs().fillna(0) <= 1.01e-6).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["x", "y", "z", "val"]
