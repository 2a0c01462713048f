"""Every registered query next to its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from eqpanel.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name].run(spark, sf)
    assert {f.name for f in df.schema.fields if f.dataType.typeName() == "double"} == set(QUERIES[name].digits)
    if name in ORACLES:
        assert compare(df, ORACLES[name], con) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
