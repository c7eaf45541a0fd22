"""Every query of the catalogue against its SQL."""

import pytest
from compare import connect, differences

from cueforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, db, name):
    assert not differences(spark, db, catalogue.QUERIES[name], catalogue.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["video_id", "title", "source", "markdown"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
