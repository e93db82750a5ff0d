"""Every core query against its SQL on the smallest tables."""

import pytest
from tests.compare import connect, matches

from treeline.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    if name in catalog.ORACLE:
        assert matches(spark, duck, catalog.QUERIES[name], catalog.ORACLE[name], SMALL) == ""
    else:
        assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
