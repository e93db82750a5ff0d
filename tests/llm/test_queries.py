"""Text queries with SQL against DuckDB on the smallest tables."""

import pytest
from tests.compare import connect, matches

from treeline.llm import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, name):
    assert matches(spark, connect(SMALL), catalog.QUERIES[name], catalog.ORACLE[name], SMALL) == ""
