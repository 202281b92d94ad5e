"""The queries that SQL can express against that SQL in DuckDB."""

import pytest

from tapedeck.llm import queries
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    compare(spark, sf_dir, name, queries.QUERIES[name], queries.SQL[name])
