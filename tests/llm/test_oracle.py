"""The operators that SQL can express against DuckDB."""

import pytest

from gradeloom.llm import registry
from tests.oracle import agree


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert agree(spark, registry.queries()[name], registry.oracle_sql()[name]) > 0
