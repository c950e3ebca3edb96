"""Operators that SQL expresses, against DuckDB on the small tables."""

import pytest

from skyweave import llm
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    assert assert_same(spark, llm.queries()[name], llm.oracle_sql()[name])
