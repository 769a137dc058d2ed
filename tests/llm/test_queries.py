"""The queries that SQL can express, against their SQL."""

import pytest

from tallyloom.llm.queries import LLM
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in LLM.items() if q.sql])
def test_query_equals_sql(spark, name):
    problems, n = compare(LLM[name], spark, connect(SF), SF)
    assert not problems and n
