"""Operators that SQL can express, beside their SQL over whole tables."""

import pytest
from compare import connect, differences

from pileflow.llm import queries as Q

SF = "/root/testdata/sf0.001"
CON = connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(Q.queries()[name](spark, SF), Q.oracle_sql()[name], CON) == ""
