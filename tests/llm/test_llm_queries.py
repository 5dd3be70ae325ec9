import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sqlcheck import differing  # noqa: E402

from marklake.llm import queries as llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equal_to_sql(spark, small, name):
    assert differing(spark, llm.queries()[name], llm.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, small, name):
    assert llm.queries()[name](spark, small).count() > 0
