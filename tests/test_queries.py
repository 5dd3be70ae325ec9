import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from sqlcheck import differing  # noqa: E402

import __spark_entry__  # noqa: E402
from marklake.plans import queries as core  # noqa: E402


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equal_to_sql(spark, small, name):
    assert differing(spark, core.queries()[name], core.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, small, name):
    df = core.queries()[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_slots_are_read_back(spark, small):
    rows = core.queries()["slots_read"](spark, small).collect()
    assert sum(r.right for r in rows) >= 0.99 * sum(r.members for r in rows) and sum(r.found - r.right for r in rows) <= 0.01 * sum(r.found for r in rows)
