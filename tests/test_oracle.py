"""Every registered query runs; those with SQL equal DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from tests import oracle

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, connection, name):
    frame = entry_module.queries()[name](spark, DIRECTORY)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        # All columns are computed, which a count would prune away.
        frame.write.format("noop").mode("overwrite").save()
        assert not frame.isEmpty()
    else:
        assert oracle.compare(frame, connection, sql) == ""


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["evidence_key"] for r in rows} == {"monthly_comparison", "segment_contribution"}
