"""Every registered query against DuckDB over the smallest tables."""

import pytest
from check_oracle import compare, connect

from khata.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name)
    assert result.startswith("ok") or result.startswith("rows only"), result
    assert "EMPTY" not in result and result != "rows only: 0", result


def test_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["issue_type", "severity", "issues", "total_impact"]
