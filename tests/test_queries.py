import pytest
from compare import rows_of_spark, rows_of_sql

from quarry.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    got, want = rows_of_spark(QUERIES[name](spark, data)), rows_of_sql(ORACLES[name], data)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1] or name == "catalog_select", "no rows"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
