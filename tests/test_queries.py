"""Every registered query of the core against its SQL; those without SQL must run and give rows."""

import pytest

from zoomloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, compare):
    sql = registry.oracle_sql().get(name)
    if sql:
        compare(registry.queries()[name], sql)
    else:
        assert registry.queries()[name](spark, compare.folder).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
