"""Every core query against its SQL on the smallest tables; queries without SQL must give rows."""

import pytest

from lodeflow.plans import catalog
from tests.compare import connect, rows_of_spark, rows_of_sql

MAY_BE_EMPTY = {"trade_orphans", "cycle_nodes", "without_urgent", "annotation_labels", "propagate_one_hop", "trade_closure", "sanitized_findings"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows_of_spark(df) == rows_of_sql(connect(sf_dir), sql)
    elif name not in MAY_BE_EMPTY:
        assert df.limit(1).count() == 1


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
