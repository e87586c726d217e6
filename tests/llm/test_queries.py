"""Every query of the subpackage runs over the smallest tables with its columns."""

import pytest

from lodeflow.llm import queries

COLUMNS = {
    "p3_found": ["record_table", "record_id", "secret_start", "secret_end"],
    "p4_found": ["example_id", "group_key"],
    "p5_found": ["call_id", "defect"],
    "p6_found": ["kept_entry_id", "dup_entry_id"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "pii_type", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.limit(1).count() == 1
