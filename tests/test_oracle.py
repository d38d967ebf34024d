"""Every registered query equals its DuckDB oracle on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from batchtrail.plans.registry import all_oracle_sql, all_queries
from tests.conftest import SMALL
from tests.util import canon

QUERIES = all_queries()
ORACLE = all_oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[key])
    d_cols, d_rows = canon([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["machine", "point_time", "point_label", "entry_id", "table_prefix", "row_no", "field", "value"]
    assert df.count() > 0
