"""Every library query that SQL can express against DuckDB."""

import pytest
from conftest import same_rows

from textloom.plans import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    same_rows(queries.queries()[name](spark, small), duck, SQL[name])


def test_family_a_has_37_columns(spark, small):
    df = queries.queries()["q33b_metrics_family_a"](spark, small)
    assert len(df.columns) == 38 and df.count() == 200
