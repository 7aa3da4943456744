"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from cubeloom.plans import catalogue
from tests.conftest import SMALL, rows_of

CHECKED = sorted(catalogue.oracle_sql())
OTHERS = sorted(set(catalogue.queries()) - set(CHECKED))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sql_rows, name):
    df = catalogue.queries()[name](spark, SMALL)
    columns, expected = sql_rows(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).columns


def test_entry_point_registers_everything(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
