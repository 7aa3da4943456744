"""Cells are dealt to shares, so that a task holds a known number of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import cube
from cubeloom.plans import catalogue
from cubeloom.plans import fixtures as fx
from tests.conftest import SMALL, rows_of


def _most(df) -> int:
    """The rows of the largest partition."""
    return df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]


def test_a_task_has_a_share_of_the_cells(spark, monkeypatch):
    monkeypatch.setattr(fx, "_SHARE", 300)
    rows = fx.table(spark, SMALL, "lineitem").count()
    assert fx.shares(spark, SMALL) == -(-rows // 300)
    assert _most(fx.cube_l(spark, SMALL)) < 600
    assert _most(catalogue.queries()["rollup_rank_keep_items"](spark, SMALL)) < 600
    whole = fx.cube_l(spark, SMALL)
    monkeypatch.setattr(fx, "_SHARE", 10**9)
    assert fx.shares(spark, SMALL) == 1 and rows_of(whole) == rows_of(fx.cube_l(spark, SMALL))


def test_shares_of_no_rows_and_of_cells_that_meet(spark):
    cells = [("a", "x", 1), ("a", "x", 2), (None, "x", 3), (None, "x", 4), ("a", None, None), ("b", "y", 5)]
    some = spark.createDataFrame(cells, "samplename string, otuname string, nreads long")
    expected = [("x", 3, "a"), ("x", 7, None), (None, None, "a"), ("y", 5, "b")]
    for n in (None, 1, 3):
        assert sorted(((r.otuname, r.nreads, r.samplename) for r in cube.summed(some, n).collect()), key=repr) == sorted(expected, key=repr)
    assert cube.summed(some.limit(0), 2).isEmpty()


@pytest.mark.parametrize("name", ["rollup_rank", "topn_brands"])
def test_a_roll_up_keeps_the_shares_of_its_cells(spark, monkeypatch, name):
    """The taxa are summed within the tasks of the cells, before the one shuffle that is left."""
    monkeypatch.setattr(fx, "_SHARE", 300)
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f"{fx.shares(spark, SMALL)}), REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["rollup_rank", "topn_brands", "filter_items_exact"])
def test_rows_stay_where_a_large_list_is_joined_after_a_shuffle(spark, name):
    """Lists of 6 GB of tables are too large for a broadcast, those of the small tables aren't."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    query = catalogue.queries()[name]
    expected = rows_of(query(spark, SMALL))
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = query(spark, SMALL)
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert rows_of(found) == expected
    finally:
        spark.conf.set(key, usual)


def test_listed_items_keep_the_shares_of_their_cells(spark, monkeypatch):
    monkeypatch.setattr(fx, "_SHARE", 300)
    assert _most(catalogue.queries()["filter_items_exact"](spark, SMALL)) < 600
    plan = catalogue.queries()["filter_items_exact"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f"{fx.shares(spark, SMALL)}), REPARTITION_BY_NUM" in plan
