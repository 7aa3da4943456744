"""Set algebra over key lists (single-column tables)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(table: DataFrame) -> DataFrame:
    return table.select(F.col(table.columns[0]).alias("acc")).filter("acc is not null")


def union_of(lists: list[DataFrame]) -> DataFrame:
    """Keys of any list."""
    return reduce(DataFrame.unionByName, map(_keys, lists)).distinct()


def common_to(lists: list[DataFrame]) -> DataFrame:
    """Keys of all lists, however often a list repeats them."""
    return reduce(DataFrame.intersect, map(_keys, lists))


def only_in_first(first: DataFrame, rest: list[DataFrame]) -> DataFrame:
    """Keys of the first list that no other has."""
    return reduce(lambda a, b: a.join(_keys(b), "acc", "left_anti"), rest, _keys(first).distinct())


def repeated(lists: list[DataFrame], times: int) -> DataFrame:
    """Keys that occur *times* or more in the lists together, repeats within a list included."""
    bag = reduce(DataFrame.unionByName, map(_keys, lists))
    return bag.groupBy("acc").agg(F.count("*").alias("n")).filter(F.col("n") >= times).select("acc")
