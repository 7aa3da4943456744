"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


class Rows(list):
    """Rows that are equal to the same rows in any order."""

    def __eq__(self, other) -> bool:
        return sorted(self, key=repr) == sorted(other, key=repr)

    __hash__ = None


def rows_of(df) -> Rows:
    """The rows of a DataFrame, columns by name."""
    columns = sorted(df.columns)
    return Rows(tuple(plain(r[c]) for c in columns) for r in df.collect())


@pytest.fixture(scope="session")
def sql_rows():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def run(sql: str) -> tuple[list[str], list[tuple]]:
        found = connection.sql(sql)
        columns = sorted(found.columns)
        at = [found.columns.index(c) for c in columns]
        return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)

    return run
