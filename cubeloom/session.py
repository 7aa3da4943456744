"""Session helpers: shared folder, written intermediate tables, places in an order."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cubeloom-shared-")
        with contextlib.suppress(Exception):
            spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* as a table in the shared folder: lineage ends there, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order: list[Column], amount: Column) -> DataFrame:
    """*df* in sorted ranges, written, with the range, the place in it and the sum of *amount* over all ranges before."""
    inside = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits number the rows of a partition, in its order.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = written(inside.withColumn("__range", F.spark_partition_id()).withColumn("__at", number), "places")
    sizes = sorted((r["__range"], r["size"]) for r in ranged.groupBy("__range").agg(F.sum(amount).alias("size")).collect())  # as many as partitions
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    table = df.sparkSession.createDataFrame(offsets, "__range int, __offset long")
    return ranged.join(F.broadcast(table), "__range")


def with_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """*df* with each row's place (from 1) in *order*: ranges are sorted by themselves, their sizes give the offsets."""
    return _ranged(df, order, F.lit(1)).withColumn(name, F.col("__offset") + F.col("__at") + 1).drop("__range", "__at", "__offset")


def with_running(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """*df* with the sum of *amount* up to and with each row in *order*, a range at a time."""
    upto = F.sum(amount).over(Window.partitionBy("__range").orderBy("__at"))
    return _ranged(df, order, amount).withColumn(name, F.col("__offset") + upto).drop("__range", "__at", "__offset")


def with_running_max(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """*df* with the greatest *amount* up to and with each row in *order*; null while there is none."""
    ranged = _ranged(df.withColumn(name, amount), order, F.lit(1)).drop("__offset")
    own = {r["__range"]: r["most"] for r in ranged.groupBy("__range").agg(F.max(name).alias("most")).collect()}  # as many as partitions
    before, most = [], None
    for part in sorted(own):
        before.append((part, most))
        most = own[part] if most is None else most if own[part] is None else max(most, own[part])
    table = df.sparkSession.createDataFrame(before, "__range int, __before long")
    upto = F.max(name).over(Window.partitionBy("__range").orderBy("__at"))
    return ranged.join(F.broadcast(table), "__range").withColumn(name, F.greatest(upto, F.col("__before"))).drop("__range", "__at", "__before")
