"""Structured Streaming forms of the append operators.

The windowed cube is an extension: the format's tables carry no event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cubeloom.operators.neighbours import merged_caches


def windowed_cube(events: DataFrame, sample: str, item: str, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by sample, item and tumbling window of a stream (or table) with event time."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = timed.groupBy(F.window(ts, width).alias("window"), F.col(sample).alias("samplename"), F.col(item).alias("otuname")).agg(F.count("*").alias("nreads"))
    return grouped.select(F.col("window.start").alias("window_start"), "samplename", "otuname", "nreads")


def append_members(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of members to a table; what is there stays."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_cache(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, prefer: str = "small") -> StreamingQuery:
    """Merge batches of ``key, acc`` into a cache, each merge a new version under *path*.

    Where a key is known with other accessions the smaller (or larger) set
    stays.  A batch's version is named by its number, so a batch that is run
    again writes the same version; readers take :func:`latest`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        found = versions(spark, path, number)
        caches = [spark.read.schema("key string, acc string").parquet(f"{path}/v={found[-1]}")] if found else []
        merged_caches([*caches, batch.select("key", "acc")], prefer=prefer).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """The numbers of a cache's versions, in order."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
        numbers = sorted({int(r[0]) for r in files.select(F.regexp_extract("path", r"/v=(\d+)/", 1)).collect() if r[0]})
    except Exception as error:  # a cache that no batch has written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        numbers = []
    return [n for n in numbers if below is None or n < below]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a cache."""
    found = versions(spark, path)
    if not found:
        raise ValueError(f"{path} has no version")
    return spark.read.schema("key string, acc string").parquet(f"{path}/v={found[-1]}")
