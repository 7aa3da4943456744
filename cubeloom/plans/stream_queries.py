"""Queries on append workloads."""

from __future__ import annotations

import uuid

from cubeloom.plans import fixtures as fx
from cubeloom.plans.registry import query
from cubeloom.session import shared_dir
from cubeloom.streaming import append


@query(
    "windowed_cube",
    """SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, CAST(user_id AS VARCHAR) AS samplename, event_type AS otuname, count(*) AS nreads FROM events GROUP BY ALL""",
)
def windowed_cube(spark, d):
    events = fx.table(spark, d, "events").selectExpr("ts", "cast(user_id as string) as samplename", "event_type")
    return append.windowed_cube(events, "samplename", "event_type", width="1 day")


@query("streamed_members", f"{fx.cte('reads_e')} SELECT otuname, readname FROM reads_e")
def streamed_members(spark, d):
    """Members appended by a stream to a table, read back."""
    path = f"{shared_dir(spark)}/members-{uuid.uuid4().hex}"
    source = f"{path}/in"
    fx.reads_e(spark, d).write.parquet(source)
    stream = spark.readStream.schema("otuname string, readname string").parquet(source)
    append.append_members(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("otuname string, readname string").parquet(f"{path}/out")
