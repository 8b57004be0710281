"""Extensions over the events table: time windows. The engine's model has no streams of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from . import fixtures as fx
from .registry import query


def timed(spark, d):
    return fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ext_hourly_windows", "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def ext_hourly(spark, d):
    rows = events.hourly(timed(spark, d).withColumn("value", F.round(F.col("value") * 10000).cast("long")))
    return rows.select("event_type", F.unix_timestamp("hour").alias("hour"), "n", "total")


@query("ext_sessions", "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) a) b GROUP BY user_id, s")
def ext_sessions(spark, d):
    return events.sessions(timed(spark, d)).select("user_id", F.unix_timestamp("first").alias("first"), "n")
