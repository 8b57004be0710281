"""Windows over streams of events, the same code for streams and tables, and incremental selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import merge_selections


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_type, hour, n, total in tumbling windows of an hour; a stream waits for rows up to ``late``."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, first, n: runs of events with no gap as long as ``gap``."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first"), "n")


def run_once(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives when all that is there has been read, as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def merge_into(path: str):
    """A foreachBatch function that merges selections (gid, y) into the latest state under path, version by version."""

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("gid").agg(F.max("y").alias("y"))
        old = spark.read.parquet(f"{path}/{version - 1}") if version else spark.createDataFrame([], batch.schema)
        merge_selections(old, latest).write.mode("overwrite").parquet(f"{path}/{version}")

    return merge
