"""Cutting lineage in iterative plans, and dense numbering without gathering rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task numbers, about.
NUMBERED_ROWS = 100_000
#: Rows of a partition that ``spread`` makes, about.
SPREAD_ROWS = 500_000
#: Partitions from which on ``spread_many`` deals rows itself.
SPREAD_MANY = 16


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where none is set (tests), a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a job writes, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str = "round") -> DataFrame:
    """df written to a folder of its own in the shared folder and read again.

    For loops of joins: a checkpoint passes on the estimated size of the plan behind it, the product of the
    sizes of all that was joined, whose digits double with each round; a written table has the size it has.
    """
    to = new_folder(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df dealt by keys to as many partitions as its rows (about so many) need, ``SPREAD_ROWS`` each: what a task sorts or groups then doesn't grow with the input."""
    return df.repartition(max(1, -(-rows // SPREAD_ROWS)), *keys)


def spread_many(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``spread`` where that makes ``SPREAD_MANY`` partitions or more; fewer rows are left to Spark's own number."""
    return spread(df, rows, *keys) if rows > SPREAD_ROWS * (SPREAD_MANY - 1) else df


def dense_ids(df: DataFrame, key: str, *ties: str, name: str = "idx") -> DataFrame:
    """df with 0, 1, ... by key, then ties.

    Rows are ranged over partitions by key and ties together, so that many rows of one key spread too; each
    partition is numbered by itself, from the number of rows in the partitions before it. The partition's
    number is kept with its rows, as bounds drawn anew might differ. df is computed once, written, and then
    counted, sampled for the bounds and ranged.
    """
    df = store(df, "rows")
    order = ", ".join((key, *ties))
    ranges = max(1, -(-df.count() // NUMBERED_ROWS))
    if ranges == 1:
        return df.selectExpr("*", f"row_number() OVER (ORDER BY {order}) - 1 AS {name}")
    ranged = keep(df.repartitionByRange(ranges, key, *ties).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).selectExpr("_range", "sum(_n) OVER (ORDER BY _range) - _n AS _before")
    own = ranged.selectExpr("*", f"row_number() OVER (PARTITION BY _range ORDER BY {order}) - 1 AS _own")
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
