"""Training splits and active selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed


def class_weights(labels: DataFrame) -> DataFrame:
    """One row: w0, w1, the weights n / (2 n_class)."""
    n, n1 = F.count("*"), F.count_if(F.col("y") == 1)
    return labels.agg((n / (2 * (n - n1))).alias("w0"), (n / (2 * n1)).alias("w1"))


def tagged_sets(rows: DataFrame, test_all: bool = False) -> DataFrame:
    """rows with a column set: train, val, test and all. Without test_all, rows that are not val also enter test, train rows included; with it, every row does."""
    sets = F.array_compact(F.array(F.when(F.col("partition") == "train", "train"), F.when(F.col("partition") == "val", "val"), F.lit("test") if test_all else F.when(F.col("partition") != "val", "test"), F.lit("all")))
    return rows.withColumn("set", F.explode(sets))


def hash_split(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with partition by a digest of the key: shares are met in expectation, and no row depends on another."""
    u = keyed.uniform(seed, F.col(key))
    return rows.withColumn("partition", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def final_split(nodes: DataFrame, compat: bool = False, union_space: bool = False) -> DataFrame:
    """nodes (gid, partition) with final: as selected. In compat mode the two smallest gids become the validation set; with union_space every node that is not val becomes train.

    The two smallest gids are a top-2, not a sort of all rows.
    """
    out = nodes
    if compat:
        two = nodes.orderBy("gid").limit(2).select("gid").withColumn("_v", F.lit(True))
        out = nodes.join(F.broadcast(two), "gid", "left")
    is_val = (F.col("partition") == "val") | (F.coalesce("_v", F.lit(False)) if compat else F.lit(False))
    rest = F.lit("train") if union_space else F.col("partition")
    return out.withColumn("final", F.when(is_val, "val").otherwise(rest)).drop("_v")


def merge_selections(old: DataFrame, new: DataFrame) -> DataFrame:
    """gid, y of the union of selections, a new label before an old one."""
    return new.withColumnRenamed("y", "n").join(old.withColumnRenamed("y", "o"), "gid", "full").select("gid", F.coalesce("n", "o").alias("y"))


def batches(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """rows with batch: the rows in digest order, cut into batches of ``size``.

    Ranges of the digest are numbered by themselves, from the counts before them.
    """
    keyed_ = rows.withColumn("_d", keyed.digest(seed, F.col(key))).withColumn("_r", F.substring("_d", 1, 2))
    before = keyed_.groupBy("_r").agg(F.count("*").alias("_n")).selectExpr("_r", "sum(_n) OVER (ORDER BY _r) - _n AS _before")  # 256 ranges
    own = keyed_.selectExpr("*", f"row_number() OVER (PARTITION BY _r ORDER BY _d, {key}) - 1 AS _at")
    return own.join(F.broadcast(before), "_r").withColumn("batch", F.floor((F.col("_at") + F.col("_before")) / size)).drop("_d", "_r", "_at", "_before")
