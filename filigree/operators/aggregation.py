"""Message passing: features of neighbours, aggregated by node, one dimension a row.

adj: node, slot, nbr. vectors: gid, f (array). Weights are the identity; dense layers are Spark ML's
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(adj: DataFrame, vectors: DataFrame, include_self: bool = False) -> DataFrame:
    """node, pos, v: each neighbour's value in each dimension; with include_self the node's own too."""
    pairs = adj.select("node", "nbr")
    if include_self:
        pairs = pairs.union(adj.select("node", F.col("node").alias("nbr")).distinct())
    return pairs.join(vectors.withColumnRenamed("gid", "nbr"), "nbr").select("node", F.posexplode("f").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def pooled(adj: DataFrame, vectors: DataFrame, of: Column, include_self: bool = False) -> DataFrame:
    """node, pos, v: ``of`` over the messages (column v)."""
    return messages(adj, vectors, include_self).groupBy("node", "pos").agg(of.alias("v"))


def mean(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    return pooled(adj, vectors, F.avg("v"))


def graph_convolution(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    """The mean over neighbours and the node itself."""
    return pooled(adj, vectors, F.avg("v"), include_self=True)


def max_pool(adj: DataFrame, vectors: DataFrame, weight: float = 1.0) -> DataFrame:
    """The largest rectified value, times a weight."""
    return pooled(adj, vectors, F.max(F.greatest(F.col("v"), F.lit(0.0))) * weight)


def mean_pool(adj: DataFrame, vectors: DataFrame) -> DataFrame:
    return pooled(adj, vectors, F.avg(F.greatest(F.col("v"), F.lit(0.0))))


def geometric_pool(adj: DataFrame, vectors: DataFrame, geometry: DataFrame, of: Column) -> DataFrame:
    """The pool of features multiplied by the neighbour's geometry (gid, g: one number)."""
    scaled = vectors.join(geometry, "gid").select("gid", F.transform("f", lambda x: x.cast("double") * F.col("g")).alias("f"))
    return pooled(adj, scaled, of)


def edge_pool(adj: DataFrame, vectors: DataFrame, places: DataFrame) -> DataFrame:
    """The largest value of features weighed by the inverse distance of node and neighbour (places: gid, p0, p1)."""
    own = places.selectExpr("gid AS node", "p0 AS a0", "p1 AS a1")
    other = places.selectExpr("gid AS nbr", "p0 AS b0", "p1 AS b1")
    d = F.sqrt(F.pow(F.col("a0") - F.col("b0"), 2) + F.pow(F.col("a1") - F.col("b1"), 2))
    near = adj.join(own, "node").join(other, "nbr").select("node", "nbr", (1 / (d + 1e-9)).alias("w"))
    each = near.join(vectors.withColumnRenamed("gid", "nbr"), "nbr").select("node", "w", F.posexplode("f").alias("pos", "v"))
    return each.groupBy("node", "pos").agg(F.max(F.col("w") * F.col("v").cast("double")).alias("v"))


AGGREGATORS = {"mean": mean, "gcn": graph_convolution, "maxpool": max_pool, "meanpool": mean_pool}


def propagate(adj: DataFrame, vectors: DataFrame, name: str, hops: int = 1) -> DataFrame:
    """gid, f: a node's own vector and, hop by hop, the aggregated ones behind it."""
    out, current = vectors, vectors
    for _ in range(hops):
        pooled_ = AGGREGATORS[name](adj, current)
        current = pooled_.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("f")).select(F.col("node").alias("gid"), F.transform("f", lambda x: x["v"]).alias("f"))
        out = out.join(current.withColumnRenamed("f", "_g"), "gid").select("gid", F.concat(F.transform("f", lambda x: x.cast("double")), "_g").alias("f"))
    return out
