"""Aggregators with dense layers, with seeded weights: layers run on Arrow batches, pooling in Spark.

A layer acts on a neighbour's vector alone, so it is applied once to each node before the join, not
once to each message. Vectors of dimension ``width``; adj: node, slot, nbr.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregation import pooled


def glorot(rows: int, columns: int, seed: int) -> np.ndarray:
    bound = np.sqrt(6.0 / (rows + columns))
    return np.random.default_rng(seed).uniform(-bound, bound, (rows, columns))


def patterned(rows: int, columns: int, seed: int) -> np.ndarray:
    """Weights by a rule, in eighths from -6 to 6: the same in every engine."""
    i, j = np.indices((rows, columns))
    return ((i * 31 + j * 17 + seed * 7) % 13 - 6) / 8.0


#: Rows that go through the layers at once.
DENSE_ROWS = 1024


def dense(column: Column, layers: list[np.ndarray], rectify: bool = True) -> Column:
    """The vector through dense layers, rectified or not."""

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        h = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), layers[0].shape[0])
        out = np.empty((len(x), layers[-1].shape[1]))
        for at in range(0, len(x), DENSE_ROWS):
            part = h[at : at + DENSE_ROWS].astype(np.float64)
            for w in layers:
                part = np.maximum(part @ w, 0.0) if rectify else part @ w
            out[at : at + DENSE_ROWS] = part
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1], out.ravel())

    return apply(column)


def layered_pool(adj: DataFrame, vectors: DataFrame, layers: list[np.ndarray], of: Column) -> DataFrame:
    """node, pos, v: ``of`` over the neighbours' vectors behind the layers."""
    return pooled(adj, vectors.select("gid", dense(F.col("f"), layers).alias("f")), of)


def product_pool(adj: DataFrame, vectors: DataFrame, geometry: DataFrame, own: list[np.ndarray], other: list[np.ndarray], of: Column) -> DataFrame:
    """Two streams, features and geometry (gid, g: array), each through layers of its own; their product is pooled."""
    both = vectors.join(geometry, "gid").select("gid", dense(F.col("f"), own).alias("a"), dense(F.col("g"), other).alias("b"))
    return pooled(adj, both.select("gid", F.zip_with("a", "b", lambda x, y: x * y).alias("f")), of)


def as_arrays(rows: DataFrame) -> DataFrame:
    """node, pos, v to gid, f."""
    each = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("f"))
    return each.select(F.col("node").alias("gid"), F.transform("f", lambda x: x["v"]).alias("f"))


def with_weights(vectors: DataFrame, pooled_rows: DataFrame, own: np.ndarray, neighbours: np.ndarray, concat: bool = False) -> DataFrame:
    """gid, f: a node's vector and what was pooled around it, each times its weights, added or behind each other, rectified. Without neighbours, the own part alone."""
    around = as_arrays(pooled_rows).withColumnRenamed("f", "_around")
    both = vectors.join(around, "gid", "left").withColumn("_around", F.coalesce("_around", F.array_repeat(F.lit(0.0), neighbours.shape[0])))
    parts = both.select("gid", dense(F.col("f"), [own], rectify=False).alias("a"), dense(F.col("_around"), [neighbours], rectify=False).alias("b"))
    joined = F.concat("a", "b") if concat else F.zip_with("a", "b", lambda x, y: x + y)
    return parts.select("gid", F.transform(joined, lambda x: F.greatest(x, F.lit(0.0))).alias("f"))


def recurrent(adj: DataFrame, vectors: DataFrame, width: int, hidden: int = 8, seed: int = 1, weights: np.ndarray | None = None, inner: np.ndarray | None = None) -> DataFrame:
    """node, h: the last state of a recurrent cell with gates over the neighbours in slot order; a node's neighbours are as many as its slots.

    Sequences of one length go through the cell together, a step of all of them at a time.
    """
    weights = glorot(width, 4 * hidden, seed) if weights is None else weights
    inner = glorot(hidden, 4 * hidden, seed + 1) if inner is None else inner

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out, sizes = np.zeros((len(rows), hidden)), rows.map(len).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            x = np.array([[np.asarray(v, dtype=np.float64) for v in rows.iloc[i]] for i in at]) @ weights
            h, c = np.zeros((len(at), hidden)), np.zeros((len(at), hidden))
            for step in range(size):
                gates = x[:, step] + h @ inner
                i, f, o = (1 / (1 + np.exp(-gates[:, k * hidden : (k + 1) * hidden])) for k in range(3))
                c = f * c + i * np.tanh(gates[:, 3 * hidden :])
                h = o * np.tanh(c)
            out[at] = h
        return pd.Series(list(out))

    each = adj.join(vectors.withColumnRenamed("gid", "nbr"), "nbr").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("slot", F.transform("f", lambda x: x.cast("double")).alias("f")))).alias("s"))
    return each.select("node", run(F.transform("s", lambda x: x["f"])).alias("h"))


def concatenated(parts: list[DataFrame], key: str = "gid", vector: str = "f") -> DataFrame:
    """Jumping knowledge: the vectors of all layers behind each other."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.withColumnRenamed(vector, "_next"), key).select(key, F.concat(vector, "_next").alias(vector))
    return out


def largest(parts: list[DataFrame], key: str = "gid", vector: str = "f") -> DataFrame:
    """Jumping knowledge by pooling: dimension by dimension, the largest value of all layers."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part.withColumnRenamed(vector, "_next"), key).select(key, F.zip_with(vector, "_next", lambda a, b: F.greatest(a.cast("double"), b.cast("double"))).alias(vector))
    return out
