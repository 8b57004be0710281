"""Node vectors from walks by skip-gram with negatives, trained block by block.

Nodes are dealt to blocks by digest. Each node has a vector and a context vector. A round takes as many
pairs of blocks as there are blocks, no block twice, so that a task alone changes the vectors of one
block and the context vectors of another; as many rounds meet every pair once. Between rounds all vectors
lie in a table in the shared folder. The driver holds none, and a task those of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keeping import new_folder, store

#: Nodes of a block, and pairs of two blocks, about.
BLOCK_NODES, BLOCK_PAIRS = 200_000, 2_000_000
#: Pairs or nodes of a row, about.
PACKED_ROWS = 10_000
#: Pairs whose slopes are added up before they count; fewer where there are few nodes, as each would move too far at once.
STEP, LEAST_STEP = 512, 16
_SCHEMA = "kind int, block int, node array<long>, weight array<double>, vec binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers to evenly spread ones."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def first_vectors(nodes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small vectors that depend on node and seed alone."""
    at = _mixed(nodes.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))[:, None] + np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mixed(at) >> np.uint64(11)) / float(1 << 53) - 0.5) / size


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(u: np.ndarray, v: np.ndarray, weight: np.ndarray, one: np.ndarray, two: np.ndarray, times: np.ndarray, *, negatives: int, rate: float, draw: np.random.Generator) -> None:
    """Moves vectors u and context vectors v by the pairs (one, two), each so many times; negatives are drawn from the contexts by weight."""
    span, size = np.cumsum(weight), min(STEP, max(LEAST_STEP, len(u) // 4))
    for at in range(0, len(one), size):
        i, j, n = one[at : at + size], two[at : at + size], times[at : at + size, None]
        far = np.searchsorted(span, draw.random((len(i), negatives)) * span[-1], side="right").clip(0, len(v) - 1)
        own, near, away = u[i], v[j], v[far]
        pull = rate * n * (1 - sigmoid((own * near).sum(axis=1, keepdims=True)))
        push = rate * n[:, :, None] * sigmoid((away @ own[:, :, None]))
        np.add.at(u, i, pull * near - (push * away).sum(axis=1))
        np.add.at(v, j, pull * own)
        np.add.at(v, far.ravel(), (-push * own[:, None, :]).reshape(-1, u.shape[1]))


def _packed(kind: int, block: int, node: np.ndarray, weight: np.ndarray, vec: np.ndarray) -> pa.Table:
    """Vectors of a block as rows of ``PACKED_ROWS`` each."""
    at = [*range(0, len(node), PACKED_ROWS), len(node)]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x))
    parts = [vec[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
    n = len(parts)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "node": lists(node), "weight": lists(weight), "vec": pa.array(parts, pa.binary())})


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The elements of all rows' lists, one after another."""
    return column.combine_chunks().flatten().to_numpy()


def walk_vectors(pairs: DataFrame, *, size: int = 16, epochs: int = 2, negatives: int = 5, rate: float = 0.05, seed: int = 0, blocks: int = 1) -> DataFrame:
    """node, vec for every node of pairs (node, ctx: whole numbers).

    blocks: so many times as many blocks as hold ``BLOCK_NODES`` and ``BLOCK_PAIRS``, so that a task doesn't
    grow with the input whatever is asked for. Pairs that repeat count as often. Rows with a null are left
    out; an empty table gives an empty result. The result depends on seed and blocks, not on how rows are
    partitioned. Pairs and vectors travel as rows of ``PACKED_ROWS`` each, since a round deals all of them.
    """
    spark = pairs.sparkSession
    counted = store(pairs.where("node IS NOT NULL AND ctx IS NOT NULL").groupBy(F.col("node").cast("long").alias("node"), F.col("ctx").cast("long").alias("ctx")).agg(F.count("*").cast("double").alias("times")))
    ends = counted.select("node", F.lit(0.0).alias("n")).unionByName(counted.select(F.col("ctx").alias("node"), F.col("times").alias("n")))
    nodes = store(ends.groupBy("node").agg(F.sum("n").alias("n")).select("node", F.pow("n", 0.75).alias("weight")))
    n_pairs, n_nodes = counted.count(), nodes.count()
    blocks *= max(1, -(-n_nodes // BLOCK_NODES), int((n_pairs / BLOCK_PAIRS) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    part = lambda n, *c: F.pmod(F.xxhash64(F.lit("part"), *c), F.lit(max(1, -(-n // PACKED_ROWS)))).cast("int")
    lists = lambda *names: F.collect_list(F.struct(*names)).alias("of")
    met = counted.select("*", block("node").alias("task"), F.pmod(block("ctx") - block("node"), F.lit(blocks)).alias("turn"), part(n_pairs // blocks**2, "node", "ctx").alias("part"))
    to = new_folder(spark, "pairs")
    met.groupBy("turn", "task", "part").agg(lists("node", "ctx", "times")).select("turn", "task", F.col("of.node").alias("node"), F.col("of.ctx").alias("ctx"), F.col("of.times").alias("weight")).repartition("turn", "task").write.partitionBy("turn").parquet(to)
    dealt = spark.read.schema("node array<long>, ctx array<long>, weight array<double>, task int, turn int").parquet(to)
    held = nodes.groupBy(block("node").alias("block"), part(n_nodes // blocks, "node").alias("part")).agg(lists("node", "weight"))
    state = held.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), "block", F.col("of.node").alias("node"), F.col("of.weight").alias("weight"), F.lit(None).cast("binary").alias("vec"))

    def run(epoch: int, turn: int):
        def step(key: tuple, table: pa.Table) -> pa.Table:
            kind, task = table["kind"].to_numpy(), key[0].as_py()
            nodes, weights, vectors = [], [], []
            for k in (0, 1):
                own = table.filter(pa.array(kind == k))
                node = _flat(own["node"])
                order = np.argsort(node)
                nodes.append(node[order])
                weights.append(_flat(own["weight"])[order])
                if len(own) and own["vec"].null_count == 0:
                    vectors.append(np.concatenate([np.frombuffer(b.as_buffer()).reshape(-1, size) for b in own["vec"]])[order])
                else:
                    vectors.append(first_vectors(nodes[k], size, seed) if k == 0 else np.zeros((len(node), size)))
            own = table.filter(pa.array(kind == 2))
            if len(own):
                node, ctx, times = (_flat(own[c]) for c in ("node", "ctx", "weight"))
                order = np.lexsort((ctx, node, _mixed(node.astype(np.uint64) * np.uint64(31) + _mixed(ctx) + np.uint64(epoch))))
                one, two = np.searchsorted(nodes[0], node[order]), np.searchsorted(nodes[1], ctx[order])
                descend(vectors[0], vectors[1], weights[1], one, two, times[order], negatives=negatives, rate=rate, draw=np.random.default_rng([seed, epoch, turn, task]))
            return pa.concat_tables([_packed(k, task if k == 0 else (task + turn) % blocks, nodes[k], weights[k], vectors[k]) for k in (0, 1)])

        return step

    for epoch in range(epochs):
        for turn in range(blocks):
            task = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(blocks)))
            held = state.select(task.cast("int").alias("task"), "kind", "node", F.lit(None).cast("array<long>").alias("ctx"), "weight", "vec")
            own = dealt.where(F.col("turn") == turn).select("task", F.lit(2).alias("kind"), "node", "ctx", "weight", F.lit(None).cast("binary").alias("vec"))
            state = store(held.unionByName(own).groupBy("task").applyInArrow(run(epoch, turn), _SCHEMA))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, flat = batch.column("node")[i].values, np.frombuffer(batch.column("vec")[i].as_buffer())
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * size), pa.array(flat))], ["node", "vec"])

    return state.where("kind = 0").select("node", "vec").mapInArrow(rows, "node long, vec array<double>")
