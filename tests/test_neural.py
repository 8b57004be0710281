import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import neural, spatial


def data(spark):
    draw = np.random.default_rng(1)
    f = draw.random((6, 4))
    ring = [(n, s, (n + 1 + s) % 6) for n in range(6) for s in range(2)]
    return f, spark.createDataFrame([(i, [float(x) for x in f[i]]) for i in range(6)], "gid long, f array<double>"), spark.createDataFrame(ring, "node long, slot long, nbr long")


def test_layers_before_the_join_equal_layers_on_messages(spark):
    f, vectors, adj = data(spark)
    layers = [neural.glorot(4, 5, 1), neural.glorot(5, 3, 2)]
    hidden = np.maximum(np.maximum(f @ layers[0], 0) @ layers[1], 0)
    for r in neural.layered_pool(adj, vectors, layers, F.max("v")).collect():
        n = r["node"]
        assert r["v"] == pytest.approx(max(hidden[(n + 1) % 6, r["pos"]], hidden[(n + 2) % 6, r["pos"]]))


def test_recurrent_depends_on_order_and_not_on_partitions(spark):
    _, vectors, adj = data(spark)
    run = lambda a: {r["node"]: r["h"] for r in neural.recurrent(a, vectors, 4).collect()}
    one = run(adj)
    assert one == run(adj.repartition(5)) and len(one[0]) == 8
    assert run(adj.withColumn("slot", 1 - F.col("slot")))[0] != one[0]


def test_jumping_knowledge(spark):
    _, vectors, _ = data(spark)
    assert {len(r["f"]) for r in neural.concatenated([vectors, vectors, vectors]).collect()} == {12}


def test_seeds_move_to_the_middle_of_their_points(spark):
    points = spark.createDataFrame([(float(a + i % 3), float(a + i // 3)) for a in (0, 100) for i in range(9)], "p0 double, p1 double")
    got = sorted((round(r["q0"], 6), round(r["q1"], 6)) for r in spatial.spread_seeds(points, 2).collect())
    assert got == [(1.0, 1.0), (101.0, 101.0)]
