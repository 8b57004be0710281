import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import graph, keeping, metrics, raster, spatial, splits

EDGES = "gid long, v1 long, v2 long"


@pytest.fixture
def path_graph(spark):
    return spark.createDataFrame([(i, i, i + 1) for i in range(6)] + [(9, 6, -1), (10, 3, 3)], EDGES)


def test_adjacency_is_symmetric_without_loops(spark, path_graph):
    rows = {tuple(r) for r in graph.adjacency(path_graph).collect()}
    assert rows == {(b, a) for a, b in rows} and all(a != b for a, b in rows) and (6, -1) in rows


def test_phantom_gains_degree(path_graph):
    deg = {r["gid"]: r["degree"] for r in graph.degrees(path_graph).collect()}
    assert deg[-1] == 1 and deg[3] == 3 and deg[0] == 1


def test_one_hop_expands_twice(spark, path_graph):
    out = {r["gid"]: r["hop"] for r in graph.expand(spark.createDataFrame([(0,)], "gid long"), graph.adjacency(path_graph), 1).collect()}
    assert out == {0: 0, 1: 1, 2: 2}


def test_fixed_adjacency_fills_pads_and_prunes(spark):
    adjacent = spark.createDataFrame([(1, n) for n in (2, 3)] + [(5, n) for n in range(10, 20)], "src long, dst long")
    out = graph.fixed_adjacency(spark.createDataFrame([(1,), (5,), (7,)], "gid long"), adjacent, 4, seed=1).collect()
    by = {n: sorted((r["slot"], r["nbr"]) for r in out if r["node"] == n) for n in (1, 5, 7)}
    assert all(len(v) == 4 for v in by.values())
    assert [x for _, x in by[7]] == [-1] * 4 and {x for _, x in by[1]} == {2, 3} and len({x for _, x in by[5]}) == 4
    assert by[1][0][1] == by[1][2][1]


@pytest.mark.parametrize("hub_rows", [100_000, 50])
def test_ranks_of_a_hub_go_on_from_part_to_part(spark, monkeypatch, hub_rows):
    """A hub with a third of all rows, ranked in parts or not, has the order of its digests; so have the nodes beside it."""
    monkeypatch.setattr(graph, "HUB_ROWS", hub_rows)
    pairs = [(0, n) for n in range(1, 701)] + [(n, n + 1) for n in range(1, 701)] + [(n, 0) for n in range(1, 701)]
    adjacent = spark.createDataFrame(pairs, "src long, dst long").repartition(7)
    want = {}
    for src, dst in pairs:
        want.setdefault(src, []).append((hashlib.md5(f"3|{src}|{dst}".encode()).hexdigest(), dst))
    want = {(src, slot, dst, len(own)) for src, own in want.items() for slot, (_, dst) in enumerate(sorted(own))}
    assert {tuple(r) for r in graph.ranked_neighbours(adjacent, 3).select("src", "slot", "dst", "degree").collect()} == want
    first = graph.first_neighbours(adjacent, 2, 3)
    assert {tuple(r) for r in first.select("src", "slot", "dst").collect()} == {w[:3] for w in want if w[1] < 2}
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()
    assert graph.ranked_neighbours(adjacent.limit(0)).count() == 0


def test_walks_stay_on_edges_and_repeat(spark, path_graph):
    adjacent = graph.adjacency(path_graph.where("v2 >= 0"))
    nodes = spark.range(7).select(F.col("id").alias("gid"))
    one, two = (sorted(map(tuple, graph.random_walks(n, a, 2, 3, seed=4).collect())) for n, a in ((nodes, adjacent), (nodes.repartition(5), adjacent.repartition(3))))
    assert one == two and all(abs(n - c) <= 3 and n != c for n, _, _, c in one)


def test_components(spark, path_graph):
    nodes = spark.range(9).select(F.col("id").alias("gid"))
    out = {r["gid"]: r["component"] for r in graph.components(nodes, graph.adjacency(path_graph.where("v2 >= 0"))).collect()}
    assert out == {**dict.fromkeys(range(7), 0), 7: 7, 8: 8}


def test_dense_ids_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(keeping, "NUMBERED_ROWS", 7)
    rows = spark.createDataFrame([(float(i * 37 % 101), i) for i in range(60)], "k double, i long")
    ids = [r["idx"] for r in keeping.dense_ids(rows, "k", "i").orderBy("k", "i").collect()]
    assert ids == list(range(60))
    assert keeping.dense_ids(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("limit", [2_000, 0])
def test_points_in_boxes_on_the_edge(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "BROADCAST_BOXES", limit)
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 20.0, 40.0), (3, 20.1, 30.0), (4, 15.0, 130.0)], "gid long, p0 double, p1 double")
    boxes = spark.createDataFrame([(20, 40, 10, 20), (100, 300, 0, 30)], "x0 int, x1 int, y0 int, y1 int")
    assert {r["gid"] for r in spatial.points_in_boxes(points, boxes).collect()} == {1, 2, 4}


def test_nearest_in_empty_country(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 100.0)], "gid long, p0 double, p1 double")
    queries = spark.createDataFrame([(1, 0.4, 0.4), (2, 40.0, 40.0), (3, 50.0, 50.0)], "qid long, q0 double, q1 double")
    out = {r["qid"]: (r["gid"], round(r["dist"], 3)) for r in spatial.nearest(queries, points, 1.0).collect()}
    assert out == {1: (1, 0.566), 2: (1, 56.569), 3: (1, 70.711)}


def numpy_image(n=5, m=4):
    return np.random.default_rng(1).random((n, m))


def frame(spark, image):
    return spark.createDataFrame([(int(x), int(y), float(image[x, y])) for x, y in np.ndindex(*image.shape)], "x long, y long, v double")


def as_array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"]] = r[column]
    return out


def test_focal_mean_reflects_at_borders(spark):
    image = numpy_image()
    padded = np.pad(image, 1, mode="symmetric")
    plus = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    expected = np.mean([padded[1 + a : 1 + a + 5, 1 + b : 1 + b + 4] for a, b in plus], axis=0)
    assert as_array(raster.focal(frame(spark, image), raster.disk(1), F.avg("v")), image.shape) == pytest.approx(expected)


def test_gradient_and_hessian_equal_numpy(spark):
    image = numpy_image(6, 5)
    px = frame(spark, image)
    assert as_array(raster.gradients(px, "x"), image.shape) == pytest.approx(np.gradient(image)[0])
    gx, gy = np.gradient(image)
    h = np.stack([np.stack([np.gradient(gx)[0], np.gradient(gx)[1]], -1), np.stack([np.gradient(gx)[1], np.gradient(gy)[1]], -1)], -2)
    eigen = np.linalg.eigvalsh(h)
    out = raster.hessian_eigenvalues(px)
    assert as_array(out, image.shape, "e1") == pytest.approx(eigen[..., 1]) and as_array(out, image.shape, "e2") == pytest.approx(eigen[..., 0])


def test_gaussian_keeps_a_constant(spark):
    assert as_array(raster.gaussian(frame(spark, np.full((6, 7), 2.5)), 1.5), (6, 7)) == pytest.approx(2.5)


def test_sweep_takes_the_larger_of_equally_good_cutoffs(spark):
    pred = spark.createDataFrame([(1, 0.9, 1), (2, 0.1, 0)], "gid long, p double, y int")
    best = metrics.best_cutoff(metrics.f1_sweep(pred)).first()
    assert best["cutoff"] == 0.89 and best["f1"] == 1.0


def test_exponential_average(spark):
    rows = spark.createDataFrame([("a", i, float(i * i)) for i in range(5)], "g string, t int, x double")
    s = 0.0
    for i in range(5):
        s -= 0.3 * (s - i * i)
    assert metrics.exponential_average(rows, "g", "t", "x", 0.3).first()["ema"] == pytest.approx(s)


def test_splits_are_disjoint_and_repeat(spark):
    rows = spark.range(500).select(F.col("id").alias("gid"))
    one, two = ({r["gid"]: r["partition"] for r in splits.hash_split(d, "gid", seed=3).collect()} for d in (rows, rows.repartition(7)))
    assert one == two and set(one.values()) == {"train", "val", "test"}
    sizes = splits.batches(rows, "gid", 64).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [64] * 7 + [52]


def test_nearest_in_empty_country_and_with_ties(spark):
    """Far queries, points in one corner, equal distances: as brute force."""
    rng = random.Random(4)
    points = [(i, rng.random() * 10, rng.random() * 10) for i in range(300)] + [(900, 5_000.0, 5_000.0), (901, 5_000.0, 5_000.0)]
    queries = [(0, 5.0, 5.0), (1, 400.0, 3.0), (2, -90_000.0, 12.0), (3, 4_990.0, 5_010.0), (4, 2_505.0, 2_505.0)]
    expected = {q: min((math.hypot(a - x, b - y), g) for g, a, b in points) for q, x, y in queries}
    got = spatial.nearest(spark.createDataFrame(queries, "qid long, q0 double, q1 double"), spark.createDataFrame(points, "gid long, p0 double, p1 double"), cell=1.0).collect()
    assert {r["qid"]: r["gid"] for r in got} == {q: e[1] for q, e in expected.items()}
    assert {r["qid"]: r["dist"] for r in got} == pytest.approx({q: e[0] for q, e in expected.items()}, rel=1e-12)
    assert "CartesianProduct" not in spatial.nearest(spark.range(3).selectExpr("id AS qid", "0.5 AS q0", "0.5 AS q1"), spark.createDataFrame(points, "gid long, p0 double, p1 double"), cell=1.0)._jdf.queryExecution().toString()
    nothing = spark.createDataFrame([], "gid long, p0 double, p1 double")
    assert spatial.nearest(spark.range(1).selectExpr("id AS qid", "0.5 AS q0", "0.5 AS q1"), nothing, cell=1.0).count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 70])
def test_dense_ids_where_one_key_has_most_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(keeping, "NUMBERED_ROWS", rows)
    df = spark.range(1_000).selectExpr("CASE WHEN id % 10 < 9 THEN 7 ELSE id END AS k", "id * 37 % 1000 AS t").repartition(5)
    got = sorted((r["idx"], r["k"], r["t"]) for r in keeping.dense_ids(df, "k", "t").collect())
    assert [g[0] for g in got] == list(range(1_000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    if rows < 1_000:
        ranges = df.repartitionByRange(15, "k", "t").groupBy(F.spark_partition_id()).count()
        assert ranges.agg(F.max("count")).first()[0] < 300
