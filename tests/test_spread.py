"""Steps whose tasks must not grow with the input, or that must not be computed twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import features, generators, graph, keeping, neural, sphere
from filigree.plans import fixtures as fx
from filigree.plans import models, shapes

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_are_not_shuffled(spark):
    boxes = [(1, 0, 40, 0, 50), (1, 8, 40, 16, 50), (2, 3, 20, 5, 90), (3, 0, 10, 0, 10), (2, 3, 20, 5, 90)]
    rows = spark.createDataFrame(boxes, "box_id int, x0 int, x1 int, y0 int, y1 int")
    axis = lambda lo, hi: {min(lo + 8 * i, hi - 16) for i in range((hi - lo) // 8 + 1)}
    expected = sorted({(b, x, x + 16, y, y + 16) for b, x0, x1, y0, y1 in boxes for x in axis(x0, x1) for y in axis(y0, y1)})
    tiles = generators.tiles_of(rows, size=16)
    assert sorted(map(tuple, tiles.collect())) == expected
    assert plan(tiles).index("Generate") < plan(tiles).index("Aggregate")  # nothing is grouped once tiles are made


@pytest.mark.parametrize("sent", [0, 1000])
def test_points_of_a_line_lie_together(spark, monkeypatch, sent):
    monkeypatch.setattr(features, "SENT_PLACES", sent)
    monkeypatch.setattr(keeping, "SPREAD_ROWS", 100)
    points = spark.range(700).selectExpr("id % 90 AS gid", "id % 7 AS x", "id % 5 AS y")
    channels = spark.range(12).selectExpr("id % 6 AS x", "id % 4 AS y", "id * 1.5D AS v").crossJoin(spark.createDataFrame([("a",), ("b",)], "channel string"))
    found = features.looked_up(points, channels)
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(found) == key(points.join(channels, ["x", "y"]).select("gid", "channel", "v"))
    assert found.rdd.getNumPartitions() == 7


def test_pairs_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(keeping, "SPREAD_ROWS", 10)
    edges = spark.range(100).selectExpr("id AS v1", "id * 7 % 100 AS v2")
    near = graph.adjacency(edges, 100)
    assert near.rdd.getNumPartitions() == 10 and sorted(near.collect()) == sorted(graph.adjacency(edges).collect())


def test_neighbours_are_ranked_in_one_pass_without_hubs(spark, monkeypatch):
    near = graph.adjacency(spark.range(60).selectExpr("id % 12 AS v1", "id % 13 AS v2"))
    ranked = graph.ranked_neighbours(near, 3)
    assert "Join" not in plan(ranked)
    monkeypatch.setattr(graph, "HUB_ROWS", 3)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, graph.ranked_neighbours(near, 3).collect()))


def test_walks_end_without_neighbours(spark):
    one_way = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    walks = graph.random_walks(spark.range(4).selectExpr("id AS gid"), one_way, walks=1, length=3)
    assert sorted(map(tuple, walks.collect())) == [(0, 0, 1, 1), (0, 0, 2, 2), (1, 0, 1, 2)]


def test_rows_are_computed_once_to_be_numbered(spark, monkeypatch):
    monkeypatch.setattr(keeping, "NUMBERED_ROWS", 50)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = keeping.dense_ids(spark.range(200).mapInArrow(count, "id long"), "id")
    assert [r["idx"] for r in rows.orderBy("id").collect()] == list(range(200)) and seen.value == 200


def test_layers_take_some_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(neural, "DENSE_ROWS", 3)
    draw = np.random.default_rng(1)
    x, layers = draw.normal(size=(20, 4)), [draw.normal(size=(4, 3)), draw.normal(size=(3, 2))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gid int, f array<float>").coalesce(1)
    got = {r["gid"]: r["f"] for r in rows.where("gid % 3 <> 1").select("gid", neural.dense(F.col("f"), layers).alias("f")).collect()}
    expected = np.maximum(np.maximum(x.astype(np.float32) @ layers[0], 0) @ layers[1], 0)
    assert len(got) == 13 and all(got[i] == pytest.approx(expected[i], rel=1e-6) for i in got)


def test_links_of_a_layout_are_dealt_once(spark, monkeypatch):
    dealt, real = [], sphere.spread
    monkeypatch.setattr(sphere, "spread", lambda df, rows, *keys: dealt.append(keys) or real(df, rows, *keys))
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "gid long, f array<double>")
    out = sphere.spherical_layout(vectors, sphere.neighbour_graph(vectors, 4), epochs=3)
    assert dealt == [("b",)] and out.count() == 30


def test_pixels_are_written_before_the_fit(spark, monkeypatch):
    written, real = [], models.store
    monkeypatch.setattr(models, "store", lambda df, *a: written.append(df.columns) or real(df, *a))
    monkeypatch.setattr(models.learning, "pixel_forest", lambda rows, train: rows.selectExpr("gid", "y", "0.5D AS p"))
    assert models.m20(spark, SF_DIR).count() == fx.feat(spark, SF_DIR).count() and written == [["gid", "f", "y"]]


def test_polylines_and_their_neighbours_are_spread_by_their_number(spark, monkeypatch):
    whole = {r["gid"]: tuple(r) for r in shapes.f30(spark, SF_DIR).collect()}
    monkeypatch.setattr(keeping, "SPREAD_ROWS", 400)
    ends = 2 * fx.n_points(spark, SF_DIR)
    for spread in (shapes.lines(spark, SF_DIR), features.last_neighbour(fx.junctions(spark, SF_DIR), ("pk", "v1"), ends)):
        assert spread.rdd.getNumPartitions() == -(-ends // 400)
    got = {r["gid"]: tuple(r) for r in shapes.f30(spark, SF_DIR).collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(v, abs=1e-3) for k, v in whole.items())


def test_the_phantom_is_not_looked_up(spark):
    """Nine of ten polylines lie at the phantom; the join meets the others alone."""
    points = spark.range(40).selectExpr("id DIV 4 AS gid", "id % 4 AS seq", "id * 1.5D AS p0", "id % 7 * 2.0D AS p1")
    near = spark.range(10).selectExpr("id AS gid", "IF(id = 3, 5L, -1L) AS nbr")
    out = features.geometry_vector(features.polylines(points), points, near, 1 / 200)
    first = {r["gid"]: r["euclid_adj1_self0"] for r in out.collect()}
    at = lambda i: np.array([1.5 * i, i % 7 * 2.0])
    assert first == {i: pytest.approx(np.linalg.norm(at(4 * i) - (at(23) if i == 3 else [1, 1]))) for i in range(10)}
    assert "NOT (nbr" in plan(out)
