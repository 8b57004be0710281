"""Queries that take all rows, against counts over the tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from filigree.operators import learning, metrics, raster
from filigree.plans import fixtures as fx
from filigree.plans.catalogue import QUERIES
from filigree.sources import sinks

SF_DIR = "/root/testdata/sf0.001"


def run(spark, name):
    return QUERIES[name](spark, SF_DIR)


def test_every_polyline_is_drawn(spark):
    own = {(int(p.p1), int(p.p0)) for p in fx.poly_points(spark, SF_DIR).collect()}
    assert {tuple(p) for p in run(spark, "r01_rasterise").collect()} == own
    grown = {(x + a, y + b) for x, y in own for a in range(-2, 3) for b in range(-2, 3) if x + a >= 0 and y + b >= 0}
    assert {tuple(p) for p in run(spark, "r24_dilate").collect()} == grown


def test_walks_start_at_every_node_with_neighbours(spark):
    starts = run(spark, "x06_walks").where("step = 1").groupBy("node").count()
    linked = fx.gnode(spark, SF_DIR).join(fx.real_adj(spark, SF_DIR).select(F.col("src").alias("gid")).distinct(), "gid")
    assert starts.count() == linked.count() and {r["count"] for r in starts.collect()} == {2}


def test_every_vector_is_scored(spark):
    n = fx.feat(spark, SF_DIR).count()
    assert run(spark, "f19_activations").select("gid").distinct().count() == n
    assert run(spark, "j20_affinities").count() == 20 * n
    assert run(spark, "w06_mrr").first()["n"] == n - 1


def test_tiles_reach_every_pixel(spark):
    pixels = spark.range(1000).selectExpr("id AS x").crossJoin(spark.range(64).selectExpr("id AS y")).withColumn("v", F.lit(1.0))
    tiles = raster.image_tiles(pixels)
    cropped = raster.in_tiles(pixels, tiles)
    rows = tiles.collect()
    assert sorted(t.tile for t in rows) == list(range(len(rows))) and max(t.x1 for t in rows) == 1000
    assert cropped.count() == 64 * 32 * len(rows) and cropped.select("x", "y").distinct().count() == 64_000
    assert raster.stitched(cropped, tiles, 8, (1000, 64)).count() == 64_000


def test_tiles_of_a_small_image(spark):
    pixels = spark.range(30).selectExpr("id AS x").crossJoin(spark.range(20).selectExpr("id AS y")).withColumn("v", F.lit(1.0))
    tiles = raster.image_tiles(pixels)
    cropped = raster.in_tiles(pixels, tiles)
    assert [t.tile for t in tiles.collect()] == [0] and raster.stitched(cropped, tiles, 8, (30, 20)).count() == 600


def test_every_pixel_is_cropped_and_stitched(spark):
    n = fx.pixel(spark, SF_DIR).count()
    assert run(spark, "r03_stitch").count() == n
    assert run(spark, "r02_crop_tiles").agg(F.sum("n")).first()[0] >= n


def test_average_decays_over_blocks(spark):
    rng = random.Random(3)
    rows = [(g, t, rng.random()) for g, n in (("a", 3000), ("b", 1), ("c", 40)) for t in range(n)] + [("c", 7, 0.5)] * 200 + [("d", 0, 1.0), ("d", 1, None), ("d", 2, 2.0)]
    expected = {}
    for g, _, x in sorted((r for r in rows if r[0] != "d"), key=lambda r: r[1:]):
        s = expected.get(g, x)
        expected[g] = s - 0.02 * (s - x)
    df = spark.createDataFrame(rows, "g string, t long, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        average = metrics.exponential_average(df, "g", "t", "x", 0.02)
        got = {r["g"]: r["ema"] for r in average.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.pop("d") is None and got == pytest.approx(expected, rel=1e-9)


def test_average_gathers_blocks_only(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "g string, t long, x double")
    plan = metrics.exponential_average(df, "g", "t", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "rangepartitioning" in plan.lower() or "RepartitionByExpression" in plan
    assert "_sum" in plan[plan.index("collect_list"):]


def test_decay_is_registered(spark):
    first = {r["label"]: r["first"] for r in run(spark, "w07_ema").collect()}
    assert any(r["ema"] != first[r["label"]] for r in run(spark, "w07_ema_decay").collect())


def test_links_of_a_hub_are_spread_over_texts(spark):
    nodes = spark.range(1000).selectExpr("id AS gid", "'train' AS partition", "1 AS y")
    links = spark.range(1000).selectExpr("0L AS src", "id AS dst")
    out = sinks.node_link_json(nodes, links, json_rows=50).collect()
    for kind, key in (("nodes", "id"), ("links", "target")):
        texts = [json.loads(r["json"]) for r in out if r["kind"] == kind]
        assert len(texts) == 20 and max(map(len, texts)) < 150
        assert sorted(x[key] for t in texts for x in t) == list(range(1000))


def test_priors_of_a_node_gather_no_edges(spark):
    assert "collect_list" not in run(spark, "j12_map_priors")._jdf.queryExecution().optimizedPlan().toString()


def test_walks_are_trained_in_several_tasks(spark, monkeypatch):
    seen, real = [], learning.Word2Vec
    monkeypatch.setattr(learning, "Word2Vec", lambda **k: seen.append(k["numPartitions"]) or real(**k))
    walks = spark.range(200).selectExpr("id % 20 AS node", "id % 5 AS walk", "id AS step", "(id * 7) % 20 AS ctx")
    sentences = walks.select("node", "walk").distinct().count()
    out = learning.walk_embeddings(walks, size=4, trained_walks=8)
    assert seen == [-(-sentences // 8)] and {r["node"] for r in out.collect()} == set(range(20))
