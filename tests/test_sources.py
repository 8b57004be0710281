import json

import numpy as np
from pyspark.sql import functions as F

from filigree.sources import parameters, raw, sinks, text
from filigree.streaming import events


def test_network_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, [(1.0, 2.0), (3.5, 4.0)]), (2, 0, [(5.0, 6.0)])], "gid long, dim int, points array<struct<p0:double,p1:double>>")
    sinks.geometry(lines, f"{tmp_path}/geom")
    back = text.read(spark, f"{tmp_path}/geom", text.geometry)
    assert sorted(map(str, back.collect())) == sorted(map(str, lines.collect()))
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, -1)], "gid long, v1 long, v2 long")
    sinks.junctions(edges, f"{tmp_path}/edges")
    assert sorted(map(tuple, text.read(spark, f"{tmp_path}/edges", text.junctions).collect())) == [(0, 1, 2), (1, 2, -1)]
    assert {r["gid"] for r in text.with_phantom(lines).collect()} == {1, 2, -1}


def test_feature_and_walk_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(7, [0.5, -1.25])], "gid long, f array<float>")
    sinks.features(rows, f"{tmp_path}/f")
    assert text.read(spark, f"{tmp_path}/f", text.features).first()["f"] == [0.5, -1.25]
    sinks.walks(spark.createDataFrame([(1, 2)], "node long, ctx long"), f"{tmp_path}/w")
    assert tuple(text.read(spark, f"{tmp_path}/w", text.walks).first()) == (1, 2)


def test_labels_go_by_line_number(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("0\n1\n2 x\n1")
    rows = {r["gid"]: r["label"] for r in text.labels(text.numbered_lines(spark, f"{tmp_path}/labels.txt")).collect()}
    assert rows == {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [1.0, 0.0], 3: [0.0, 1.0]}


def test_boxes_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(0, 1, 2, 3, 4), (1, 5, 6, 7, 8)], "box_id long, x0 int, x1 int, y0 int, y1 int")
    sinks.boxes(boxes, f"{tmp_path}/boxes")
    back = text.boxes(text.numbered_lines(spark, f"{tmp_path}/boxes/*.txt"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, boxes.collect()))


def test_runs(spark, tmp_path):
    for run, f1 in (("10", "0.5"), ("20", "0.75")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "f1.txt").write_text(f"micro {f1}\nbinary None\n")
        (tmp_path / run / "region_percents.txt").write_text(f"a 1\npercent {run}.5\n")
    rows = text.read(spark, f"{tmp_path}/*/f1.txt", text.run_metrics).collect()
    assert sorted((r["run"], r["avg_type"], r["value"] or -1) for r in rows) == [("10", "binary", -1), ("10", "micro", 0.5), ("20", "binary", -1), ("20", "micro", 0.75)]
    last = text.last_value(text.numbered_lines(spark, f"{tmp_path}/*/region_percents.txt"))
    assert sorted(map(tuple, last.collect())) == [("10", 10.5), ("20", 20.5)]


def test_node_link_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": 1, "train": True, "val": False, "test": False, "label": [1, 0]}], "links": [{"source": 1, "target": 2}]}))
    nodes, links = text.node_link_graph(spark, f"{tmp_path}/g.json")
    assert nodes.first()["train"] is True and tuple(links.first()) == (1, 2)


def test_raw_rasters_and_arrays(spark, tmp_path):
    image = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "cells_2_3.raw").write_bytes(image.tobytes())
    rows = {(r["x"], r["y"]): r["v"] for r in raw.images(spark, f"{tmp_path}/*.raw").collect()}
    assert rows == {(x, y): image[x, y] / 5 for x in range(2) for y in range(3)}
    np.save(tmp_path / "f.npy", np.eye(2))
    assert sorted((r["idx"], list(r["f"])) for r in raw.vectors(spark, f"{tmp_path}/*.npy").collect()) == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]


def test_parameters():
    shared = "learning_rate 0.5\n_epochs 9\nclass_weights True\nx_box 1,2\nx_box 3,4\nunknown 7\n"
    p = parameters.load(shared, "epochs 3\n")
    assert p.learning_rate == 0.5 and p.epochs == 3 and p.class_weights and p.x_box == ((1, 2), (3, 4)) and p.walks == 20


def test_partition_codes(spark):
    rows = spark.createDataFrame([("train",), ("test",), ("val",)], "partition string")
    assert [tuple(r) for r in rows.select(sinks.partition_code(), sinks.partition_code(compat=True)).collect()] == [(0, 2), (1, 1), (2, 2)]


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, id % 3 AS user_id, 'e' AS event_type, cast(id AS double) AS value FROM range(40)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = events.run_once(spark, events.hourly(stream), "hourly_out", f"{tmp_path}/check", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.hourly(rows).collect()))


def test_selections_merge_batch_by_batch(spark, tmp_path):
    for i, batch in enumerate([[(1, 0), (2, 1)], [(2, 0), (3, 1)]]):
        spark.createDataFrame(batch, "gid long, y int").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    merge = events.merge_into(f"{tmp_path}/state")
    for i in range(2):
        merge(spark.read.parquet(f"{tmp_path}/in/part={i}"), i)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/1").select("gid", "y").collect())) == [(1, 0), (2, 0), (3, 1)]


def test_binary_files_are_written_whole_and_scanned(spark, tmp_path):
    from filigree.sources import raw, sinks

    v = [0.0, 1.0, 2.0, 4.0, 3.0, 8.0]
    content = np.asarray(v, dtype="<f4").tobytes()
    rows = [("/somewhere/a_2_3.raw", content), ("b_3_2.raw", content), ("notes.txt", None)]
    to = f"file://{tmp_path}/images"
    df = spark.createDataFrame(rows, "path string, content binary").repartition(2)
    assert sinks.binary_files(df, to) == 3 and sinks.binary_files(df, to) == 3  # again: overwritten
    assert sorted(p.name for p in (tmp_path / "images").iterdir()) == ["a_2_3.raw", "b_3_2.raw", "notes.txt"]
    got = {(r["image"], r["x"], r["y"]): r["v"] for r in raw.images(spark, to, normalise=False).collect()}
    assert got == {("a", i // 3, i % 3): x for i, x in enumerate(v)} | {("b", i // 2, i % 2): x for i, x in enumerate(v)}
    assert sinks.binary_files(df.limit(0), to) == 0
