"""Queries of file formats: the tables are written as lines of a format and parsed again."""

from __future__ import annotations

import gzip
import time
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators.keeping import dense_ids, keep, new_folder
from ..sources import parameters, raw, selection, sinks, text
from . import fixtures as fx
from .registry import query
from .shapes import lines, r


@query("a01_geo_lines", "SELECT gid, 1 AS dim, n, round(f0, 6) AS f0, round(l1, 6) AS l1 FROM line", "line")
def a01(spark, d):
    written = lines(spark, d).withColumn("dim", F.lit(1)).select(sinks.geometry_line().alias("value"))
    p = F.col("points")
    return text.geometry(written).select("gid", "dim", F.size(p).cast("long").alias("n"), r(F.get(p, F.lit(0))["p0"]).alias("f0"), r(F.element_at(p, -1)["p1"]).alias("l1"))


@query("a01_phantom", "SELECT gid, n FROM line UNION ALL SELECT -1, 3", "line")
def a01_phantom(spark, d):
    return text.with_phantom(lines(spark, d)).select("gid", F.size("points").cast("long").alias("n"))


@query("a02_complex", "SELECT a.gid AS id, a.v1 AS n1, a.v2 AS n2, b.y AS y1 FROM gedge a JOIN gnode b ON b.gid = a.v1", "gedge gnode")
def a02(spark, d):
    arcs = text.complex_arcs(fx.gedge(spark, d).select(F.concat_ws(", ", F.col("gid").cast("string"), F.col("v1").cast("string"), F.col("v2").cast("string"), F.lit("1.5"), F.lit("2.5")).alias("value")))
    nodes = text.complex_nodes(fx.gnode(spark, d).select(F.concat_ws(",", F.col("gid").cast("string"), F.lit("0.5"), F.col("y").cast("string")).alias("value")))
    return arcs.join(nodes.select(F.col("id").alias("n1"), F.col("y").cast("int").alias("y1")), "n1").select("id", "n1", "n2", "y1")


@query("a03_labels", "SELECT vec_id AS gid, CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END AS second FROM embeddings")
def a03(spark, d):
    numbered = fx.feat(spark, d).select(F.col("gid").alias("line"), F.col("label").cast("string").alias("value"))
    return text.labels(numbered).select("gid", F.element_at("label", 2).alias("second"))


@query("a04_features", "SELECT vec_id AS gid, len(embedding) AS n, round(CAST(embedding[5] AS DOUBLE), 6) + 0.0 AS fifth FROM embeddings")
def a04(spark, d):
    written = fx.feat(spark, d).select(sinks.feature_line().alias("value"))
    return text.features(written).select("gid", F.size("f").cast("long").alias("n"), r(F.element_at("f", 5).cast("double")).alias("fifth"))


@query("a05_names", "SELECT n_nationkey AS idx, n_name AS name FROM nation")
def a05(spark, d):
    return text.names(fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.concat("n_name", F.lit("  ")).alias("value")))


@query("a06_spherical", "SELECT gid, 0 AS row, f0 AS a, f1 AS b FROM line UNION ALL SELECT gid, 1, l0, l1 FROM line", "line")
def a06(spark, d):
    p = F.col("points")
    ends = [F.get(p, F.lit(0))["p0"], F.get(p, F.lit(0))["p1"], F.element_at(p, -1)["p0"], F.element_at(p, -1)["p1"]]
    return text.spherical(lines(spark, d).select(F.concat_ws(" ", F.col("gid").cast("string"), *(e.cast("string") for e in ends)).alias("value")))


def box_lines(spark, d):
    """line, value: the lines of a file of all customers' boxes, two for each."""
    placed = dense_ids(fx.area(spark, d), "box_id", name="place")
    return placed.select("place", F.posexplode(F.split(sinks.box_lines(), "\n")).alias("k", "value")).select((2 * F.col("place") + F.col("k")).cast("long").alias("line"), "value")


@query("a13_boxes", "SELECT row_number() OVER (ORDER BY box_id) - 1 AS box_id, x0, x1, y0, y1 FROM area", "area")
def a13(spark, d):
    return text.boxes(box_lines(spark, d))


@query("a14_run_metrics", "SELECT CAST(run AS VARCHAR) AS run, 'f1' AS metric, metric AS avg_type, round(max(value), 4) AS value FROM run_metric GROUP BY run, metric", "run_metric")
def a14(spark, d):
    per = fx.run_metric(spark, d).groupBy("run", "metric").agg(F.round(F.max("value"), 4).alias("value"))
    written = per.select(F.concat(F.lit("/runs/"), F.col("run").cast("string"), F.lit("/f1.txt")).alias("path"), F.concat_ws(" ", "metric", F.col("value").cast("string")).alias("value"))
    return text.run_metrics(written)


@query("a15_walks", "SELECT v1 AS node, v2 AS ctx FROM gedge", "gedge")
def a15(spark, d):
    return text.walks(fx.gedge(spark, d).select(F.concat_ws("\t", F.col("v1").cast("string"), F.col("v2").cast("string")).alias("value")))


@query("a16_embeddings", "SELECT vec_id AS id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def a16(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.round(norm, 4).alias("norm"))


@query("b03_prediction_lines", "SELECT gid, round(p, 6) AS p FROM pred", "pred")
def b03(spark, d):
    line = F.concat_ws(" ", F.col("gid").cast("string"), F.col("p").cast("string"))
    parts = F.split("value", " ")
    return fx.pred(spark, d).select(line.alias("value")).select(F.get(parts, F.lit(0)).cast("long").alias("gid"), r(F.get(parts, F.lit(1)).cast("double")).alias("p"))


@query("b04_partition_codes", "SELECT gid, CASE partition WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS code, CASE WHEN partition = 'test' THEN 1 ELSE 2 END AS compat FROM part_of", "part_of")
def b04(spark, d):
    return fx.part_of(spark, d).select("gid", sinks.partition_code().alias("code"), sinks.partition_code(compat=True).alias("compat"))


@query("b06_graph_statistics", "SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM gnode UNION ALL SELECT 'positive', CAST(sum(y) AS DOUBLE) FROM gnode", "gnode")
def b06(spark, d):
    return sinks.statistics_lines(fx.gnode(spark, d).agg(F.count("*").alias("n"), F.sum("y").alias("positive")))


@query("b11_json_graph", "SELECT gid, partition, y FROM part_of", "part_of")
def b11(spark, d):
    written = sinks.node_link_json(fx.part_of(spark, d), fx.real_adj(spark, d)).where("kind = 'nodes'")
    return written.select(F.explode(F.from_json("json", "array<struct<id:long,partition:string,y:int>>")).alias("n")).select(F.col("n.id").alias("gid"), "n.partition", "n.y")


@query("b13_first_embeddings", "SELECT label AS id, min(vec_id) AS batch, arg_min(CAST(embedding[1] AS DOUBLE), vec_id) AS first FROM embeddings GROUP BY label")
def b13(spark, d):
    rows = fx.feat(spark, d).select(F.col("label").alias("id"), F.col("gid").alias("batch"), F.col("f").alias("vec"))
    kept = sinks.first_embeddings(rows).join(rows.groupBy("id").agg(F.min("batch").alias("batch")), "id")
    return kept.select("id", "batch", F.element_at("vec", 1).cast("double").alias("first"))


@query("a07_node_link", "SELECT gid AS id, partition = 'train' AS train, y FROM part_of", "part_of")
def a07(spark, d):
    """Nodes as JSON texts, read back with the schema of node-link files."""
    p = F.col("partition")
    written = fx.part_of(spark, d).select(F.to_json(F.struct(F.col("gid").alias("id"), (p == "train").alias("train"), (p == "val").alias("val"), (p == "test").alias("test"), F.array(1.0 - F.col("y"), F.col("y").cast("double")).alias("label"))).alias("json"))
    back = written.select(F.from_json("json", "id long, train boolean, val boolean, test boolean, label array<double>").alias("n"))
    return back.select("n.id", "n.train", F.element_at("n.label", 2).cast("int").alias("y"))


@query("b02_feature_lines", "SELECT vec_id AS gid, len(embedding) + 1 AS n FROM embeddings")
def b02(spark, d):
    return fx.feat(spark, d).select("gid", F.size(F.split(sinks.feature_line(), " ")).cast("long").alias("n"))


_PLACED = "placed AS (SELECT *, row_number() OVER (ORDER BY box_id) - 1 AS place FROM area)"


@query("b05_selection_bounds", "SELECT 2 * place AS line, 'x_box ' || x0 || ',' || x1 AS value FROM placed UNION ALL SELECT 2 * place + 1, 'y_box ' || y0 || ',' || y1 FROM placed", "area", _PLACED)
def b05(spark, d):
    return box_lines(spark, d)


@query("b07_training_percentages", "SELECT round(100.0 * count(*) FILTER (WHERE partition = 'train') / count(*), 6) AS percent, round(100.0 * count(*) FILTER (WHERE partition = 'train' AND y = 1) / count(*) FILTER (WHERE y = 1), 6) AS percent_positive FROM part_of", "part_of")
def b07(spark, d):
    train, positive = F.col("partition") == "train", F.col("y") == 1
    return fx.part_of(spark, d).agg(F.round(100.0 * F.count_if(train) / F.count("*"), 6).alias("percent"), F.round(100.0 * F.count_if(train & positive) / F.count_if(positive), 6).alias("percent_positive"))


@query("b10_model_scores", "SELECT metric, metric || ' ' || count(*) AS line FROM run_metric GROUP BY metric", "run_metric")
def b10(spark, d):
    return fx.run_metric(spark, d).groupBy("metric").agg(F.count("*").alias("n")).select("metric", F.concat_ws(" ", "metric", F.col("n").cast("string")).alias("line"))


@query("b12_walk_lines", "SELECT v1 AS node, CAST(v1 AS VARCHAR) || chr(9) || CAST(v2 AS VARCHAR) AS line FROM gedge", "gedge")
def b12(spark, d):
    return fx.gedge(spark, d).select(F.col("v1").alias("node"), F.concat_ws("\t", F.col("v1").cast("string"), F.col("v2").cast("string")).alias("line"))


# --- through files, written to the shared folder and read back ----------------------------------------------


@F.pandas_udf(BinaryType())
def float_bytes(rows: pd.Series) -> pd.Series:
    return rows.map(lambda f: np.asarray(f, dtype="<f4").tobytes())


@F.pandas_udf(BinaryType())
def grey_map(ids: pd.Series) -> pd.Series:
    """An 8 x 4 grey map with a comment, gzipped."""
    pixels = lambda i: bytes((i * 7 + k * 13) % 256 for k in range(32))
    return ids.map(lambda i: gzip.compress(b"P5 # made up\n8 4\n255\n" + pixels(i)))


@query("a08_raw_images", "SELECT 'img_' || gid AS image, pos // 8 AS x, pos % 8 AS y, round((v - lo) / (hi - lo), 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY gid) AS lo, max(v) OVER (PARTITION BY gid) AS hi FROM fpos) t", "fpos")
def a08(spark, d):
    """Every vector as a file of an 8 x 8 image, written and then read with their names."""
    to = new_folder(spark, "images")
    sinks.binary_files(fx.feat(spark, d).select(F.format_string("img_%d_8_8.raw", "gid").alias("path"), float_bytes("f").alias("content")), to)
    return raw.images(spark, to).select("image", "x", "y", r(F.col("v")).alias("v"))


@query("a09_grey_maps", "SELECT 'm' || gid AS image, k % 8 AS x, k // 8 AS y, round(((gid * 7 + k * 13) % 256) / 255.0, 6) AS v FROM feat, (SELECT unnest(range(32)) AS k) p", "feat")
def a09(spark, d):
    to = new_folder(spark, "grey-maps")
    sinks.binary_files(fx.feat(spark, d).select(F.format_string("m%d.pgm.gz", "gid").alias("path"), grey_map("gid").alias("content")), to)
    return raw.grey_map_files(spark, to).select("image", "x", "y", r(F.col("v")).alias("v"))


@query("a10_dataset_selection", "SELECT i.idx AS idx, o_orderkey AS image, o_custkey AS mask, o_totalprice AS seg FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) i WHERE idx < 100")
def a10(spark, d):
    """Three lists joined by place, the first hundred places."""
    placed = dense_ids(fx.table(spark, d, "orders"), "o_orderkey")
    each = {name: placed.select(F.col("idx").cast("long").alias("idx"), F.col(column).alias("value")) for name, column in (("image", "o_orderkey"), ("mask", "o_custkey"), ("seg", "o_totalprice"))}
    return selection.zipped(each, first=100)


_PAIRS = "'(' || string_agg('(' || {0}0 || ', ' || {0}1 || ')', ', ' ORDER BY box_id) || CASE WHEN count(*) = 1 THEN ',)' ELSE ')' END"


@query(
    "a11_parameters",
    "SELECT name, value FROM (VALUES ('learning_rate', '0.1'), ('batch_size', '128'), ('class_weights', 'True'), ('samples', '(25, 10)')) t(name, value) UNION ALL SELECT 'epochs', CAST(count(*) AS VARCHAR) FROM customer "
    f"UNION ALL SELECT 'x_box', {_PAIRS.format('x')} FROM nation_area UNION ALL SELECT 'y_box', {_PAIRS.format('y')} FROM nation_area",
    "nation_area",
)
def a11(spark, d):
    """A shared file, with a line for the x range of each nation's box, and a personal one over it, with the y ranges and the number of customers; a12's record types the values and gives defaults."""
    to = new_folder(spark, "parameters")
    boxes = fx.nation_area(spark, d).orderBy("box_id").collect()  # nations
    shared = ["learning_rate 0.1", "_epochs 7", "epochs 9", *(f"x_box {b['x0']},{b['x1']}" for b in boxes), "class_weights True", "unknown 5"]
    personal = [f"epochs {fx.table(spark, d, 'customer').count()}", *(f"y_box {b['y0']},{b['y1']}" for b in boxes)]
    for name, lines in (("shared", shared), ("personal", personal)):
        spark.createDataFrame([("\n".join(lines) + "\n",)], "value string").coalesce(1).write.text(f"{to}/{name}")
    read = lambda name: "\n".join(row["value"] for row in spark.read.text(f"{to}/{name}", wholetext=True).collect())  # noqa: E731  (a parameter file)
    found = asdict(parameters.load(read("shared"), read("personal")))
    return spark.createDataFrame([(k, str(found[k])) for k in ("learning_rate", "epochs", "batch_size", "class_weights", "x_box", "y_box", "samples")], "name string, value string")


@query("a16_embedding_files", "SELECT vec_id AS id, len(embedding) AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def a16_files(spark, d):
    """Arrays of a thousand rows, and beside each the ids of its rows, line by line."""
    rows = dense_ids(fx.feat(spark, d).select(F.col("gid").alias("id"), "f"), "id")
    files, to = keep(raw.encoded_vectors(rows)), new_folder(spark, "arrays")
    sinks.binary_files(files, to)
    ids = files.select("path", F.posexplode(F.split("ids", "\n")).alias("idx", "id"))
    back = raw.vectors(spark, to).withColumn("path", F.substring_index("path", "/", -1))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return back.join(ids, ["path", "idx"]).select(F.col("id").cast("long").alias("id"), F.size("f").cast("long").alias("n"), F.round(norm, 4).alias("norm"))


@query("b01_geometry_files", "SELECT l.gid AS gid, n, round(f0, 6) AS f0, round(l1, 6) AS l1, count(e.gid) AS junctions FROM line l LEFT JOIN gedge e ON e.v1 = l.gid GROUP BY ALL", "line gedge")
def b01(spark, d):
    to = new_folder(spark, "geometry")
    sinks.geometry(lines(spark, d).withColumn("dim", F.lit(1)), f"{to}/geom")
    sinks.junctions(fx.gedge(spark, d), f"{to}/edges")
    back, edges = text.read(spark, f"{to}/geom", text.geometry), text.read(spark, f"{to}/edges", text.junctions)
    p = F.col("points")
    ends = back.select("gid", F.size(p).cast("long").alias("n"), r(F.get(p, F.lit(0))["p0"]).alias("f0"), r(F.element_at(p, -1)["p1"]).alias("l1"))
    degree = edges.groupBy(F.col("v1").alias("gid")).agg(F.count("*").alias("junctions"))
    return ends.join(degree, "gid", "left").withColumn("junctions", F.coalesce("junctions", F.lit(0).cast("long")))


@query("b03_prediction_files", "SELECT gid, round(p, 6) AS p FROM pred", "pred")
def b03_files(spark, d):
    to = new_folder(spark, "predictions")
    sinks.predictions(fx.pred(spark, d), to)
    return spark.read.csv(to, sep=" ", schema="gid long, p double").select("gid", r(F.col("p")).alias("p"))


@query("b08_ranked_importance", "SELECT row_number() OVER (ORDER BY value DESC, name) - 1 AS line, name, value FROM (SELECT 'f' || pos AS name, round(abs(corr(v, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END)), 6) AS value FROM fpos GROUP BY pos) t", "fpos")
def b08(spark, d):
    """Features by how far they correlate with the label, written in their order."""
    to = new_folder(spark, "importance")
    each = fx.feat(spark, d).select(F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("y"), F.posexplode("f").alias("pos", "v"))
    sinks.ranked(each.groupBy("pos").agg(r(F.abs(F.corr(F.col("v").cast("double"), "y"))).alias("value")).select(F.format_string("f%d", "pos").alias("name"), "value"), to)
    parts = F.split("value", " ")
    return text.numbered_lines(spark, to).select("line", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).cast("double").alias("value"))


_TIMED = ("customer", "orders", "lineitem", "embeddings", "events")


@query("b09_timings", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, true AS measured FROM {t}" for t in _TIMED))
def b09(spark, d):
    """The seconds that it takes to count each table, and the count, written as lines."""
    to, rows = new_folder(spark, "timings"), []
    for name in _TIMED:
        begin = time.monotonic()
        n = fx.table(spark, d, name).count()
        rows.append((f"{name} {n}", time.monotonic() - begin))
    sinks.scores(spark.createDataFrame(rows, "name string, value double"), to)
    part = lambda i: F.get(F.split("value", " "), F.lit(i))
    return spark.read.text(to).select(part(0).alias("name"), part(1).cast("long").alias("n"), (part(2).cast("double") >= 0).alias("measured"))


@query("b10_score_files", "SELECT metric AS name, count(*) AS value FROM run_metric GROUP BY metric", "run_metric")
def b10_files(spark, d):
    to, parts = new_folder(spark, "scores"), F.split("value", " ")
    sinks.scores(fx.run_metric(spark, d).groupBy(F.col("metric").alias("name")).agg(F.count("*").alias("value")), to)
    return spark.read.text(to).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).cast("long").alias("value"))


@query("b16_overwritten_run", "SELECT gid, CASE partition WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS code FROM part_of WHERE y = 1", "part_of")
def b16(spark, d):
    """A run that writes over what the run before has left."""
    to, nodes = new_folder(spark, "partitions"), fx.part_of(spark, d)
    sinks.partitions(nodes, to)
    sinks.partitions(nodes.where("y = 1"), to, mode="overwrite")
    return spark.read.csv(to, sep=" ", schema="gid long, code int")
