"""Queries of rasters, and of boxes over them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features, generators, raster, spatial
from ..operators.keeping import spread
from . import fixtures as fx
from .registry import query
from .shapes import r

#: The raster of the queries: one row of pixels for each vector, one column for each of its 64 values.
HEIGHT = 64
_SIZE = "sz AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM pixel)"


def reflect_sql(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"least({m}, 2 * {n} - 1 - {m})"


def offsets_sql(offsets) -> str:
    return "(SELECT unnest([" + ", ".join(str(o[0]) for o in offsets) + "]) AS a, unnest([" + ", ".join(str(o[1]) for o in offsets) + "]) AS b, unnest([" + ", ".join(repr(float(o[2]) if len(o) > 2 else 1.0) for o in offsets) + "]) AS w)"


def focal_sql(of: str, offsets, source: str = "pixel", border: str = "reflect", digits: int = 6) -> str:
    at = reflect_sql if border == "reflect" else lambda i, n: f"greatest(0, least({i}, {n} - 1))"
    wanted = f"SELECT c.x AS x, c.y AS y, o.w AS w, {at('c.x + o.a', 'sz.w')} AS qx, {at('c.y + o.b', 'sz.h')} AS qy FROM {source} c, sz, {offsets_sql(offsets)} o"
    return f"SELECT o.x AS x, o.y AS y, round({of}, {digits}) + 0.0 AS v FROM ({wanted}) o JOIN {source} q ON q.x = o.qx AND q.y = o.qy GROUP BY o.x, o.y"


def out(df):
    return df.select("x", "y", r(F.col("v")).alias("v"))


@query("d09_pixels", "SELECT x, y, v FROM pixel", "pixel")
def d09(spark, d):
    return fx.pixel(spark, d)


@query("r10_mean_disk", focal_sql("avg(q.v)", raster.disk(2)), "pixel", _SIZE)
def r10(spark, d):
    return out(raster.focal(fx.pixel(spark, d), raster.disk(2), F.avg("v")))


@query("r11_variance", "SELECT p.x AS x, p.y AS y, round((p.v - m.v) * (p.v - m.v), 6) AS v FROM pixel p JOIN (" + focal_sql("avg(q.v)", raster.disk(1), digits=12) + ") m ON m.x = p.x AND m.y = p.y", "pixel", _SIZE)
def r11(spark, d):
    px = fx.pixel(spark, d)
    mean = raster.focal(px, raster.disk(1), F.avg("v")).withColumnRenamed("v", "m")
    return px.join(mean, ["x", "y"]).select("x", "y", r(F.pow(F.col("v") - F.col("m"), 2)).alias("v"))


@query("r12_median", focal_sql("median(q.v)", raster.disk(1)), "pixel", _SIZE)
def r12(spark, d):
    return out(raster.focal(fx.pixel(spark, d), raster.disk(1), F.median("v")))


@query("r13_minimum", focal_sql("min(q.v)", raster.disk(1)), "pixel", _SIZE)
def r13(spark, d):
    return out(raster.focal(fx.pixel(spark, d), raster.disk(1), F.min("v")))


@query("r13_maximum", focal_sql("max(q.v)", raster.disk(1)), "pixel", _SIZE)
def r13_max(spark, d):
    return out(raster.focal(fx.pixel(spark, d), raster.disk(1), F.max("v")))


def _kernel(sigma: float):
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return radius, [w / sum(raw) for w in raw]


def gaussian_sql(sigma: float, name: str) -> str:
    """Two common table expressions: blurred along x, then along both."""
    radius, kernel = _kernel(sigma)
    along_x = focal_sql("sum(q.v * o.w)", [(i - radius, 0, w) for i, w in enumerate(kernel)], border="clamp", digits=14)
    along_y = focal_sql("sum(q.v * o.w)", [(0, i - radius, w) for i, w in enumerate(kernel)], source=f"{name}_x", border="clamp", digits=14)
    return f"{name}_x AS ({along_x}), {name} AS ({along_y})"


@query("r14_gaussian", "SELECT x, y, round(v, 6) + 0.0 AS v FROM g1", "pixel", f"{_SIZE}, {gaussian_sql(1.0, 'g1')}")
def r14(spark, d):
    return out(raster.gaussian(fx.pixel(spark, d), 1.0))


@query("r15_dog", "SELECT a.x AS x, a.y AS y, round(a.v - b.v, 6) + 0.0 AS v FROM g1 a JOIN g2 b ON a.x = b.x AND a.y = b.y", "pixel", f"{_SIZE}, {gaussian_sql(1.0, 'g1')}, {gaussian_sql(2.0, 'g2')}")
def r15(spark, d):
    px = fx.pixel(spark, d)
    wide = raster.gaussian(px, 2.0).withColumnRenamed("v", "b")
    return raster.gaussian(px, 1.0).join(wide, ["x", "y"]).select("x", "y", r(F.col("v") - F.col("b")).alias("v"))


@query("r16_sobel", focal_sql("sum(q.v * o.w)", raster.SOBEL), "pixel", _SIZE)
def r16(spark, d):
    return out(raster.weighted(fx.pixel(spark, d), raster.SOBEL))


@query("r17_laplace", focal_sql("sum(q.v * o.w)", raster.LAPLACE), "pixel", _SIZE)
def r17(spark, d):
    return out(raster.weighted(fx.pixel(spark, d), raster.LAPLACE))


def gradient_sql(source: str, along: str) -> str:
    w = f"OVER (PARTITION BY {'y' if along == 'x' else 'x'} ORDER BY {along})"
    return f"SELECT x, y, CASE WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END AS v FROM {source}"


_HESSIAN = "gx AS ({}), gy AS ({}), hxx AS ({}), hxy AS ({}), hyy AS ({})".format(gradient_sql("{s}", "x"), gradient_sql("{s}", "y"), gradient_sql("gx", "x"), gradient_sql("gx", "y"), gradient_sql("gy", "y"))
_EIGEN = "SELECT a.x AS x, a.y AS y, round((a.v + c.v) / 2 + sqrt((a.v - c.v) / 2 * (a.v - c.v) / 2 + b.v * b.v), 6) + 0.0 AS e1, round((a.v + c.v) / 2 - sqrt((a.v - c.v) / 2 * (a.v - c.v) / 2 + b.v * b.v), 6) + 0.0 AS e2 FROM hxx a JOIN hxy b ON a.x = b.x AND a.y = b.y JOIN hyy c ON a.x = c.x AND a.y = c.y"


@query("r18_hessian", _EIGEN, "pixel", _HESSIAN.format(s="pixel"))
def r18(spark, d):
    return raster.hessian_eigenvalues(fx.pixel(spark, d)).select("x", "y", r(F.col("e1")).alias("e1"), r(F.col("e2")).alias("e2"))


@query("r18_hessian_blurred", _EIGEN, "pixel", f"{_SIZE}, {gaussian_sql(1.0, 'g1')}, " + _HESSIAN.format(s="g1"))
def r18_blurred(spark, d):
    blurred = raster.gaussian(fx.pixel(spark, d), 1.0)
    return raster.hessian_eigenvalues(blurred).select("x", "y", r(F.col("e1")).alias("e1"), r(F.col("e2")).alias("e2"))


@query("r20_shift", "SELECT p.x AS x, p.y AS y, coalesce(q.v, 0) AS v FROM pixel p LEFT JOIN pixel q ON q.x = p.x - 1 AND q.y = p.y - 1", "pixel")
def r20(spark, d):
    px = fx.pixel(spark, d)
    return px.select("x", "y").join(px.select((F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), "v"), ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


_MASK = "mask AS (SELECT DISTINCT CAST(trunc(p1) AS BIGINT) AS x, CAST(trunc(p0) AS BIGINT) AS y FROM poly_points)"


@query("r01_rasterise", "SELECT x, y FROM mask", "poly_points", _MASK)
def r01(spark, d):
    return raster.rasterised(fx.poly_points(spark, d))


@query("r24_dilate", "SELECT DISTINCT x + a AS x, y + b AS y FROM mask, (SELECT unnest(range(-2, 3)) AS a) s, (SELECT unnest(range(-2, 3)) AS b) t WHERE x + a >= 0 AND y + b >= 0", "poly_points", _MASK)
def r24(spark, d):
    return raster.rasterised(fx.poly_points(spark, d), growth=2)


_PREDICTED = "SELECT t.tile AS tile, p.x AS x, p.y AS y, p.v + t.tile AS v FROM pixel p JOIN tiles t ON p.x >= t.x0 AND p.x < t.x1 AND p.y >= t.y0 AND p.y < t.y1"


_TILES = f"{_SIZE}, tiles AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS tile, a AS x0, a + 64 AS x1, b AS y0, b + 32 AS y1 FROM (SELECT DISTINCT least(32 * i, w - 64) AS a FROM (SELECT unnest(range(CAST(w // 32 + 1 AS BIGINT))) AS i, w FROM sz) g) s, (SELECT unnest([0, 16, 32]) AS b) t)"


@query("r02_crop_tiles", "SELECT tile, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM (SELECT t.tile AS tile, p.v AS v FROM pixel p JOIN tiles t ON p.x >= t.x0 AND p.x < t.x1 AND p.y >= t.y0 AND p.y < t.y1) c GROUP BY tile", "pixel", _TILES)
def r02(spark, d):
    px = fx.pixel(spark, d)
    return raster.in_tiles(px, raster.image_tiles(px)).groupBy("tile").agg(F.count("*").alias("n"), r(F.sum("v")).alias("total"))


@query("r03_stitch", f"SELECT x, y, arg_max(v, tile) AS v FROM (SELECT c.*, t.x0, t.x1, t.y0, t.y1, sz.w AS w FROM ({_PREDICTED}) c JOIN tiles t ON t.tile = c.tile, sz) k WHERE x >= CASE WHEN x0 <= 0 THEN 0 ELSE x0 + 8 END AND x < CASE WHEN x1 >= w THEN x1 ELSE x1 - 8 END AND y >= CASE WHEN y0 = 0 THEN 0 ELSE y0 + 8 END AND y < CASE WHEN y1 >= 64 THEN y1 ELSE y1 - 8 END GROUP BY x, y", "pixel", _TILES)
def r03(spark, d):
    px = fx.pixel(spark, d)
    grid = raster.image_tiles(px)
    predicted = raster.in_tiles(px, grid).withColumn("v", F.col("v") + F.col("tile"))
    return raster.stitched(predicted, grid, 8, raster.shape(px))


@query("r04_confusion_raster", "SELECT x, y, arg_max(code, gid) AS code FROM (SELECT CAST(trunc(q.p1) AS BIGINT) AS x, CAST(trunc(q.p0) AS BIGINT) AS y, p.gid AS gid, CASE WHEN p.p > 0.5 AND p.y = 1 THEN 4 WHEN p.p > 0.5 THEN 2 WHEN p.y = 1 THEN 5 ELSE 1 END AS code FROM pred p JOIN poly_points q ON q.gid = p.gid) t GROUP BY x, y", "pred poly_points")
def r04(spark, d):
    """4 true and 2 false positives, 5 false and 1 true negatives; the larger gid is drawn last."""
    said, true = F.col("p") > 0.5, F.col("y") == 1
    code = F.when(said & true, 4).when(said, 2).when(true, 5).otherwise(1)
    rows = fx.pred(spark, d).select("gid", code.alias("code")).join(fx.poly_points(spark, d), "gid")
    return rows.groupBy(F.col("p1").cast("long").alias("x"), F.col("p0").cast("long").alias("y")).agg(F.max_by("code", "gid").alias("code"))


@query("r05_region_mask", "SELECT x, y FROM pixel WHERE (x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 20) OR (x BETWEEN 60 AND 70 AND y BETWEEN 30 AND 45)", "pixel")
def r05(spark, d):
    px = fx.pixel(spark, d).select(F.col("x").alias("p1"), F.col("y").alias("p0"))
    return spatial.points_in_boxes(px, fx.box(spark)).select(F.col("p1").alias("x"), F.col("p0").alias("y"))


@query("g07_coverage", "SELECT round(100.0 * count(*) FILTER (WHERE (x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 20) OR (x BETWEEN 60 AND 70 AND y BETWEEN 30 AND 45)) / count(*), 8) AS percent FROM pixel", "pixel")
def g07(spark, d):
    px = fx.pixel(spark, d).select(F.col("x").alias("p1"), F.col("y").alias("p0"))
    covered = spatial.points_in_boxes(px, fx.box(spark)).agg(F.count("*").alias("c"))
    return px.agg(F.count("*").alias("n")).crossJoin(covered).select(F.round(100.0 * F.col("c") / F.col("n"), 8).alias("percent"))  # one row each


@query("g06_area", "SELECT round(100.0 * sum((x1 - x0) * (y1 - y0)) / max(sz.w * sz.h), 8) AS percent FROM area, sz", "pixel area", _SIZE)
def g06(spark, d):
    """The area of all customers' boxes, of the image's."""
    width, height = raster.shape(fx.pixel(spark, d))
    return fx.area(spark, d).agg(F.round(100.0 * F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (width * height), 8).alias("percent"))


_UNDER = "under AS (SELECT q.gid AS gid, q.seq AS seq, p.v AS v FROM poly_points q JOIN pixel p ON p.x = round_even(q.p1, 0) AND p.y = round_even(q.p0, 0))"


def under(spark, d):
    return spatial.pixel_values(fx.poly_points(spark, d), fx.pixel(spark, d))


@query("j09_pixel_lookup", "SELECT gid, seq, v FROM under", "poly_points pixel", _UNDER)
def j09(spark, d):
    return under(spark, d).select("gid", F.col("seq").cast("long").alias("seq"), "v")


@query("j10_label_overlap", "SELECT gid, round(CASE WHEN s = 0 THEN 0.0001 ELSE s END, 6) AS overlap FROM (SELECT q.gid AS gid, avg(CASE WHEN p.v > 0 THEN 1.0 ELSE 0.0 END) AS s FROM poly_points q JOIN pixel p ON p.x = trunc(q.p1) AND p.y = trunc(q.p0) GROUP BY q.gid) t", "poly_points pixel")
def j10(spark, d):
    return spatial.label_overlap(fx.poly_points(spark, d), fx.pixel(spark, d)).select("gid", r(F.col("overlap")).alias("overlap"))


@query("g03_pixel_aggs", "SELECT gid, 'identity' AS channel, round(min(v), 7) + 0.0 AS min, round(max(v), 7) + 0.0 AS max, round(median(v), 7) + 0.0 AS median, round(avg(v), 7) + 0.0 AS mean FROM under GROUP BY gid", "poly_points pixel", _UNDER)
def g03(spark, d):
    rows = features.pixel_features(under(spark, d).withColumn("channel", F.lit("identity")))
    return rows.select("gid", "channel", *(r(F.col(c), 7).alias(c) for c in ("min", "max", "median", "mean")))


@query("g04_gaussian_fit", "SELECT gid, round(avg(m), 6) + 0.0 AS mu, round(stddev_pop(m), 6) AS sigma, round(var_pop(m), 6) AS var FROM (SELECT u.gid AS gid, lo + (least(9, floor((v - lo) / ((hi - lo) / 10))) + 0.5) * ((hi - lo) / 10) AS m FROM under u JOIN (SELECT gid, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM under GROUP BY gid) w ON w.gid = u.gid) t GROUP BY gid", "poly_points pixel", _UNDER)
def g04(spark, d):
    rows = features.histogram_moments(under(spark, d))
    return rows.select("gid", *(r(F.col(c)).alias(c) for c in ("mu", "sigma", "var")))


@query("g05_mode", "SELECT gid, arg_min(q, (-n, q)) + 0.0 AS mode FROM (SELECT gid, round_even(v * 100, 0) / 100 AS q, count(*) AS n FROM under GROUP BY gid, 2) t GROUP BY gid", "poly_points pixel", _UNDER)
def g05(spark, d):
    return features.smallest_mode(under(spark, d)).select("gid", (F.col("mode") + 0.0).alias("mode"))


_VOTES = "votes AS (SELECT q.gid AS gid, p.v AS v FROM (SELECT gid, CASE WHEN r + 1 >= w THEN w - 2 ELSE r END AS r, CASE WHEN c + 1 >= 64 THEN 62 ELSE c END AS c, w FROM (SELECT gid, CAST(round_even(p1, 0) AS BIGINT) AS r, CAST(round_even(p0, 0) AS BIGINT) AS c, (SELECT w FROM sz) AS w FROM poly_points) z) q, (SELECT unnest(range(-1, 2)) AS a) s, (SELECT unnest(range(-1, 2)) AS b) t, pixel p WHERE p.x = (q.r + a + w) % w AND p.y = (q.c + b + 64) % 64)"


@query("g13_patch_vote", "SELECT gid, round(avg(CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END), 8) AS share FROM votes GROUP BY gid", "poly_points pixel", f"{_SIZE}, {_VOTES}")
def g13(spark, d):
    px = fx.pixel(spark, d)
    return raster.patch_votes(fx.poly_points(spark, d), px, 0.05, (raster.shape(px)[0], HEIGHT)).select("gid", F.round("share", 8).alias("share"))


@query("g14_mean_prediction", "SELECT gid, round(avg(v), 7) + 0.0 AS p FROM under GROUP BY gid", "poly_points pixel", _UNDER)
def g14(spark, d):
    return under(spark, d).groupBy("gid").agg(r(F.avg("v"), 7).alias("p"))


_CHANNELS = f"{_SIZE}, {gaussian_sql(1.0, 'g1')}, sob AS ({focal_sql('sum(q.v * o.w)', raster.SOBEL, digits=12)}), med AS ({focal_sql('avg(q.v)', raster.disk(2), digits=12)}), ch AS (SELECT 'identity' AS channel, x, y, v FROM pixel UNION ALL SELECT 'gaussian_1', x, y, v FROM g1 UNION ALL SELECT 'sobel', x, y, v FROM sob UNION ALL SELECT 'mean_2', x, y, v FROM med)"


@query("f31_pixel_vector", "SELECT q.gid AS gid, channel, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(avg(v), 6) + 0.0 AS mean FROM poly_points q JOIN ch ON ch.x = round_even(q.p1, 0) AND ch.y = round_even(q.p0, 0) GROUP BY q.gid, channel", "poly_points pixel", _CHANNELS)
def f31(spark, d):
    """Aggregates of several channels under each polyline: one lookup join over all channels."""
    px = fx.pixel(spark, d)
    px = spread(px, px.count(), F.floor(F.col("x") / 1000))  # columns side by side share their windows
    channels = {"identity": px, "gaussian_1": raster.gaussian(px, 1.0), "sobel": raster.weighted(px, raster.SOBEL), "mean_2": raster.focal(px, raster.disk(2), F.avg("v"))}
    every = None
    for name, image in channels.items():
        one = image.select(F.lit(name).alias("channel"), "x", "y", "v")
        every = one if every is None else every.unionByName(one)
    own = fx.poly_points(spark, d).select("gid", F.rint("p1").cast("long").alias("x"), F.rint("p0").cast("long").alias("y"))
    ops = {k: features.PIXEL_OPS[k] for k in ("min", "max", "mean")}
    rows = features.pixel_features(features.looked_up(own, every), ops)
    return rows.select("gid", "channel", *(r(F.col(c)).alias(c) for c in ops))


@query("c13_linear_index", "SELECT x, y, y * 500 + x AS i, (y * 500 + x) % 500 AS bx, (y * 500 + x) // 500 AS by FROM pixel", "pixel")
def c13(spark, d):
    i = F.col("y") * 500 + F.col("x")
    return fx.pixel(spark, d).select("x", "y", i.alias("i"), F.pmod(i, F.lit(500)).alias("bx"), F.floor(i / 500).alias("by"))


@query("c14_halve", "SELECT x // 2 AS x, y // 2 AS y, max(v) AS v FROM pixel GROUP BY 1, 2", "pixel")
def c14(spark, d):
    return raster.halved(fx.pixel(spark, d))


@query("c15_normalise", "SELECT x, y, round((v - lo) / (hi - lo), 7) AS v FROM pixel, (SELECT min(v) AS lo, max(v) AS hi FROM pixel) m", "pixel")
def c15(spark, d):
    return raster.normalised(fx.pixel(spark, d)).select("x", "y", F.round("v", 7).alias("v"))


# --- boxes --------------------------------------------------------------------------------------------------


@query("c11_area_gates", "SELECT step, pct FROM (SELECT i AS step, 100.0 * least(40, 4 + 2 * i) * least(30, 3 + i) / 1200 AS pct FROM (SELECT unnest(range(30)) AS i) s) t WHERE pct >= 2 AND pct <= 60")
def c11(spark, d):
    """Steps whose box covers enough to train on; growth is monotone, so stopping early and filtering agree."""
    i = F.col("id")
    pct = 100.0 * F.least(F.lit(40), 4 + 2 * i) * F.least(F.lit(30), 3 + i) / 1200
    return spark.range(30).select(i.alias("step"), pct.alias("pct")).where("pct >= 2 AND pct <= 60")


def _axis(n: str, size: int = 32) -> str:
    return f"(SELECT DISTINCT least(s, {n} - {size}) AS a, least(s, {n} - {size}) + {size} AS b FROM (SELECT {size // 2} * unnest(range({n} // {size // 2} + 1)) AS s, {n} FROM sz) g)"


def size(spark, d):
    return raster.shape(fx.pixel(spark, d))


@query("n01_tile_region", f"SELECT x.a AS x0, x.b AS x1, y.a AS y0, y.b AS y1 FROM {_axis('w')} x, {_axis('h')} y", "pixel", _SIZE)
def n01(spark, d):
    width, height = size(spark, d)
    return generators.tile_region(spark, 0, width, 0, height, 32, 32)


_SHARE = lambda share, n: f"CAST(floor(CAST({share} AS DOUBLE) * {n}) AS BIGINT)"


@query(
    "n02_grow_box",
    f"SELECT box_id, s AS step, greatest(0, x0 - gx) AS x0, least(w, x1 + gx) AS x1, greatest(0, y0 - gy) AS y0, least(h, y1 + gy) AS y1 FROM (SELECT area.*, s, w, h, CASE WHEN s < 12 THEN {_SHARE(0.05, 'w')} * s ELSE {_SHARE(0.42, 'w')} END AS gx, CASE WHEN s < 12 THEN {_SHARE(0.05, 'h')} * s ELSE {_SHARE(0.42, 'h')} END AS gy FROM area, sz, (SELECT unnest(range(13)) AS s) k) b",
    "pixel area",
    _SIZE,
)
def n02(spark, d):
    return generators.grow_boxes(fx.area(spark, d), *size(spark, d), 12)


@query("n03_box_regions", "SELECT DISTINCT box_id, least(x0 + 8 * i, x1 - 16) AS x0, least(x0 + 8 * i, x1 - 16) + 16 AS x1, least(y0 + 8 * j, y1 - 16) AS y0, least(y0 + 8 * j, y1 - 16) + 16 AS y1 FROM (SELECT *, unnest(range((y1 - y0) // 8 + 1)) AS j FROM (SELECT *, unnest(range((x1 - x0) // 8 + 1)) AS i FROM area) t) b", "area")
def n03(spark, d):
    return generators.tiles_of(fx.area(spark, d), size=16)


@query("n04_full_image", "SELECT 0 AS x0, max(x) + 1 AS x1, 0 AS y0, max(y) + 1 AS y1, count(*) AS n FROM pixel", "pixel")
def n04(spark, d):
    """The crop of the image's full width, which only the whole image is."""
    return generators.full_image(fx.pixel(spark, d))


@query("n05_sliding_windows", "SELECT DISTINCT CAST(round_even(w / 8.0, 0) * i AS BIGINT) AS x0, CAST(CASE WHEN xe > w THEN w - 1 ELSE xe END AS BIGINT) AS x1, CAST(round_even(h / 8.0, 0) * i AS BIGINT) AS y0, CAST(CASE WHEN ye > h THEN h - 1 ELSE ye END AS BIGINT) AS y1 FROM (SELECT i, w, h, round_even(w / 8.0 * i + w / 4.0, 0) AS xe, round_even(h / 8.0 * i + h / 4.0, 0) AS ye FROM sz, (SELECT unnest(range(8)) AS i) s) t", "pixel", _SIZE)
def n05(spark, d):
    return generators.sliding_pairs(spark, 4, *size(spark, d), step=0.5)


def _grid(n: str, size: int) -> str:
    return f"(SELECT DISTINCT CASE WHEN {size // 2} * i + {size} > {n} THEN {n} - 1 - {size} ELSE {size // 2} * i END AS a, CASE WHEN {size // 2} * i + {size} > {n} THEN {n} - 1 ELSE {size // 2} * i + {size} END AS b FROM (SELECT {n}, unnest(range({n} // {size} * 2)) AS i FROM sz) s)"


@query("n06_fixed_windows", f"SELECT x.a AS x0, x.b AS x1, y.a AS y0, y.b AS y1 FROM {_grid('w', 32)} x, {_grid('h', 16)} y", "pixel", _SIZE)
def n06(spark, d):
    return generators.sliding_grid(spark, 32, 16, *size(spark, d), step=0.5)


@query("n07_growing_box", "SELECT 0 AS x0, 32 + 16 * i AS x1, 0 AS y0, 16 + 8 * i AS y1 FROM (SELECT unnest(range(least((w - 32) // 16, (h - 16) // 8) + 1)) AS i FROM sz) s", "pixel", _SIZE)
def n07(spark, d):
    return generators.growing_from_origin(spark, 32, 16, *size(spark, d), step=0.5)


@query("n08_placed_windows", "SELECT DISTINCT least(10 + 16 * (i * (i + 1)) // 2, w - 10 - 32) AS x0, least(10 + 16 * (i * (i + 1)) // 2, w - 10 - 32) + 32 AS x1, least(5 + 8 * (i * (i + 1)) // 2, h - 5 - 16) AS y0, least(5 + 8 * (i * (i + 1)) // 2, h - 5 - 16) + 16 AS y1 FROM (SELECT w, h, unnest(range(least((w - 20) // 16, (h - 10) // 8))) AS i FROM sz) s", "pixel", _SIZE)
def n08(spark, d):
    width, height = size(spark, d)
    return generators.placed_windows(spark, 32, 16, 10, width - 10, 5, height - 5, step=0.5)


@query(
    "n09_pointed_growth",
    "SELECT s AS step, greatest(0, px - 8 - gx * s) AS x0, least(w, px + 8 + gx * s) AS x1, greatest(0, py - 8 - gy * s) AS y0, least(h, py + 8 + gy * s) AS y1 FROM (SELECT *, unnest(range(greatest(ceil(greatest(px, w - px) / gx), ceil(greatest(py, h - py) / gy))::BIGINT + 1)) AS s FROM "
    f"(SELECT w, h, w // 2 AS px, h // 2 AS py, greatest(1, {_SHARE(0.05, 'w')}) AS gx, greatest(1, {_SHARE(0.05, 'h')}) AS gy FROM sz) z) t",
    "pixel",
    _SIZE,
)
def n09(spark, d):
    width, height = size(spark, d)
    return generators.pointed_growth(spark, height // 2, width // 2, 8, width, height)


@query("u01_custom_ops", "SELECT gid, 'identity' AS channel, round(max(v) - min(v), 7) AS range, round(sum(v * v), 6) AS energy FROM under GROUP BY gid", "poly_points pixel", _UNDER)
def u01(spark, d):
    """Aggregates of the caller's own in place of the registered ones."""
    ops = {"range": lambda c: F.max(c) - F.min(c), "energy": lambda c: F.sum(F.col(c) * F.col(c))}
    rows = features.pixel_features(under(spark, d).withColumn("channel", F.lit("identity")), ops)
    return rows.select("gid", "channel", F.round("range", 7).alias("range"), F.round("energy", 6).alias("energy"))


@query("r06_channel_zero", "SELECT x, y, CASE WHEN y < 8 THEN 0.0 ELSE round((v - lo) / (hi - lo), 6) END AS v FROM pixel, (SELECT min(v) AS lo, max(v) AS hi FROM pixel) m", "pixel")
def r06(spark, d):
    return raster.normalised(fx.pixel(spark, d)).select("x", "y", F.when(F.col("y") < 8, 0.0).otherwise(F.round("v", 6)).alias("v"))
