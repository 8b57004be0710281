"""Generators of boxes: x0, x1, y0, y1. Counts are known on the driver, rows are made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_region(spark: SparkSession, x0: int, x1: int, y0: int, y1: int, step_x: int = 64, step_y: int = 64, step: float = 0.5) -> DataFrame:
    """Overlapping tiles; one that would pass the end is pushed back to it. Each tile once."""
    nx = int((x1 - x0) / step_x / step + 1)
    ny = int(((y1 - y0) / step_y / step + 1) * ((x1 - x0) / step_x / step + 1))
    axis = lambda n, lo, hi, size: spark.range(n).select((F.col("id") * size * step + lo).alias("s")).select(F.when(F.col("s") + size > hi, hi - size).otherwise(F.col("s")).cast("long").alias("a"), F.when(F.col("s") + size > hi, hi).otherwise(F.col("s") + size).cast("long").alias("b")).distinct()
    xs, ys = axis(nx, x0, x1, step_x), axis(ny, y0, y1, step_y)
    return xs.select(F.col("a").alias("x0"), F.col("b").alias("x1")).crossJoin(ys.select(F.col("a").alias("y0"), F.col("b").alias("y1")))


def tiles_of(boxes: DataFrame, size: int = 64, step: float = 0.5) -> DataFrame:
    """box_id and the tiles of each box, half overlapping, pushed back to the box's end. Each tile of a box_id once.

    Tiles are pushed back by axis, so each axis is made unique before the two are crossed; a further box of
    the same id leaves out what an earlier one holds. No tiles are shuffled or hashed.
    """
    per = size * step
    starts = lambda lo, hi: F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / per).cast("int")), lambda i: F.least(F.col(lo) + i * per, F.col(hi) - F.lit(size)).cast("long")))
    axes = boxes.select("box_id", F.struct(starts("x0", "x1").alias("xs"), starts("y0", "y1").alias("ys")).alias("box")).groupBy("box_id").agg(F.collect_list("box").alias("of"))
    each = axes.select("box_id", "of", F.posexplode("of").alias("k", "box")).withColumn("a", F.explode("box.xs")).withColumn("b", F.explode("box.ys"))
    held = F.exists(F.slice("of", F.lit(1), F.col("k")), lambda e: F.array_contains(e["xs"], F.col("a")) & F.array_contains(e["ys"], F.col("b")))
    return each.where((F.col("k") == 0) | ~held).select("box_id", F.col("a").alias("x0"), (F.col("a") + size).alias("x1"), F.col("b").alias("y0"), (F.col("b") + size).alias("y1"))


def grow_boxes(boxes: DataFrame, width: int, height: int, steps: int, share: float = 0.05, final: float = 0.42) -> DataFrame:
    """box_id, step and each box grown by a share of the image at each step, kept inside; the step after the last grows by ``final``."""
    grown = boxes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    by = lambda n: F.when(F.col("step") < steps, int(share * n) * F.col("step")).otherwise(int(final * n))
    return grown.select("box_id", "step", F.greatest(F.lit(0), F.col("x0") - by(width)).alias("x0"), F.least(F.lit(width), F.col("x1") + by(width)).alias("x1"), F.greatest(F.lit(0), F.col("y0") - by(height)).alias("y0"), F.least(F.lit(height), F.col("y1") + by(height)).alias("y1"))


def sliding_pairs(spark: SparkSession, fraction: int, x: int, y: int, step: float = 1.0) -> DataFrame:
    """Windows of one fraction of each side, moved along both sides at once; an end past the image stops one short of it."""
    rows = spark.range(int(fraction * int(1 / step)))
    side = lambda n: (F.rint(F.lit(n / fraction * step)) * F.col("id"), F.rint(F.lit(n / fraction * step) * F.col("id") + n / fraction))
    end = lambda e, n: F.when(e > n, n - 1).otherwise(e).cast("long")
    (xa, xb), (ya, yb) = side(x), side(y)
    return rows.select(xa.cast("long").alias("x0"), end(xb, x).alias("x1"), ya.cast("long").alias("y0"), end(yb, y).alias("y1")).distinct()


def sliding_grid(spark: SparkSession, step_x: int, step_y: int, x: int, y: int, step: float = 1.0) -> DataFrame:
    """All pairs of windows of fixed size along each side; one past the end is pushed back to one short of it, and windows of another size are left out."""

    def axis(size: int, n: int) -> DataFrame:
        s, e = F.lit(round(size * step)) * F.col("id"), F.rint(F.lit(size * step) * F.col("id") + size)
        moved = spark.range(int(n // size * (1 / step))).select(F.when(e > n, n - 1 - size).otherwise(s).cast("long").alias("a"), F.when(e > n, n - 1).otherwise(e).cast("long").alias("b"))
        return moved.where(F.col("b") - F.col("a") == size).distinct()

    return axis(step_x, x).select(F.col("a").alias("x0"), F.col("b").alias("x1")).crossJoin(axis(step_y, y).select(F.col("a").alias("y0"), F.col("b").alias("y1")))


def growing_from_origin(spark: SparkSession, step_x: int, step_y: int, x: int, y: int, step: float = 1.0) -> DataFrame:
    """Boxes from the origin that grow by a step; one past the end becomes the last window of the first size."""
    gx, gy = round(step_x * step), round(step_y * step)
    rows = spark.range(min((x - step_x) // gx, (y - step_y) // gy) + 1)
    side = lambda size, g, n: (size + g * F.col("id"), n, size)

    def ends(size: int, g: int, n: int):
        e, _, _ = side(size, g, n)
        return F.when(e > n, n - 1 - size).otherwise(0).cast("long"), F.when(e > n, n - 1).otherwise(e).cast("long")

    (xa, xb), (ya, yb) = ends(step_x, gx, x), ends(step_y, gy, y)
    return rows.select(xa.alias("x0"), xb.alias("x1"), ya.alias("y0"), yb.alias("y1")).distinct()


def placed_windows(spark: SparkSession, step_x: int, step_y: int, x0: int, x1: int, y0: int, y1: int, step: float = 1.0) -> DataFrame:
    """Paired windows inside a region whose starts drift: each start adds its number times the step to the start before, so starts are triangular numbers until the end stops them."""

    def axis(size: int, lo: int, hi: int) -> DataFrame:
        by = round(size * step)
        start = lo + by * F.col("id") * (F.col("id") + 1) / 2
        # once a window is pushed back to the end, the next ones start from there and are pushed back again
        moved = spark.range((hi - lo) // by).select("id", F.when(start + size > hi, hi - size).otherwise(start).cast("long").alias("a"))
        return moved.select("id", "a", (F.col("a") + size).alias("b"))

    xs, ys = axis(step_x, x0, x1), axis(step_y, y0, y1)
    return xs.selectExpr("id", "a AS x0", "b AS x1").join(ys.selectExpr("id", "a AS y0", "b AS y1"), "id").drop("id").distinct()


def pointed_growth(spark: SparkSession, p0: int, p1: int, size: int, width: int, height: int, share: float = 0.05) -> DataFrame:
    """step and a box around a point that grows by a share of the image until it covers it."""
    gx, gy = max(1, int(share * width)), max(1, int(share * height))
    steps = max(math.ceil(max(p1, width - p1) / gx), math.ceil(max(p0, height - p0) / gy)) + 1
    s = F.col("id")
    return spark.range(steps).select(s.alias("step"), F.greatest(F.lit(0), p1 - size - gx * s).alias("x0"), F.least(F.lit(width), p1 + size + gx * s).alias("x1"), F.greatest(F.lit(0), p0 - size - gy * s).alias("y0"), F.least(F.lit(height), p0 + size + gy * s).alias("y1"))


def full_image(pixels: DataFrame) -> DataFrame:
    """x0, x1, y0, y1, n: the box of the whole image and its pixels; ends are exclusive."""
    return pixels.agg(F.lit(0).alias("x0"), (F.max("x") + 1).alias("x1"), F.lit(0).alias("y0"), (F.max("y") + 1).alias("y1"), F.count("*").alias("n"))
