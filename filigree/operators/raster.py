"""Operators on rasters, held as rows (x, y, v) with x from 0 to width - 1 and y from 0 to height - 1.

A focal operator sends each pixel to the windows that it belongs to, those over the border included,
and aggregates by window centre: one shuffle, which combines before it sends, and no join. Separable
kernels run one axis at a time. Rasters are dense: every pixel has its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generators


def shape(pixels: DataFrame) -> tuple[int, int]:
    r = pixels.agg(F.max("x") + 1, F.max("y") + 1).first()
    return int(r[0]), int(r[1])


def reflected(i: Column, n: int, reach: int) -> Column:
    """The places where pixel i appears in a raster that is mirrored on the outer edge of its borders: -1 shows pixel 0, n shows n - 1."""
    return F.filter(F.array(i, -1 - i, 2 * n - 1 - i), lambda e: e.between(-reach, n - 1 + reach))


def repeated(i: Column, n: int, reach: int) -> Column:
    """The places where pixel i appears if border pixels go on outwards."""
    return F.sequence(F.when(i == 0, F.lit(-reach)).otherwise(i), F.when(i == n - 1, F.lit(n - 1 + reach)).otherwise(i))


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def windows(pixels: DataFrame, offsets: list[tuple[int, int, float]] | list[tuple[int, int]], size: tuple[int, int] | None = None, border=reflected) -> DataFrame:
    """x, y, v, w: for each centre the values of its window with the offsets' weights (1 where none)."""
    width, height = size or shape(pixels)
    across, along = (max(abs(o[k]) for o in offsets) for k in (0, 1))
    if across > width or along > height:
        raise ValueError("a window reaches over more than one whole raster")
    rows = F.array(*(F.struct(F.lit(o[0]).alias("a"), F.lit(o[1]).alias("b"), F.lit(float(o[2]) if len(o) > 2 else 1.0).alias("w")) for o in offsets))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    shown = pixels.select(F.explode(border(x, width, across)).alias("_x"), y.alias("y"), "v").select("_x", F.explode(border(F.col("y"), height, along)).alias("_y"), "v")
    each = shown.select("_x", "_y", "v", F.inline(rows)).select((F.col("_x") - F.col("a")).alias("x"), (F.col("_y") - F.col("b")).alias("y"), "v", "w")
    return each.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def focal(pixels: DataFrame, offsets: list, of: Column, size: tuple[int, int] | None = None, border=reflected) -> DataFrame:
    """x, y, v: the aggregate ``of`` over each window (columns v and w)."""
    return windows(pixels, offsets, size, border).groupBy("x", "y").agg(of.alias("v"))


def weighted(pixels: DataFrame, kernel: list[tuple[int, int, float]], size: tuple[int, int] | None = None, border=reflected) -> DataFrame:
    return focal(pixels, kernel, F.sum(F.col("v") * F.col("w")), size, border)


def gaussian(pixels: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian blur, one axis at a time, with the border value repeated."""
    radius, size = int(truncate * sigma + 0.5), shape(pixels)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    kernel = [w / sum(raw) for w in raw]
    along_x = weighted(pixels, [(i - radius, 0, w) for i, w in enumerate(kernel)], size, repeated)
    return weighted(along_x, [(0, i - radius, w) for i, w in enumerate(kernel)], size, repeated)


#: The Sobel kernel along y: difference in y, smoothed over x.
SOBEL = [(a, b, float((2 - abs(a)) * b)) for a in (-1, 0, 1) for b in (-1, 1)]
#: The four-neighbour Laplacian.
LAPLACE = [(0, 0, -4.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)]


def gradients(pixels: DataFrame, along: str) -> DataFrame:
    """x, y, v: differences along an axis, central inside and one-sided at the ends."""
    other = "y" if along == "x" else "x"
    w = f"OVER (PARTITION BY {other} ORDER BY {along})"
    return pixels.selectExpr(
        "x", "y",
        f"CASE WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END AS v",
    )


def hessian_eigenvalues(pixels: DataFrame) -> DataFrame:
    """x, y, e1, e2: eigenvalues, larger first, of the matrix of second differences, in closed form."""
    gx, gy = gradients(pixels, "x"), gradients(pixels, "y")
    parts = [gradients(g, a).withColumnRenamed("v", n) for g, a, n in ((gx, "x", "hxx"), (gx, "y", "hxy"), (gy, "y", "hyy"))]
    h = parts[0].join(parts[1], ["x", "y"]).join(parts[2], ["x", "y"])
    mean, half = (F.col("hxx") + F.col("hyy")) / 2, F.sqrt(F.pow((F.col("hxx") - F.col("hyy")) / 2, 2) + F.pow("hxy", 2))
    return h.select("x", "y", (mean + half).alias("e1"), (mean - half).alias("e2"))


def normalised(pixels: DataFrame) -> DataFrame:
    """Values brought to [0, 1] by the least and the largest."""
    bounds = pixels.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    return pixels.crossJoin(F.broadcast(bounds)).select("x", "y", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))


def halved(pixels: DataFrame) -> DataFrame:
    """The largest value of each 2 x 2 block."""
    return pixels.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.max("v").alias("v"))


def rasterised(points: DataFrame, growth: int = 0) -> DataFrame:
    """x, y of every pixel that a vertex covers (row p1, column p0, truncated), grown by a square."""
    own = points.select(F.col("p1").cast("long").alias("x"), F.col("p0").cast("long").alias("y")).distinct()
    if not growth:
        return own
    around = F.sequence(F.lit(-growth), F.lit(growth))
    return own.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).select((F.col("x") + F.col("_a")).alias("x"), (F.col("y") + F.col("_b")).alias("y")).where("x >= 0 AND y >= 0").distinct()


#: Side of the cells by which pixels find their tiles.
CELL = 32


def image_tiles(pixels: DataFrame, wide: int = 64, high: int = 32, step: float = 0.5) -> DataFrame:
    """tile, x0, x1, y0, y1: overlapping tiles over the whole raster, numbered by x0, then y0."""
    width, height = shape(pixels)
    boxes = generators.tile_region(pixels.sparkSession, 0, width, 0, height, wide, high, step)
    down = math.ceil((height - high) / (high * step)) + 1 if height > high else 1
    at = lambda c, size: F.greatest(F.lit(0), F.ceil(F.col(c) / (size * step)))
    return boxes.select((at("x0", wide) * down + at("y0", high)).cast("long").alias("tile"), "x0", "x1", "y0", "y1")


def in_tiles(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile, x, y, v: the pixels of each tile (tile, x0, x1, y0, y1), half-open. Tiles are cut into cells, so that a pixel meets only those of its cell, by an equi-join."""
    of = lambda c: F.floor(c / CELL)
    cells = tiles.withColumn("_cx", F.explode(F.sequence(of(F.col("x0")), of(F.col("x1") - 1)))).withColumn("_cy", F.explode(F.sequence(of(F.col("y0")), of(F.col("y1") - 1))))
    on = (of(F.col("x")) == F.col("_cx")) & (of(F.col("y")) == F.col("_cy")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return pixels.join(cells, on).select("tile", "x", "y", "v")


def stitched(predicted: DataFrame, tiles: DataFrame, border: int, size: tuple[int, int]) -> DataFrame:
    """x, y, v of overlapping predicted tiles (tile, x, y, v): a border of each tile is dropped but for image edges; the later tile wins."""
    width, height = size
    inner = lambda c, lo, hi, n: (F.col(c) >= F.when(F.col(lo) <= 0, F.col(lo)).otherwise(F.col(lo) + border)) & (F.col(c) < F.when(F.col(hi) >= n, F.col(hi)).otherwise(F.col(hi) - border))
    kept = predicted.join(tiles, "tile").where(inner("x", "x0", "x1", width) & inner("y", "y0", "y1", height))
    return kept.groupBy("x", "y").agg(F.max_by("v", "tile").alias("v"))


def patch_votes(points: DataFrame, pixels: DataFrame, threshold: float, size: tuple[int, int]) -> DataFrame:
    """gid, share: of the 3 x 3 pixels around all vertices, the share above the threshold; vertices on the far border move inwards."""
    width, height = size
    at = lambda c, n: F.when(c + 1 >= n, n - 2).otherwise(c)
    own = points.select("gid", at(F.rint("p1").cast("long"), width).alias("_r"), at(F.rint("p0").cast("long"), height).alias("_c"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in square(1)))
    each = own.select("_r", "_c").distinct().select("_r", "_c", F.inline(around)).select("_r", "_c", F.pmod(F.col("_r") + F.col("a"), F.lit(width)).alias("x"), F.pmod(F.col("_c") + F.col("b"), F.lit(height)).alias("y"))
    votes = each.join(pixels, ["x", "y"]).groupBy("_r", "_c").agg(F.count_if(F.col("v") > threshold).alias("_above"), F.count("v").alias("_n"))  # once for each place, however many vertices lie there
    return own.groupBy("gid", "_r", "_c").agg(F.count("*").alias("_k")).join(votes, ["_r", "_c"]).groupBy("gid").agg((F.sum(F.col("_k") * F.col("_above")) / F.nullif(F.sum(F.col("_k") * F.col("_n")), F.lit(0))).alias("share"))
