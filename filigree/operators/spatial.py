"""Selection by place: boxes, nearest polylines, overlap of complexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keeping import keep

#: Boxes up to this number are broadcast and tested one by one; more are matched by cell.
BROADCAST_BOXES = 2_000
#: Cells that queries look at, up to which they are broadcast to the points; more meet them by a shuffle.
BROADCAST_CELLS = 200_000


def in_box(p0: Column, p1: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """x bounds p1, y bounds p0, inclusive on all sides."""
    return p1.between(x0, x1) & p0.between(y0, y1)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """The rows of points (p0, p1) that lie in some box (x0, x1, y0, y1).

    Few boxes are broadcast. Many are cut into cells, so that a point meets only the boxes of its cell,
    by an equi-join that shuffles on cells.
    """
    if boxes.count() <= BROADCAST_BOXES:
        return points.join(F.broadcast(boxes), in_box(F.col("p0"), F.col("p1"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")), "left_semi")
    of = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn("_cx", F.explode(F.sequence(of("x0"), of("x1")))).withColumn("_cy", F.explode(F.sequence(of("y0"), of("y1"))))
    own = points.withColumns({"_px": of("p1"), "_py": of("p0")})
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & in_box(F.col("p0"), F.col("p1"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))
    return own.join(cells, on, "left_semi").drop("_px", "_py")


def partition_by_boxes(nodes: DataFrame, points: DataFrame, boxes: DataFrame) -> DataFrame:
    """nodes (gid) with partition: 'train' if any vertex lies in any box, else 'test'."""
    chosen = points_in_boxes(points, boxes).select("gid").distinct().withColumn("_in", F.lit(True))
    return nodes.join(chosen, "gid", "left").withColumn("partition", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def nearest(queries: DataFrame, points: DataFrame, cell: float, rings: int = 3) -> DataFrame:
    """For each query (qid, q0, q1) the polyline with the nearest vertex: qid, gid, dist; ties go to the smaller gid.

    Points are kept in cells; a query looks at the cells of the rings around its own and is settled once the
    best distance is no longer than what the rings cover. Queries that stay open look again with cells four
    times as large, until all are settled or the rings hold every point: no query ever meets all points of a
    table but in cells that its own distance asks for.
    """
    d = F.sqrt(F.pow(F.col("p0") - F.col("q0"), 2) + F.pow(F.col("p1") - F.col("q1"), 2))
    around = F.sequence(F.lit(-rings), F.lit(rings))
    bounds = [F.min("p0"), F.max("p0"), F.min("p1"), F.max("p1")]
    reach = points.agg(*bounds).first()
    ends = queries.agg(F.min("q0"), F.max("q0"), F.min("q1"), F.max("q1")).first()
    if reach[0] is None or ends[0] is None:
        return queries.limit(0).select("qid").crossJoin(points.limit(0).select("gid")).withColumn("dist", F.lit(0.0))
    span = max(max(reach[1], ends[1]) - min(reach[0], ends[0]), max(reach[3], ends[3]) - min(reach[2], ends[2]))
    open_, settled = queries.select("qid", "q0", "q1"), []
    while True:
        of = lambda c, size=cell: F.floor(F.col(c) / size).cast("long")
        placed = points.select("gid", "p0", "p1", of("p0").alias("c0"), of("p1").alias("c1"))
        near = open_.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).select("qid", "q0", "q1", (of("q0") + F.col("_a")).alias("c0"), (of("q1") + F.col("_b")).alias("c1"))
        if open_.count() * (2 * rings + 1) ** 2 <= BROADCAST_CELLS:
            near = F.broadcast(near)  # points then stay where they are
        found = keep(placed.join(near, ["c0", "c1"]).groupBy("qid").agg(F.min(F.struct(d.alias("dist"), "gid")).alias("b")).select("qid", "b.gid", "b.dist"))
        covered = rings * cell
        last = covered >= span
        settled.append(found if last else found.where(F.col("dist") <= covered))
        if last:
            break
        open_ = keep(open_.join(settled[-1], "qid", "left_anti"))
        if open_.isEmpty():
            break
        cell *= 4
    return reduce(DataFrame.unionByName, settled)


def overlap_counts(points: DataFrame, marks: DataFrame, union_radius: int = 0) -> DataFrame:
    """gid, n_points, n_hit: vertices whose rounded pixel (row p1, column p0) is marked, or lies within the radius of a mark.

    marks: (r, c), distinct pixels. Rounding is half to even.
    """
    if union_radius:
        around = F.sequence(F.lit(-union_radius), F.lit(union_radius))
        marks = marks.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).select((F.col("r") + F.col("_a")).alias("r"), (F.col("c") + F.col("_b")).alias("c")).distinct()
    own = points.select("gid", F.rint("p1").cast("long").alias("r"), F.rint("p0").cast("long").alias("c"))
    hit = own.join(marks.withColumn("_m", F.lit(1)), ["r", "c"], "left")
    return hit.groupBy("gid").agg(F.count("*").alias("n_points"), F.count("_m").alias("n_hit"))


def label_overlap(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """gid, overlap: the share of vertices on positive pixels (x, y, v), looked up by truncation; 0 becomes 0.0001."""
    own = points.select("gid", F.col("p1").cast("long").alias("x"), F.col("p0").cast("long").alias("y"))
    share = own.join(pixels, ["x", "y"]).groupBy("gid").agg(F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("overlap"))
    return share.withColumn("overlap", F.when(F.col("overlap") == 0, 1e-4).otherwise(F.col("overlap")))


def pixel_values(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """gid, seq, v: the pixel under each vertex, rounded half to even."""
    own = points.select("gid", "seq", F.rint("p1").cast("long").alias("x"), F.rint("p0").cast("long").alias("y"))
    return own.join(pixels, ["x", "y"]).select("gid", "seq", "v")


def spread_seeds(points: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """qid, q0, q1: k seeds spread over the points by Lloyd's rounds, from a grid over their range.

    The seeds are k rows; each round assigns points to their nearest seed and moves seeds to the means,
    which combine before the shuffle. A seed without points stays.
    """
    spark, box = points.sparkSession, points.agg(*(f(c) for c in ("p0", "p1") for f in (F.min, F.max))).first()
    seeds = [(i, box[0] + (box[1] - box[0]) * ((i * 0.618034) % 1), box[2] + (box[3] - box[2]) * (i + 0.5) / k) for i in range(k)]
    for _ in range(rounds):
        at = F.array(*(F.struct((F.pow(F.col("p0") - a, 2) + F.pow(F.col("p1") - b, 2)).alias("d"), F.lit(i).alias("i")) for i, a, b in seeds))
        moved = {r["i"]: (r["a"], r["b"]) for r in points.groupBy(F.array_min(at)["i"].alias("i")).agg(F.avg("p0").alias("a"), F.avg("p1").alias("b")).collect()}  # k rows
        seeds = [(i, *moved.get(i, (a, b))) for i, a, b in seeds]
    return spark.createDataFrame(seeds, "qid int, q0 double, q1 double")
