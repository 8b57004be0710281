"""The engine's entities, made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.keeping import dense_ids, spread, spread_many


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_points(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()


def poly_points(spark: SparkSession, d: str, rows: int = 0) -> DataFrame:
    """rows: how many rows tasks are sized by, if points are grouped by gid; many are spread by it."""
    rows = spread_many(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "gid"), rows, "gid")  # partitioned by gid from here on
    return rows.selectExpr("gid", "row_number() OVER (PARTITION BY gid ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq", "l_quantity AS p0", "l_extendedprice / 1000 AS p1")


def gnode(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("y"))
    return orders.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid")), "gid", "left_semi")


def junctions(spark: SparkSession, d: str) -> DataFrame:
    """gedge without ids: pk, v1, v2."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pk"), F.col("l_orderkey").alias("v1"))
    pairs = spread(lines, lines.count(), "pk").distinct()  # dealt by pk, for the window too
    return pairs.selectExpr("pk", "v1", "coalesce(lead(v1) OVER (PARTITION BY pk ORDER BY v1), -1) AS v2")


def gedge(spark: SparkSession, d: str) -> DataFrame:
    return dense_ids(junctions(spark, d), "pk", "v1", name="gid").select("gid", "v1", "v2")


def adj(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(junctions(spark, d), table(spark, d, "lineitem").count())


def real_adj(spark: SparkSession, d: str) -> DataFrame:
    """Without the phantom node."""
    return graph.adjacency(junctions(spark, d).where("v2 >= 0"), table(spark, d, "lineitem").count())


def pixel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("x"), F.posexplode("embedding").alias("y", "v")).select("x", F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))


def image_pixel(spark: SparkSession, d: str) -> DataFrame:
    """A table of images, of a hundred vectors each."""
    return pixel(spark, d).select(F.floor(F.col("x") / 100).alias("image"), (F.col("x") % 100).alias("x"), "y", "v")


def feat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("f"), "label")


def pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), ((F.element_at("embedding", 1).cast("double") + 1) / 2).alias("p"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"))


def run_metric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.to_date("ts").alias("run"), F.lit("m").alias("model"), F.col("event_type").alias("metric"), F.lit("micro").alias("avg_type"), "value")


def part_of(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("gid") % 10
    return gnode(spark, d).withColumn("partition", F.when(at == 0, "val").when(at <= 2, "test").otherwise("train"))


def box(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 20, 40, 10, 20), (2, 60, 70, 30, 45)], "box_id int, x0 int, x1 int, y0 int, y1 int")


def ring(spark: SparkSession, d: str) -> DataFrame:
    """node, slot, nbr: five neighbours of each vector."""
    n = feat(spark, d).count()
    slots = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return feat(spark, d).select(F.col("gid").alias("node"), slots.alias("slot")).withColumn("nbr", (F.col("node") + 1 + 7 * F.col("slot")) % n)


def circles(spark: SparkSession, d: str, size: int = 12) -> DataFrame:
    """node, slot, nbr: five neighbours of each vector inside its circle of ``size`` vectors, which share what lies around them."""
    n = feat(spark, d).count()
    slots = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = feat(spark, d).select(F.col("gid").alias("node"), slots.alias("slot"))
    first = F.col("node") - F.col("node") % size
    return rows.withColumn("nbr", (first + (F.col("node") % size + 1 + 2 * F.col("slot")) % size) % n)


def area(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that follow the data: the ranges of the vertices of each customer's polylines."""
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").alias("box_id"))
    ends = [(F.floor(F.min("p1")), "x0"), (F.ceil(F.max("p1")), "x1"), (F.floor(F.min("p0")), "y0"), (F.ceil(F.max("p0")), "y1")]
    return poly_points(spark, d).join(owner, "gid").groupBy("box_id").agg(*(c.cast("long").alias(n) for c, n in ends))


def nation_area(spark: SparkSession, d: str) -> DataFrame:
    """A box for each nation, the mean of its customers'."""
    of = table(spark, d, "customer").select(F.col("c_custkey").alias("box_id"), F.col("c_nationkey").alias("nation"))
    ends = [(F.floor(F.avg("x0")), "x0"), (F.ceil(F.avg("x1")), "x1"), (F.floor(F.avg("y0")), "y0"), (F.ceil(F.avg("y1")), "y1")]
    return area(spark, d).join(of, "box_id").groupBy("nation").agg(*(c.cast("long").alias(n) for c, n in ends)).withColumnRenamed("nation", "box_id")
