"""Readers of the text formats of networks, features, boxes and runs.

Each format has a parser over a DataFrame with a column ``value`` (a line) and, where it matters, the
file's path; ``read`` puts it over files. Lines are parsed where they lie; only formats whose lines
mean something by their number need line numbers, from ``numbered_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _line() -> Column:
    return F.col("value")


def read(spark: SparkSession, path: str | list[str], parser, **options) -> DataFrame:
    return parser(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")), **options)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value, line: each file's lines with their numbers from 0; a file is split where it is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line", "value"))
    return lines.select("path", F.col("line").cast("long").alias("line"), "value")


def _pairs(numbers: Column) -> Column:
    """[a, b, c, d] to [(a, b), (c, d)]."""
    places = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    pairs = F.transform(places, lambda i: F.struct(F.get(numbers, i * 2).alias("p0"), F.get(numbers, i * 2 + 1).alias("p1")))
    return F.when(F.size(numbers) >= 2, pairs).otherwise(F.array().cast("array<struct<p0:double,p1:double>>"))


def geometry(lines: DataFrame) -> DataFrame:
    """'gid dim p0 p1 p0 p1 ...' to gid, dim, points."""
    parts = F.filter(F.split(_line(), r"\s+"), lambda s: s != "")
    numbers = F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s.cast("double"))
    return lines.where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).cast("long").alias("gid"), F.get(parts, F.lit(1)).cast("int").alias("dim"), _pairs(numbers).alias("points"))


def junctions(lines: DataFrame) -> DataFrame:
    """'gid v1 v2' to gid, v1, v2; -1 is a dangling end."""
    parts = F.split(F.trim(_line()), r"\s+")
    return lines.where(F.size(parts) >= 3).select(*(F.get(parts, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("gid", "v1", "v2"))))


def with_phantom(nodes: DataFrame) -> DataFrame:
    """The polylines (gid, points) and the phantom -1, which stands three times at (1, 1)."""
    phantom = nodes.sparkSession.range(1).select(F.lit(-1).cast("long").alias("gid"), F.array_repeat(F.struct(F.lit(1.0).alias("p0"), F.lit(1.0).alias("p1")), 3).alias("points"))
    return nodes.select("gid", "points").unionByName(phantom)


def complex_nodes(lines: DataFrame) -> DataFrame:
    """'id, x, y' to id, x, y."""
    parts = F.split(_line(), r"\s*,\s*")
    return lines.where(F.size(parts) >= 3).select(F.trim(F.get(parts, F.lit(0))).cast("long").alias("id"), *(F.trim(F.get(parts, F.lit(i))).cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))))


def complex_arcs(lines: DataFrame) -> DataFrame:
    """'id, n1, n2, x, y, ...' to id, n1, n2, points."""
    parts = F.split(_line(), r"\s*,\s*")
    numbers = F.transform(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), lambda s: F.trim(s).cast("double"))
    return lines.where(F.size(parts) >= 3).select(*(F.trim(F.get(parts, F.lit(i))).cast("long").alias(n) for i, n in enumerate(("id", "n1", "n2"))), _pairs(numbers).alias("points"))


def labels(numbered: DataFrame) -> DataFrame:
    """A label a line, the line's number being the gid, to gid, label: [0, 1] for 1, else [1, 0]."""
    one = F.get(F.split(F.trim(_line()), r"\s+"), F.lit(0)) == "1"
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return numbered.select(F.col("line").alias("gid"), F.when(one, pair(0.0, 1.0)).otherwise(pair(1.0, 0.0)).alias("label"))


def features(lines: DataFrame) -> DataFrame:
    """'gid f f ...' to gid, f as array<float>."""
    parts = F.split(F.trim(_line()), r"\s+")
    return lines.where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).cast("long").alias("gid"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda s: s.cast("float")).alias("f"))


def names(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col("line").alias("idx"), F.rtrim(_line()).alias("name"))


def spherical(lines: DataFrame) -> DataFrame:
    """'gid a b c d' to two rows: gid, row, a, b."""
    parts = F.split(F.trim(_line()), r"\s+")
    at = lambda i: F.get(parts, F.lit(i)).cast("double")
    rows = F.array(F.struct(F.lit(0).alias("row"), at(1).alias("a"), at(2).alias("b")), F.struct(F.lit(1).alias("row"), at(3).alias("a"), at(4).alias("b")))
    return lines.select(F.get(parts, F.lit(0)).cast("long").alias("gid"), F.inline(rows))


def boxes(numbered: DataFrame) -> DataFrame:
    """Alternating lines 'x_box a,b' and 'y_box c,d' to box_id, x0, x1, y0, y1."""
    kind, numbers = F.split(F.trim(_line()), r"\s+"), F.split(F.element_at(F.split(F.trim(_line()), r"\s+"), -1), ",")
    rows = numbered.where(_line().rlike("^ *[xy]_box ")).select(F.floor(F.col("line") / 2).alias("box_id"), F.get(kind, F.lit(0)).alias("k"), *(F.get(numbers, F.lit(i)).cast("int").alias(n) for i, n in enumerate("ab")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return rows.groupBy("box_id").agg(pick("x_box", "a").alias("x0"), pick("x_box", "b").alias("x1"), pick("y_box", "a").alias("y0"), pick("y_box", "b").alias("y1"))


def run_metrics(lines: DataFrame) -> DataFrame:
    """'avg_type value' lines of <run>/<metric>.txt to run, metric, avg_type, value; NULL for 'None'."""
    parts = F.split(F.trim(_line()), r"\s+")
    out = lines.where(F.size(parts) == 2).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("metric"), F.get(parts, F.lit(0)).alias("avg_type"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return out.where(F.col("metric").isin("f1", "recall", "precision"))


def last_value(numbered: DataFrame) -> DataFrame:
    """run, value of the last 'name value' line of each file."""
    last = numbered.groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run")).agg(F.max_by("value", "line").alias("v"))
    return last.select("run", F.element_at(F.split(F.trim("v"), r"\s+"), -1).cast("double").alias("value"))


def walks(lines: DataFrame) -> DataFrame:
    """'node<TAB>context' to node, ctx."""
    parts = F.split(_line(), "\t")
    return lines.where(F.size(parts) == 2).select(*(F.get(parts, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("node", "ctx"))))


def node_link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, train, val, test, label) and links (src, dst) of a node-link JSON file."""
    schema = "nodes array<struct<id:long,train:boolean,val:boolean,test:boolean,label:array<double>>>, links array<struct<source:long,target:long>>"
    graph = spark.read.schema(schema).json(path, multiLine=True)
    return graph.select(F.inline("nodes")), graph.select(F.inline("links")).select(F.col("source").alias("src"), F.col("target").alias("dst"))
