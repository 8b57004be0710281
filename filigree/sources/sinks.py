"""Writers of the text formats; each takes a DataFrame and a folder. Columns are made into lines where they lie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, line: Column, path: str, mode: str) -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def _numbers(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def geometry_line() -> Column:
    return F.concat_ws(" ", F.col("gid").cast("string"), F.col("dim").cast("string"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["p0"].cast("string"), p["p1"].cast("string"))), " "))


def geometry(df: DataFrame, path: str, mode: str = "error") -> None:
    _write(df, geometry_line(), path, mode)


def junctions(df: DataFrame, path: str, mode: str = "error") -> None:
    _write(df, F.concat_ws(" ", *(F.col(c).cast("string") for c in ("gid", "v1", "v2"))), path, mode)


def feature_line() -> Column:
    return F.concat_ws(" ", F.col("gid").cast("string"), _numbers(F.col("f")))


def features(df: DataFrame, path: str, mode: str = "error") -> None:
    _write(df, feature_line(), path, mode)


def predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    _write(df, F.concat_ws(" ", F.col("gid").cast("string"), F.col("p").cast("string")), path, mode)


def partition_code(compat: bool = False) -> Column:
    """0 train, 1 test, 2 val; in compat mode test is 1 and both others are 2."""
    part = F.col("partition")
    return F.when(part == "test", 1).otherwise(2) if compat else F.when(part == "train", 0).when(part == "test", 1).otherwise(2)


def partitions(df: DataFrame, path: str, mode: str = "error", compat: bool = False) -> None:
    _write(df, F.concat_ws(" ", F.col("gid").cast("string"), partition_code(compat).cast("string")), path, mode)


def walks(df: DataFrame, path: str, mode: str = "error") -> None:
    _write(df, F.concat_ws("\t", F.col("node").cast("string"), F.col("ctx").cast("string")), path, mode)


def box_lines() -> Column:
    """The two lines of a box."""
    return F.concat(F.lit("x_box "), F.concat_ws(",", F.col("x0").cast("string"), F.col("x1").cast("string")), F.lit("\ny_box "), F.concat_ws(",", F.col("y0").cast("string"), F.col("y1").cast("string")))


def boxes(df: DataFrame, path: str, mode: str = "error") -> None:
    """In one file, in order: a box file is small by nature."""
    df.orderBy("box_id").coalesce(1).select(box_lines().alias("value")).write.mode(mode).text(path)


def statistics_lines(df: DataFrame) -> DataFrame:
    """One row of measures as name, value."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))))


def first_embeddings(df: DataFrame) -> DataFrame:
    """id, vec: of several vectors of an id the one met first (smallest batch)."""
    return df.groupBy("id").agg(F.min_by("vec", "batch").alias("vec"))


#: Nodes or links in one JSON text, about.
JSON_ROWS = 10_000


def node_link_json(nodes: DataFrame, links: DataFrame, json_rows: int = JSON_ROWS) -> DataFrame:
    """One JSON text a part of the graph: kind, part, json. Parts hold about json_rows rows each; links are dealt by both ends, so that those of one source spread."""

    def dealt(df: DataFrame, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(-(-df.count() // json_rows) or 1)).alias("part")

    a = nodes.groupBy(dealt(nodes, "gid")).agg(F.to_json(F.collect_list(F.struct(F.col("gid").alias("id"), "partition", "y"))).alias("json")).select(F.lit("nodes").alias("kind"), "part", "json")
    b = links.groupBy(dealt(links, "src", "dst")).agg(F.to_json(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("json")).select(F.lit("links").alias("kind"), "part", "json")
    return a.unionByName(b)


def ranked(df: DataFrame, path: str, mode: str = "error") -> None:
    """'name value' lines, the largest value first, in one file: there are as many as features."""
    line = F.concat_ws(" ", "name", F.col("value").cast("string"))
    df.orderBy(F.desc("value"), "name").coalesce(1).select(line.alias("value")).write.mode(mode).text(path)


def scores(df: DataFrame, path: str, mode: str = "error") -> None:
    """'name value' lines of any number, in no order."""
    _write(df, F.concat_ws(" ", "name", F.col("value").cast("string")), path, mode)


def binary_files(df: DataFrame, folder: str) -> int:
    """Writes each row's content as a file in folder, under the last part of its path; returns how many.

    Spark reads binary files but has no writer of them, so tasks write through the file system that the
    folder's address names. A file is written aside and then moved, so a task that runs twice leaves each
    file whole and once; rows of one name overwrite each other. A null content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, aside = f"{at}/{path.rsplit('/', 1)[-1]}", f"{at}/_{uuid.uuid4().hex}"  # Spark's readers pass over names that begin with _
                with system.open_output_stream(aside) as out:
                    out.write(content or b"")
                system.move(aside, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
