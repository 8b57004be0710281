"""Readers of raw rasters and arrays; dimensions stand in the name or the header."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_NAME = r"([^/]+)_(\d+)_(\d+)\.raw$"


def images(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """image, x, y, v of float32 files named <name>_X_Y.raw."""
    return decoded_images(spark.read.format("binaryFile").load(path), normalise)


def decoded_images(files: DataFrame, normalise: bool = True) -> DataFrame:
    """image, x, y, v of (path, content); normalised to [0, 1] by each image's own range. A file is one row of a task: images are far smaller than a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, w, h, content in frame.itertuples(index=False):
                v = np.frombuffer(content, dtype="<f4").reshape(w, h).astype(np.float64)
                if normalise and v.max() > v.min():
                    v = (v - v.min()) / (v.max() - v.min())
                x, y = np.indices(v.shape)
                yield pd.DataFrame({"image": name, "x": x.ravel(), "y": y.ravel(), "v": v.ravel()})

    part = lambda i: F.regexp_extract("path", _NAME, i)
    named = files.where(part(1) != "").select(part(1).alias("image"), part(2).cast("int").alias("w"), part(3).cast("int").alias("h"), "content")
    return named.mapInPandas(run, "image string, x long, y long, v double")


def grey_maps(files: DataFrame) -> DataFrame:
    """image, x, y, v in [0, 1] of (path, content): binary portable grey maps (P5), gzipped where the name ends in .gz. Other encodings are read by Spark's image format."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                data = gzip.decompress(content) if path.endswith(".gz") else content
                magic, w, h, most, at = _header(data)
                if magic != b"P5" or most > 255:
                    raise ValueError(f"{path} is no binary grey map of one byte a pixel")
                v = np.frombuffer(data, dtype=np.uint8, count=w * h, offset=at).reshape(h, w) / most
                y, x = np.indices(v.shape)
                name = path.rsplit("/", 1)[-1].split(".")[0]
                yield pd.DataFrame({"image": name, "x": x.ravel(), "y": y.ravel(), "v": v.ravel()})

    return files.select("path", "content").mapInPandas(run, "image string, x long, y long, v double")


def grey_map_files(spark: SparkSession, path: str) -> DataFrame:
    """image, x, y, v of the grey maps in a folder."""
    return grey_maps(spark.read.format("binaryFile").load(path))


def _header(data: bytes) -> tuple[bytes, int, int, int, int]:
    """Magic, width, height, largest value and where the pixels begin; '#' begins a comment."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    return fields[0], int(fields[1]), int(fields[2]), int(fields[3]), at + 1


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, f of the rows of .npy files."""
    return decoded_vectors(spark.read.format("binaryFile").load(path))


def decoded_vectors(files: DataFrame) -> DataFrame:
    """path, idx, f of (path, content), each content a .npy file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                rows = np.load(io.BytesIO(content))
                yield pd.DataFrame({"path": path, "idx": np.arange(len(rows)), "f": list(rows.astype(np.float32))})

    return files.select("path", "content").mapInPandas(run, "path string, idx long, f array<float>")


def encoded_vectors(rows: DataFrame, file_rows: int = 1_000) -> DataFrame:
    """path, content, ids: .npy files of file_rows vectors each and, line by line, the ids of their rows; from idx (0, 1, ...), id, f."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("idx"), io.BytesIO()
        np.save(out, np.stack(pdf["f"].to_list()).astype(np.float32))
        return pd.DataFrame({"path": [f"val-{key[0]}.npy"], "content": [out.getvalue()], "ids": ["\n".join(map(str, pdf["id"]))]})

    dealt = rows.withColumn("part", F.floor(F.col("idx") / file_rows))
    return dealt.groupBy("part").applyInPandas(run, "path string, content binary, ids string")
