"""Centroid clustering of integer vectors, with centroids screened out by block norms.

A vector is cut into segments. Kept beside it, once for all rounds, are each segment's sum and the norm
of what remains of the segment without its mean: a vector of 64 numbers is compressed to 16. By
Cauchy-Schwarz on the remainders, the inner product of the compressed vectors is at least that of the
vectors, so it gives a lower bound of their distance. The centroid of the least bound is measured
exactly; of the others only those whose bound does not exceed that distance. All distances are exact
integers and ties go to the smaller number, so the result is that of measuring every centroid.

Assignment is map-only: the centroids, a bounded number of vectors, go to every task, and a round brings
back one sum for each centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components are multiplied by this before they are rounded down.
SCALE = 64
#: Integers must stay below this, so that squared distances of 64 components fit 63 bits.
LIMIT = 1 << 27
#: Vectors of which all bounds are held at a time, and pairs that are measured at a time.
ROWS, PAIRS = 65_536, 262_144


@dataclass(frozen=True)
class Settings:
    """components of a vector; how many centroids; rounds before the last assignment; segments of a vector; number in front of an id when the first centroids are drawn."""

    components: int = 64
    centroids: int = 16
    rounds: int = 3
    segments: int = 8
    draw: int = 1


def compressed(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row, the segments' sums over the root of their length, then the norms of their remainders. Its norm is that of the row."""
    parts = np.array_split(x.astype(np.float64), segments, axis=1)
    sums = np.stack([p.sum(axis=1) / np.sqrt(p.shape[1]) for p in parts], axis=1)
    rest = np.stack([np.sqrt(np.maximum(0.0, (p * p).sum(axis=1) - s * s)) for p, s in zip(parts, sums.T, strict=True)], axis=1)
    return np.hstack([sums, rest])


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: its nearest centroid, the squared distance, and how many centroids were measured."""
    own, c = (short * short).sum(axis=1), compressed(centroids, segments)
    other = (c * c).sum(axis=1)
    bounds = own[:, None] + other[None, :] - 2.0 * (short @ c.T)
    slack = 1.0 + 1e-9 * (own[:, None] + other[None, :])  # far above the rounding of the bounds
    best = bounds.argmin(axis=1)
    far = ((x - centroids[best]) ** 2).sum(axis=1)
    open_ = bounds - slack <= far[:, None]
    open_[np.arange(len(x)), best] = False
    measured = 1 + open_.sum(axis=1)
    rows, which = np.nonzero(open_)  # by row, then by centroid
    for at in range(0, len(rows), PAIRS):
        r, k = rows[at : at + PAIRS], which[at : at + PAIRS]
        d = ((x[r] - centroids[k]) ** 2).sum(axis=1)
        # the last written is the least distance of a row, at the smaller number if it ties
        order = np.lexsort((-k, -d, r))
        r, k, d = r[order], k[order], d[order]
        last = np.append(r[1:] != r[:-1], True)
        r, k, d = r[last], k[last], d[last]
        better = (d < far[r]) | ((d == far[r]) & (k < best[r]))
        best[r[better]], far[r[better]] = k[better], d[better]
    return best, far, measured


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, settings: Settings = Settings()) -> DataFrame:
    """vec_id, v (integers), short (compressed): of the rows whose vector has the right number of components, none null or not finite."""
    m, segments = settings.components, settings.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), m), False)
            ids, lists = batch.column(0).filter(right), batch.column(1).filter(right)
            flat = lists.flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, m)  # nulls become nan
            good = np.isfinite(x).all(axis=1)
            scaled = np.floor(x[good] * SCALE)
            if (np.abs(scaled) >= LIMIT).any():
                raise ValueError(f"components of {LIMIT // SCALE} or more: squared distances would not fit a long")
            v = scaled.astype(np.int64)
            offsets = lambda n: pa.array(np.arange(len(v) + 1, dtype=np.int32) * n)
            columns = [ids.filter(pa.array(good)), pa.ListArray.from_arrays(offsets(m), pa.array(v.ravel())), pa.ListArray.from_arrays(offsets(2 * segments), pa.array(compressed(v, segments).ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "short"])

    slim = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    return slim.mapInArrow(run, f"vec_id {slim.schema['vec_id'].dataType.simpleString()}, v array<long>, short array<double>")


def _pieces(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(1).flatten().to_numpy().reshape(-1, settings.components), part.column(2).flatten().to_numpy().reshape(-1, 2 * settings.segments)


def moved(vectors: DataFrame, centroids: np.ndarray, settings: Settings) -> np.ndarray:
    """The centroids after a round: exact rounded down means of their vectors; those without any stay."""
    k, m = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, m), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x, short in _pieces(batches, settings):
            cluster = nearest(x, short, centroids, settings.segments)[0]
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        own = np.hstack([counts[:, None], sums])
        at = np.flatnonzero(np.repeat(counts > 0, m + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.ravel()[at])], ["place", "total"])

    total = F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    found = vectors.mapInArrow(run, "place long, total long").groupBy("place").agg(total).collect()  # a number for each centroid and component
    table = {r["place"]: int(r["total"]) for r in found}
    out = centroids.copy()
    for c in range(k):
        if n := table.get(c * (m + 1), 0):
            out[c] = [table[c * (m + 1) + 1 + j] // n for j in range(m)]
    return out


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors whose ids have the least hashes, in that order."""
    drawn = F.sha2(F.concat(F.lit(f"{settings.draw}:"), F.col("vec_id").cast("string")), 256).alias("drawn")
    rows = vectors.where("vec_id IS NOT NULL").select(drawn, "v").orderBy("drawn", "v").limit(settings.centroids).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, settings.components)


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, n_measured, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Vectors that are null, of another length, or with a component that is null or not finite are left
    out. Components are 64-fold, rounded down. distance is squared; cluster_inertia and inertia are its
    sums over the cluster and over all; n_measured is the number of centroids that no bound ruled out.
    A null id takes part but never draws a first centroid; rows that repeat an id take part each, in the
    draw by their vector's order. Fewer vectors than centroids make fewer centroids; with none, or none
    with an id, the result is empty. Other columns are not read.
    """
    spark = df.sparkSession
    vectors = cut(integer_vectors(df, id_col, vector_col, settings))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, settings)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, n_measured int, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(settings.rounds):
        centroids = moved(vectors, centroids, settings)
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, short in _pieces(batches, settings):
            best, far, measured = nearest(x, short, last, settings.segments)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(far), pa.array(measured.astype(np.int32))], ["vec_id", "cluster", "distance", "n_measured"])

    placed = cut(vectors.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long, n_measured int"))
    each = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = each.agg(F.sum("own").alias("all"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(last.tolist())]
    named = each.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(every))  # one row
    totals = named.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "n_measured", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
