"""Geometry of polylines as Column expressions, so that Catalyst keeps them in generated code.

A point is a struct of doubles (p0, p1); a polyline is an array of points in order. Row is p1 and
column is p0 wherever a point meets a raster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(p0: Column | float, p1: Column | float) -> Column:
    as_double = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(as_double(p0).alias("p0"), as_double(p1).alias("p1"))


def first(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["p0"] - a["p0"], 2) + F.pow(b["p1"] - a["p1"], 2))


def end_to_end(points: Column) -> Column:
    """The distance of the ends; 0 for fewer than two points."""
    return F.when(F.size(points) < 2, 0.0).otherwise(distance(first(points), last(points)))


def manhattan(a: Column, b: Column) -> Column:
    return F.abs(b["p0"] - a["p0"]) + F.abs(b["p1"] - a["p1"])


def slope(points: Column) -> Column:
    """Rise of p1 over p0 between the ends; 0 where p0 does not change."""
    run, rise = last(points)["p0"] - first(points)["p0"], last(points)["p1"] - first(points)["p1"]
    return F.when(run == 0, 0.0).otherwise(rise / run)


def steps(points: Column, of) -> Column:
    """The sum of of(a, b) over consecutive points."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), of)
    return F.aggregate(pairs, F.lit(0.0), lambda total, d: total + d)


def path_length(points: Column) -> Column:
    return steps(points, distance)


def sampled(points: Column) -> Column:
    """Three points: the ends and the one at n div 2. Two points have the midpoint with swapped coordinates between them, one point stands three times."""
    a, b, n = first(points), last(points), F.size(points)
    middle = F.when(n >= 3, F.get(points, F.floor(n / 2).cast("int"))).when(n == 2, point((a["p1"] + b["p1"]) / 2, (a["p0"] + b["p0"]) / 2)).otherwise(a)
    return F.array(a, middle, b)


def poincare(a: Column, b: Column) -> Column:
    """The geodesic distance of two points of the open unit disk."""
    norm = lambda p: F.pow(p["p0"], 2) + F.pow(p["p1"], 2)
    return F.acosh(1 + 2 * F.pow(distance(a, b), 2) / ((1 - norm(a)) * (1 - norm(b))))


def mahalanobis(a: Column, b: Column, i00: Column, i01: Column, i11: Column) -> Column:
    """The distance of a and b under an inverse covariance given by its three entries."""
    d0, d1 = b["p0"] - a["p0"], b["p1"] - a["p1"]
    return F.sqrt(F.greatest(d0 * d0 * i00 + 2 * d0 * d1 * i01 + d1 * d1 * i11, F.lit(0.0)))


def coordinate(points: Column, name: str) -> Column:
    """One coordinate of each point."""
    return F.transform(points, lambda p: p[name])


def gradient(values: Column) -> Column:
    """Differences of three values: one-sided at the ends, central in the middle."""
    a, b, c = (F.get(values, F.lit(i)) for i in range(3))
    return F.array(b - a, (c - a) / 2, c - b)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two points as vectors, each norm guarded by 1e-9."""
    norm = lambda p: F.sqrt(F.pow(p["p0"], 2) + F.pow(p["p1"], 2)) + 1e-9
    return (a["p0"] * b["p0"] + a["p1"] * b["p1"]) / (norm(a) * norm(b))


def minus(a: Column, b: Column) -> Column:
    return point(a["p0"] - b["p0"], a["p1"] - b["p1"])


def angle(u: Column, v: Column) -> Column:
    """The angle between two vectors; the product of the norms is guarded, the cosine kept within [-1, 1]."""
    norm = lambda p: F.sqrt(F.pow(p["p0"], 2) + F.pow(p["p1"], 2))
    c = (u["p0"] * v["p0"] + u["p1"] * v["p1"]) / (norm(u) * norm(v) + 1e-9)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
