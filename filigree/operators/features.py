"""Features of polylines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .keeping import spread, spread_many, store


def polylines(points: DataFrame) -> DataFrame:
    """gid, points: the vertices of each polyline in order."""
    rows = points.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("seq", "p0", "p1"))).alias("points"))
    return rows.select("gid", F.transform("points", lambda p: F.struct(p["p0"].cast("double").alias("p0"), p["p1"].cast("double").alias("p1"))).alias("points"))


def moments(points: DataFrame) -> DataFrame:
    """One row: the centroid (coordinates swapped, as points meet rasters) and the inverse covariance of all rounded vertices."""
    a, b = F.rint("p0"), F.rint("p1")
    c = points.agg(F.avg(b).alias("c0"), F.avg(a).alias("c1"), F.var_samp(a).alias("v00"), F.covar_samp(a, b).alias("v01"), F.var_samp(b).alias("v11"))
    det = F.col("v00") * F.col("v11") - F.col("v01") * F.col("v01")
    return c.select("c0", "c1", "v00", "v01", "v11", (F.col("v11") / det).alias("i00"), (-F.col("v01") / det).alias("i01"), (F.col("v00") / det).alias("i11"))


def with_moments(lines: DataFrame, points: DataFrame) -> DataFrame:
    return lines.crossJoin(F.broadcast(moments(points)))  # one row


#: Names of the geometry vector, in order.
GEOMETRY_NAMES = [
    "hyperbolic_e2e", *(f"velocity_{i}" for i in range(6)), "direction_0", "direction_1",
    "cos_centroid_max", "hyperbolic_length", "n_vertices", "manhattan", "mahalanobis", "mahalanobis_first", "mahalanobis_middle", "mahalanobis_last", "theta_x", "vec_0", "vec_1", "vec_length",
    "hyperbolic_end_adj", "hyperbolic_p1_adj", "hyperbolic_p3_adj", "theta", "cos_theta", "euclid_adj1_self1", "euclid_adj1_self0", "euclid_adj0_self1", "mahalanobis_adj1_self0", "mahalanobis_adj1_self1", "mahalanobis_adj0_self1",
]


def geometry_vector(lines: DataFrame, points: DataFrame, neighbour: DataFrame, scale: float, rows: int = 0) -> DataFrame:
    """gid and the 32 measures of ``GEOMETRY_NAMES`` of each polyline and its neighbour.

    neighbour: (gid, nbr), the other end of a polyline's last junction; nbr may be the phantom -1, which
    stands at (1, 1). ``scale`` brings coordinates into the unit disk for hyperbolic distances. rows: how
    many rows tasks are sized by; joins are spread by it if they are many. Neighbours are looked up by their
    names alone, but for the phantom, which stands at many polylines and would be one task's.
    """
    one = g.point(1, 1)
    neighbour = store(neighbour, "near")  # read twice
    other = lines.select(F.col("gid").alias("nbr"), F.col("points").alias("adj"))
    found = spread_many(spread_many(neighbour.where("nbr <> -1"), rows, "nbr").join(other, "nbr").select("gid", "adj"), rows, "gid")
    rows = with_moments(lines, points).join(spread_many(neighbour.select("gid"), rows, "gid"), "gid").join(found, "gid", "left").withColumn("adj", F.coalesce("adj", F.array(one, one, one)))
    # steps in projections of their own, since later ones use them several times
    rows = rows.withColumns({"s": g.sampled(F.col("points")), "t": g.sampled(F.col("adj")), "c": g.point(F.col("c0"), F.col("c1"))})
    rows = rows.withColumns({"vp": g.minus(F.get("s", F.lit(2)), F.get("s", F.lit(0))), "vn": g.minus(F.get("t", F.lit(2)), F.get("t", F.lit(0)))})
    rows = rows.withColumns({"len": F.sqrt(F.pow(F.col("vp")["p0"], 2) + F.pow(F.col("vp")["p1"], 2)), "theta": g.angle(F.col("vp"), F.col("vn"))})
    points_, adj, s, c = F.col("points"), F.col("adj"), F.col("s"), F.col("c")
    small = lambda p: g.point(p["p0"] * scale, p["p1"] * scale)
    hyper = lambda a, b: g.poincare(small(a), small(b))
    maha = lambda a, b: g.mahalanobis(a, b, F.col("i00"), F.col("i01"), F.col("i11"))
    several = lambda a, n=2: F.size(a) >= n
    v0, v1 = (g.gradient(g.coordinate(s, k)) for k in ("p0", "p1"))
    first, last, afirst, alast = g.first(points_), g.last(points_), g.first(adj), g.last(adj)
    values = [
        hyper(first, last), *(F.get(v, F.lit(i)) for i in range(3) for v in (v0, v1)),
        F.col("vp")["p0"] / (F.col("len") + 1e-9), F.col("vp")["p1"] / (F.col("len") + 1e-9),
        F.array_max(F.transform(s, lambda p: g.cosine(p, c))), g.steps(points_, hyper), F.size(points_).cast("double"),
        F.when(F.size(points_) < 2, 0.0).otherwise(g.manhattan(first, last)), F.when(several(points_), maha(first, last)).otherwise(0.0),
        *(maha(F.get(s, F.lit(i)), c) for i in range(3)),
        F.acos(F.col("vp")["p0"] / (F.col("len") + 1e-9)), F.col("vp")["p0"], F.col("vp")["p1"], F.col("len"),
        hyper(first, alast), hyper(last, alast), hyper(first, alast), F.col("theta"), F.cos("theta"),
        g.distance(last, alast), g.distance(first, alast), g.distance(last, afirst),
        F.when(several(adj), maha(first, alast)).otherwise(0.0), F.when(several(adj) & several(points_), maha(last, alast)).otherwise(0.0), F.when(several(adj) & several(points_), maha(last, afirst)).otherwise(0.0),
    ]
    return rows.select("gid", *(v.alias(n) for n, v in zip(GEOMETRY_NAMES, values, strict=True)))


def last_neighbour(edges: DataFrame, order: tuple[str, ...] = ("gid",), rows: int = 0) -> DataFrame:
    """gid, nbr: the other end of each polyline's last junction in an order, by default that of ids; an own loop gives the polyline itself. rows: how many ends there are, if known; many are spread by it."""
    both = F.array(F.struct(F.col("v1").alias("gid"), F.col("v2").alias("nbr")), F.struct(F.col("v2").alias("gid"), F.col("v1").alias("nbr")))
    ends = edges.select(F.struct(*order).alias("at"), F.inline(both))
    return spread_many(ends, rows, "gid").groupBy("gid").agg(F.max(F.struct("at", "nbr")).alias("last")).select("gid", "last.nbr")


# --- pixel features ---------------------------------------------------------------------------------------


def smallest_mode(values: DataFrame, key: str = "gid", value: str = "v", digits: int = 2) -> DataFrame:
    """key, mode: the most frequent value rounded half to even, the smallest of equally frequent ones."""
    scale = 10.0**digits
    counted = values.withColumn("_r", F.rint(F.col(value) * scale) / scale).groupBy(key, "_r").agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.min_by("_r", F.struct(-F.col("_n"), F.col("_r"))).alias("mode"))


def histogram_moments(values: DataFrame, key: str = "gid", value: str = "v", bins: int = 10) -> DataFrame:
    """key, mu, sigma, var of a histogram's bin midpoints: equal bins from the least to the largest value, the last one closed; a single value widens to half on both sides."""
    ranged = values.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    wide = ranged.select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))
    mids = values.join(wide, key).select(key, (F.col("_lo") + (at + 0.5) * width).alias("_m"))
    return mids.groupBy(key).agg(F.avg("_m").alias("mu"), F.stddev_pop("_m").alias("sigma"), F.var_pop("_m").alias("var"))


#: Places up to which what lies there is sent to all points.
SENT_PLACES = 200_000


def looked_up(points: DataFrame, channels: DataFrame) -> DataFrame:
    """gid, channel, v: the channels (channel, x, y, v) at each point (gid, x, y); a point takes all of its place's in one row, and the points of a gid lie together."""
    rows = points.count()
    met = points.select("x", "y").distinct()
    places = store(channels.join(met, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.collect_list(F.struct("channel", "v")).alias("_of")), "places")
    if places.count() <= SENT_PLACES:
        found = spread(points, rows, "gid").join(F.broadcast(places), ["x", "y"])  # counted above
    else:
        found = spread(points.join(places, ["x", "y"]), rows, "gid")
    return found.select("gid", F.inline("_of"))


#: Name to aggregate of a pixel column; add to it to add features.
PIXEL_OPS: dict[str, Callable[[str], Column]] = {
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.median(c),
    "mean": lambda c: F.avg(c),
}


def pixel_features(values: DataFrame, ops: dict[str, Callable[[str], Column]] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """gid, channel and one column for each op; 'channel_op' names in ``skip`` give null, before anything is computed for them."""
    ops = PIXEL_OPS if ops is None else ops
    wanted = lambda name: F.when(~F.concat_ws("_", "channel", F.lit(name)).isin(list(skip)), F.col("v")) if skip else F.col("v")
    columns = values.withColumns({f"_{name}": wanted(name) for name in ops})
    return columns.groupBy("gid", "channel").agg(*(op(f"_{name}").alias(name) for name, op in ops.items()))


def standard_scale(vectors: DataFrame, train: Column, key: str = "gid", vector: str = "f") -> DataFrame:
    """key, pos, v: each dimension minus the mean over train rows, divided by their population deviation (1 if that is 0)."""
    long = vectors.select(key, train.alias("_train"), F.posexplode(vector).alias("pos", "_v"))
    fitted = long.where("_train").groupBy("pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.stddev_pop(F.col("_v").cast("double")).alias("_s"))
    return long.join(F.broadcast(fitted), "pos").select(key, "pos", ((F.col("_v") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).alias("v"))
