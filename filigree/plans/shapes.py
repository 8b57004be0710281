"""Queries of geometry: points, polylines and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import features
from ..operators.keeping import keep
from . import fixtures as fx
from .registry import query


def lines(spark: SparkSession, d: str) -> DataFrame:
    return features.polylines(fx.poly_points(spark, d, 2 * fx.n_points(spark, d)))


def moved(spark: SparkSession, d: str) -> DataFrame:
    """Polylines with the centroid and inverse covariance of all vertices, the centroid as a point, and three sampled points."""
    rows = features.with_moments(lines(spark, d), fx.poly_points(spark, d))
    return rows.withColumns({"c": g.point(F.col("c0"), F.col("c1")), "s": g.sampled(F.col("points"))})


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0  # no negative zero


def pts() -> Column:
    return F.col("points")


@query("f01_end_to_end", "SELECT gid, CASE WHEN n < 2 THEN 0 ELSE round(sqrt((l0 - f0) * (l0 - f0) + (l1 - f1) * (l1 - f1)), 6) END AS dist FROM line", "line")
def f01(spark, d):
    return lines(spark, d).select("gid", r(g.end_to_end(pts())).alias("dist"))


@query("f02_manhattan", "SELECT gid, round(abs(l0 - f0) + abs(l1 - f1), 6) AS dist, round(abs(l0 - c0) + abs(l1 - c1), 5) AS to_centroid FROM line, mom", "line mom")
def f02(spark, d):
    return moved(spark, d).select("gid", r(g.manhattan(g.first(pts()), g.last(pts()))).alias("dist"), r(g.manhattan(g.last(pts()), F.col("c")), 5).alias("to_centroid"))


def maha_sql(a: str, b: str) -> str:
    d0, d1 = f"({b}0 - {a}0)", f"({b}1 - {a}1)"
    return f"sqrt(greatest({d0} * {d0} * i00 + 2 * {d0} * {d1} * i01 + {d1} * {d1} * i11, 0))"


@query("f03_mahalanobis", f"SELECT gid, round({maha_sql('f', 'l')}, 6) AS dist, round({maha_sql('f', 'c')}, 6) AS to_centroid FROM line, mom", "line mom")
def f03(spark, d):
    i = [F.col(k) for k in ("i00", "i01", "i11")]
    return moved(spark, d).select("gid", r(g.mahalanobis(g.first(pts()), g.last(pts()), *i)).alias("dist"), r(g.mahalanobis(g.first(pts()), F.col("c"), *i)).alias("to_centroid"))


@query("f04_slope", "SELECT gid, CASE WHEN l0 = f0 THEN 0 ELSE round((l1 - f1) / (l0 - f0), 10) + 0.0 END AS slope FROM line", "line")
def f04(spark, d):
    return lines(spark, d).select("gid", r(g.slope(pts()), 10).alias("slope"))


@query("f05_centroid", "SELECT gid, round(avg(p1), 8) AS c0, round(avg(p0), 8) AS c1 FROM poly_points GROUP BY gid", "poly_points")
def f05(spark, d):
    return fx.poly_points(spark, d).groupBy("gid").agg(r(F.avg("p1"), 8).alias("c0"), r(F.avg("p0"), 8).alias("c1"))


@query("f06_translate", "SELECT gid, round(f0 - c0, 5) + 0.0 AS a0, round(f1 - c1, 5) + 0.0 AS a1, round(l0 - c0, 5) + 0.0 AS b0, round(l1 - c1, 5) + 0.0 AS b1 FROM line, mom", "line mom")
def f06(spark, d):
    a, b = g.minus(g.first(pts()), F.col("c")), g.minus(g.last(pts()), F.col("c"))
    return moved(spark, d).select("gid", r(a["p0"], 5).alias("a0"), r(a["p1"], 5).alias("a1"), r(b["p0"], 5).alias("b0"), r(b["p1"], 5).alias("b1"))


@query("f07_centroid_distance", "SELECT gid, round(sqrt((c0 - f0) * (c0 - f0) + (c1 - f1) * (c1 - f1)) + sqrt((c0 - m0) * (c0 - m0) + (c1 - m1) * (c1 - m1)) + sqrt((c0 - l0) * (c0 - l0) + (c1 - l1) * (c1 - l1)), 5) AS total FROM line, mom", "line mom")
def f07(spark, d):
    return moved(spark, d).select("gid", r(F.aggregate("s", F.lit(0.0), lambda t, p: t + g.distance(p, F.col("c"))), 5).alias("total"))


def cos_sql(a: str) -> str:
    return f"({a}0 * c0 + {a}1 * c1) / ((sqrt({a}0 * {a}0 + {a}1 * {a}1) + 1e-9) * (sqrt(c0 * c0 + c1 * c1) + 1e-9))"


@query("f08_cosine_centroid", f"SELECT gid, round(greatest({cos_sql('f')}, {cos_sql('m')}, {cos_sql('l')}), 6) AS cos_max FROM line, mom", "line mom")
def f08(spark, d):
    return moved(spark, d).select("gid", r(F.array_max(F.transform("s", lambda p: g.cosine(p, F.col("c"))))).alias("cos_max"))


def hyper_sql(a0: str, a1: str, b0: str, b1: str) -> str:
    """With coordinates brought into the unit disk by 1/200."""
    q = lambda x: f"({x} / 200)"
    sq = lambda x, y: f"(({x}) * ({x}) + ({y}) * ({y}))"
    return f"acosh(1 + 2 * {sq(f'{q(b0)} - {q(a0)}', f'{q(b1)} - {q(a1)}')} / ((1 - {sq(q(a0), q(a1))}) * (1 - {sq(q(b0), q(b1))})))"


def small(p: Column) -> Column:
    return g.point(p["p0"] / 200, p["p1"] / 200)


@query("f09_column_cosine", "SELECT a.gid AS gid, round(sum(a.v * b.v) FILTER (WHERE a.pos % 2 = 1) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 6) + 0.0 AS c FROM fpos a JOIN fpos b ON b.gid = a.gid + 1 AND b.pos = a.pos GROUP BY a.gid", "fpos")
def f09(spark, d):
    """Not the usual cosine: of two n x 2 arrays, the product of the second columns over both arrays' norms."""
    f = fx.feat(spark, d)
    pairs = f.join(f.select((F.col("gid") - 1).alias("gid"), F.col("f").alias("h")), "gid")
    return pairs.select("gid", r(v.column_cosine(F.col("f"), F.col("h"))).alias("c"))


@query("f10_hyperbolic", f"SELECT gid, round({hyper_sql('f0', 'f1', 'l0', 'l1')}, 5) AS dist FROM line", "line")
def f10(spark, d):
    return lines(spark, d).select("gid", r(g.poincare(small(g.first(pts())), small(g.last(pts()))), 5).alias("dist"))


@query("f11_angle_to_next", "SELECT gid, round(acos(greatest(-1.0, least(1.0, (u0 * w0 + u1 * w1) / (sqrt(u0 * u0 + u1 * u1) * sqrt(w0 * w0 + w1 * w1) + 1e-9)))), 5) AS theta FROM (SELECT gid, m0 - f0 AS u0, m1 - f1 AS u1, l0 - m0 AS w0, l1 - m1 AS w1 FROM line WHERE n >= 3) t", "line")
def f11(spark, d):
    at = lambda i: F.get("s", F.lit(i))
    return moved(spark, d).where(F.size("points") >= 3).select("gid", r(g.angle(g.minus(at(1), at(0)), g.minus(at(2), at(1))), 5).alias("theta"))


@query("f12_direction", "SELECT gid, round(acos((l0 - f0) / (len + 1e-9)), 5) AS theta_x, round(len, 6) AS len, round((l0 - f0) / (len + 1e-9), 6) + 0.0 AS s0, round((l1 - f1) / (len + 1e-9), 6) + 0.0 AS s1 FROM (SELECT *, sqrt((l0 - f0) * (l0 - f0) + (l1 - f1) * (l1 - f1)) AS len FROM line) t", "line")
def f12(spark, d):
    rows = lines(spark, d).select("gid", g.minus(g.last(pts()), g.first(pts())).alias("u"), g.distance(g.first(pts()), g.last(pts())).alias("len"))
    u = F.col("u")
    return rows.select("gid", r(F.acos(u["p0"] / (F.col("len") + 1e-9)), 5).alias("theta_x"), r(F.col("len")).alias("len"), r(u["p0"] / (F.col("len") + 1e-9)).alias("s0"), r(u["p1"] / (F.col("len") + 1e-9)).alias("s1"))


@query("f13_whitney", "SELECT gid, round(1 / (1 + f0 * f0), 7) AS a, round(f0 - 2 * f0 / (1 + f0 * f0), 6) AS b, round(1 / ((1 + f0 * f0) * (1 + f1 * f1)), 8) AS c, round(f0 * f1 / ((1 + f0 * f0) * (1 + f1 * f1)), 8) AS e FROM line", "line")
def f13(spark, d):
    t0, t1 = g.first(pts())["p0"], g.first(pts())["p1"]
    return lines(spark, d).select("gid", r(1 / (1 + t0 * t0), 7).alias("a"), r(t0 - 2 * t0 / (1 + t0 * t0)).alias("b"), r(1 / ((1 + t0 * t0) * (1 + t1 * t1)), 8).alias("c"), r(t0 * t1 / ((1 + t0 * t0) * (1 + t1 * t1)), 8).alias("e"))


@query("f14_sphere", "SELECT gid, round(sin(f0) * cos(f1), 6) + 0.0 AS x, round(sin(f0) * sin(f1), 6) + 0.0 AS y, round(cos(f0), 6) + 0.0 AS z, round(atan2(sin(f0) * cos(f1), sin(f0) * sin(f1)), 5) + 0.0 AS a, round(-acos(cos(f0)), 5) + 0.0 AS b FROM line", "line")
def f14(spark, d):
    t0, t1 = g.first(pts())["p0"], g.first(pts())["p1"]
    x, y, z = F.sin(t0) * F.cos(t1), F.sin(t0) * F.sin(t1), F.cos(t0)
    return lines(spark, d).select("gid", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"), r(F.atan2(x, y), 5).alias("a"), r(-F.acos(z), 5).alias("b"))


@query("f15_triangle_area", "SELECT gid, round(0.5 * sqrt(sum(p0 * p0 + p1 * p1)) * sin(radians(30)), 5) AS area FROM poly_points GROUP BY gid", "poly_points")
def f15(spark, d):
    size = F.sqrt(F.aggregate("points", F.lit(0.0), lambda t, p: t + p["p0"] * p["p0"] + p["p1"] * p["p1"]))
    return lines(spark, d).select("gid", r(0.5 * size * F.sin(F.radians(F.lit(30))), 5).alias("area"))


@query("f22_half_even", "SELECT gid, seq, CAST(round_even(p0, 0) AS BIGINT) AS r0, CAST(round_even(p1, 0) AS BIGINT) AS r1 FROM poly_points", "poly_points")
def f22(spark, d):
    return fx.poly_points(spark, d).select("gid", F.col("seq").cast("long").alias("seq"), F.rint("p0").cast("long").alias("r0"), F.rint("p1").cast("long").alias("r1"))


@query("w01_path_length", "SELECT gid, round(coalesce(sum(sqrt((n0 - p0) * (n0 - p0) + (n1 - p1) * (n1 - p1))), 0), 5) AS len FROM (SELECT *, lead(p0) OVER w AS n0, lead(p1) OVER w AS n1 FROM poly_points WINDOW w AS (PARTITION BY gid ORDER BY seq)) t GROUP BY gid", "poly_points")
def w01(spark, d):
    return lines(spark, d).select("gid", r(g.path_length(pts()), 5).alias("len"))


@query("w02_hyperbolic_length", f"SELECT gid, round(coalesce(sum({hyper_sql('p0', 'p1', 'n0', 'n1')}), 0), 4) AS len FROM (SELECT *, lead(p0) OVER w AS n0, lead(p1) OVER w AS n1 FROM poly_points WINDOW w AS (PARTITION BY gid ORDER BY seq)) t GROUP BY gid", "poly_points")
def w02(spark, d):
    return lines(spark, d).select("gid", r(g.steps(pts(), lambda a, b: g.poincare(small(a), small(b))), 4).alias("len"))


@query("w03_velocity", "SELECT gid, round(m0 - f0, 7) + 0.0 AS a0, round((l0 - f0) / 2, 7) + 0.0 AS b0, round(l0 - m0, 7) + 0.0 AS c0, round(m1 - f1, 7) + 0.0 AS a1, round((l1 - f1) / 2, 7) + 0.0 AS b1, round(l1 - m1, 7) + 0.0 AS c1 FROM line", "line")
def w03(spark, d):
    rows = lines(spark, d).select("gid", g.sampled(pts()).alias("s"))
    rows = rows.select("gid", *(g.gradient(g.coordinate(F.col("s"), f"p{k}")).alias(f"g{k}") for k in (0, 1)))
    return rows.select("gid", *(r(F.get(f"g{k}", F.lit(i)), 7).alias(f"{n}{k}") for k in (0, 1) for i, n in enumerate("abc")))


@query("w04_sampled_points", "SELECT gid, round(f0, 7) AS f0, round(f1, 7) AS f1, round(m0, 7) AS m0, round(m1, 7) AS m1, round(l0, 7) AS l0, round(l1, 7) AS l1 FROM line", "line")
def w04(spark, d):
    return lines(spark, d).select("gid", g.sampled(pts()).alias("s")).select("gid", *(r(F.get("s", F.lit(i))[f"p{k}"], 7).alias(f"{n}{k}") for i, n in enumerate("fml") for k in (0, 1)))


@query("w05_first_last", "SELECT gid, f0, f1, l0, l1 FROM line", "line")
def w05(spark, d):
    at = lambda f, c: f(c, "seq")
    return fx.poly_points(spark, d).groupBy("gid").agg(*(at(f, f"p{k}").alias(f"{n}{k}") for n, f in (("f", F.min_by), ("l", F.max_by)) for k in (0, 1)))


@query("g21_covariance", "SELECT round(c0, 5) AS c0, round(c1, 5) AS c1, round(v00, 5) AS v00, round(v01, 5) AS v01, round(v11, 5) AS v11, round(i00, 8) AS i00, round(i01, 8) AS i01, round(i11, 8) AS i11 FROM mom", "mom")
def g21(spark, d):
    return features.moments(fx.poly_points(spark, d)).select(*(r(F.col(c), 5).alias(c) for c in ("c0", "c1", "v00", "v01", "v11")), *(r(F.col(c), 8).alias(c) for c in ("i00", "i01", "i11")))


_LAST = "ends AS (SELECT gid AS e, v1 AS own, v2 AS nbr FROM gedge UNION ALL SELECT gid, v2, v1 FROM gedge), nb AS (SELECT own AS gid, arg_max(nbr, e) AS nbr FROM ends GROUP BY own), other AS (SELECT gid, n, f0, f1, m0, m1, l0, l1 FROM line UNION ALL SELECT -1, 3, 1, 1, 1, 1, 1, 1), pair AS (SELECT l.*, o.n AS an, o.f0 AS af0, o.f1 AS af1, o.m0 AS am0, o.m1 AS am1, o.l0 AS al0, o.l1 AS al1, l.l0 - l.f0 AS u0, l.l1 - l.f1 AS u1, o.l0 - o.f0 AS w0, o.l1 - o.f1 AS w1, sqrt((l.l0 - l.f0) * (l.l0 - l.f0) + (l.l1 - l.f1) * (l.l1 - l.f1)) AS len FROM line l JOIN nb ON nb.gid = l.gid JOIN other o ON o.gid = nb.nbr), hyp AS (SELECT gid, coalesce(sum({h}), 0) AS hlen FROM (SELECT *, lead(p0) OVER w AS n0, lead(p1) OVER w AS n1 FROM poly_points WINDOW w AS (PARTITION BY gid ORDER BY seq)) t GROUP BY gid), th AS (SELECT gid, acos(greatest(-1.0, least(1.0, (u0 * w0 + u1 * w1) / (len * sqrt(w0 * w0 + w1 * w1) + 1e-9)))) AS theta FROM pair)".format(h=hyper_sql("p0", "p1", "n0", "n1"))


def digits_of(name: str) -> int:
    """Sums and halves of coordinates have seven decimals at most; the rest is rounded more."""
    return 7 if name.startswith(("velocity", "vec_", "direction", "euclid", "manhattan", "n_")) else 4


def _vector_sql() -> str:
    euclid = lambda a, b: f"sqrt(({b}0 - {a}0) * ({b}0 - {a}0) + ({b}1 - {a}1) * ({b}1 - {a}1))"
    h = lambda a, b: hyper_sql(a + "0", a + "1", b + "0", b + "1")
    values = [
        h("f", "l"), "m0 - f0", "m1 - f1", "(l0 - f0) / 2", "(l1 - f1) / 2", "l0 - m0", "l1 - m1", "u0 / (len + 1e-9)", "u1 / (len + 1e-9)",
        f"greatest({cos_sql('f')}, {cos_sql('m')}, {cos_sql('l')})", "hlen", "n", "CASE WHEN n < 2 THEN 0 ELSE abs(u0) + abs(u1) END", f"CASE WHEN n >= 2 THEN {maha_sql('f', 'l')} ELSE 0 END",
        maha_sql("f", "c"), maha_sql("m", "c"), maha_sql("l", "c"), "acos(u0 / (len + 1e-9))", "u0", "u1", "len",
        h("f", "al"), h("l", "al"), h("f", "al"), "theta", "cos(theta)", euclid("l", "al"), euclid("f", "al"), euclid("l", "af"),
        f"CASE WHEN an >= 2 THEN {maha_sql('f', 'al')} ELSE 0 END", f"CASE WHEN an >= 2 AND n >= 2 THEN {maha_sql('l', 'al')} ELSE 0 END", f"CASE WHEN an >= 2 AND n >= 2 THEN {maha_sql('l', 'af')} ELSE 0 END",
    ]
    return "SELECT pair.gid AS gid, " + ", ".join(f"round({x}, {digits_of(n)}) + 0.0 AS {n}" for x, n in zip(values, features.GEOMETRY_NAMES, strict=True)) + " FROM pair JOIN hyp ON hyp.gid = pair.gid JOIN th ON th.gid = pair.gid, mom"


@query("f30_geom_vector", _vector_sql(), "line mom gedge", _LAST)
def f30(spark, d):
    points, ends = fx.poly_points(spark, d), 2 * fx.n_points(spark, d)
    # junctions are numbered by pk, then v1, so the last one is known without a number
    near = features.last_neighbour(fx.junctions(spark, d), ("pk", "v1"), ends)
    rows = features.geometry_vector(keep(lines(spark, d)), points, near, 1 / 200, ends)
    return rows.select("gid", *(r(F.col(n), digits_of(n)).alias(n) for n in features.GEOMETRY_NAMES))


# --- vectors ------------------------------------------------------------------------------------------------


@query("f16_euclidean", "SELECT a.gid AS gid, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS dist FROM fpos a JOIN fpos b ON b.gid = a.gid + 1 AND b.pos = a.pos GROUP BY a.gid", "fpos")
def f16(spark, d):
    f = fx.feat(spark, d)
    return f.join(f.select((F.col("gid") - 1).alias("gid"), F.col("f").alias("h")), "gid").select("gid", r(v.euclidean(F.col("f"), F.col("h"))).alias("dist"))


@query("f17_affinity", "SELECT a.gid AS gid, round(sum(a.v * b.v), 6) + 0.0 AS aff FROM fpos a JOIN fpos b ON b.gid = a.gid + 1 AND b.pos = a.pos GROUP BY a.gid", "fpos")
def f17(spark, d):
    f = fx.feat(spark, d)
    return f.join(f.select((F.col("gid") - 1).alias("gid"), F.col("f").alias("h")), "gid").select("gid", r(v.dot(F.col("f"), F.col("h"))).alias("aff"))


@query("f18_losses", "SELECT round(sum(greatest(p, 0) - p * y + ln(1 + exp(-abs(p)))), 5) AS xent, round(sum(ln(1 + exp(-p))), 5) AS skipgram, round(sum(greatest(0, (1 - p) - p + 0.1)), 5) AS hinge FROM pred", "pred")
def f18(spark, d):
    p, y = F.col("p"), F.col("y")
    return fx.pred(spark, d).agg(r(F.sum(v.cross_entropy(p, y)), 5).alias("xent"), r(F.sum(F.log1p(F.exp(-p))), 5).alias("skipgram"), r(F.sum(v.hinge(p, 1 - p)), 5).alias("hinge"))


_ACTIVATIONS = "SELECT gid, pos, round(exp(v - top) / total, 8) AS softmax, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0), 6) AS relu, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) + 0.0 AS elu, round(v / nrm, 6) + 0.0 AS unit FROM (SELECT *, sum(exp(v - top)) OVER (PARTITION BY gid) AS total, sqrt(sum(v * v) OVER (PARTITION BY gid)) AS nrm FROM (SELECT *, max(v) OVER (PARTITION BY gid) AS top FROM fpos) a) b"


@query("f19_activations", _ACTIVATIONS, "fpos")
def f19(spark, d):
    feat = fx.feat(spark, d)
    rows = feat.select("gid", F.transform("f", lambda x: x.cast("double")).alias("f"))
    rows = rows.select("gid", F.posexplode(F.arrays_zip(F.col("f").alias("v"), v.softmax(F.col("f")).alias("s"), v.unit(F.col("f")).alias("u"))).alias("pos", "z"))
    x = F.col("z")["v"]
    return rows.select("gid", F.col("pos").cast("long").alias("pos"), r(F.col("z")["s"], 8).alias("softmax"), r(v.sigmoid(x)).alias("sigmoid"), r(v.relu(x)).alias("relu"), r(v.elu(x)).alias("elu"), r(F.col("z")["u"]).alias("unit"))


@query("f20_kl_divergence", "SELECT a.gid AS gid, round(sum(pa * ln(pa / pb)), 5) + 0.0 AS kl FROM (SELECT gid, pos, greatest(abs(v), 1e-9) / sum(greatest(abs(v), 1e-9)) OVER (PARTITION BY gid) AS pa FROM fpos) a JOIN (SELECT gid, pos, greatest(abs(v), 1e-9) / sum(greatest(abs(v), 1e-9)) OVER (PARTITION BY gid) AS pb FROM fpos) b ON b.gid = a.gid + 1 AND b.pos = a.pos GROUP BY a.gid", "fpos")
def f20(spark, d):
    f = fx.feat(spark, d).select("gid", F.transform("f", lambda x: F.abs(x.cast("double"))).alias("f"))
    return f.join(f.select((F.col("gid") - 1).alias("gid"), F.col("f").alias("h")), "gid").select("gid", r(v.kl_divergence(F.col("f"), F.col("h")), 5).alias("kl"))


@query("f21_standard_scale", "SELECT gid, f.pos AS pos, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) + 0.0 AS v FROM fpos f JOIN (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM fpos WHERE label < 7 GROUP BY pos) t ON t.pos = f.pos", "fpos")
def f21(spark, d):
    return features.standard_scale(fx.feat(spark, d), F.col("label") < 7).select("gid", F.col("pos").cast("long").alias("pos"), r(F.col("v"), 5).alias("v"))


@query("f23_logs", "SELECT gid, round(ln(1 + abs(p0)), 6) AS a, round(ln(p1 - least(lo, -1)), 6) AS b FROM (SELECT gid, avg(p0) AS p0, avg(p1) AS p1 FROM poly_points GROUP BY gid) t, (SELECT min(p1) AS lo FROM poly_points) m", "poly_points")
def f23(spark, d):
    pts = fx.poly_points(spark, d)
    rows = pts.groupBy("gid").agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1")).crossJoin(F.broadcast(pts.agg(F.min("p1").alias("lo"))))
    return rows.select("gid", r(F.log1p(F.abs("p0"))).alias("a"), r(F.log(F.col("p1") - F.least("lo", F.lit(-1.0)))).alias("b"))


@query("f40_strings", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, replace(p_brand, '#', '_') AS brand, upper(p_type) AS kind, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS number, contains(p_type, 'E') AS has_e FROM part")
def f40(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("head"), F.regexp_replace("p_brand", "#", "_").alias("brand"), F.upper("p_type").alias("kind"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("number"), F.contains("p_type", F.lit("E")).alias("has_e"))


@query("f41_arrays", "SELECT gid, len(embedding[1:63]) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[33] AS DOUBLE) AS middle, CAST(embedding[64] AS DOUBLE) AS last FROM (SELECT vec_id AS gid, embedding FROM embeddings) t")
def f41(spark, d):
    f = F.col("f")
    return fx.feat(spark, d).select("gid", F.size(F.slice(f, 1, F.size(f) - 1)).cast("long").alias("n"), *(F.element_at(f, i).cast("double").alias(n) for i, n in ((1, "first"), (33, "middle"), (-1, "last"))))


@query("f42_maps", "SELECT label, max(vec_id) AS top FROM embeddings GROUP BY label")
def f42(spark, d):
    """A map of label to id, inverted and read back by key."""
    per = fx.feat(spark, d).groupBy("label").agg(F.max("gid").alias("top"))
    maps = per.select(F.map_from_entries(F.array(F.struct("label", "top"))).alias("m"), "label")
    return maps.select("label", F.col("m")[F.col("label")].alias("top"))


@query("f43_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f43(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("j11_merged_features", "SELECT f.gid AS gid, len(f.f) + 2 AS n, round(l.f0, 6) AS last_but_one FROM feat f JOIN line l ON l.gid = f.gid", "feat line")
def j11(spark, d):
    geometry = lines(spark, d).select("gid", F.array(g.first(pts())["p0"], g.first(pts())["p1"]).alias("geom"))
    rows = fx.feat(spark, d).join(geometry, "gid").select("gid", F.concat(F.transform("f", lambda x: x.cast("double")), "geom").alias("m"))
    return rows.select("gid", F.size("m").cast("long").alias("n"), r(F.element_at("m", -2)).alias("last_but_one"))
