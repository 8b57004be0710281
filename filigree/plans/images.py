"""Queries over a table of images: ridge complexes, and filters at many scales."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.ridges import AROUND, RidgeComplex
from . import fixtures as fx
from .registry import query
from .shapes import r

#: Small tiles, so that the images of the queries have seams.
TILE = 48
SIGMAS = filters.scales(0.5, 16.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("image", "x", "y", *(r(F.col(c), digits).alias(c) for c in df.columns if c not in ("image", "x", "y")))


# --- ridge complexes ------------------------------------------------------------------------------


def _up(dx: int, dy: int) -> str:
    """Whether the pixel a step away is larger, by value and then by place."""
    return f"coalesce(n{dx + 1}{dy + 1}.v {'>=' if (dx, dy) > (0, 0) else '>'} p.v, false)"


def _gradient_sql() -> str:
    """grad: each pixel with the number of its pointer (4 at a maximum) and whether each of four edges is a saddle."""
    joins = " ".join(f"LEFT JOIN image_pixel n{a + 1}{b + 1} ON n{a + 1}{b + 1}.image = p.image AND n{a + 1}{b + 1}.x = p.x + ({a}) AND n{a + 1}{b + 1}.y = p.y + ({b})" for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))
    turns = list(zip(range(4), AROUND, AROUND[1:] + AROUND[:1], strict=True))
    near = ", ".join([*(f"{_up(*d)} AS u{k}" for k, d in enumerate(AROUND)), *(f"n{d[0] + 1}{d[1] + 1}.v AS v{k}" for k, d in enumerate(AROUND)), *(f"{_up(*a)} AND {_up(*b)} AND {_up(a[0] + b[0], a[1] + b[1])} AS q{k}" for k, a, b in turns)])
    larger = lambda i, j: f"(v{i} > v{j} OR v{i} = v{j} AND {AROUND[i] > AROUND[j]})"
    touch = lambda i, j: "(" + " AND ".join(f"q{(i + s) % 4}" for s in range((j - i) % 4)) + " OR " + " AND ".join(f"q{(j + s) % 4}" for s in range((i - j) % 4)) + ")"
    others = lambda i: [j for j in range(4) if j != i]
    pointer = "CASE " + " ".join(f"WHEN u{i} AND " + " AND ".join(f"(NOT u{j} OR {larger(i, j)})" for j in others(i)) + f" THEN {i}" for i in range(4)) + " ELSE 4 END"
    saddle = lambda i: f"u{i} AND " + " AND ".join(f"(NOT (u{j} AND {touch(i, j)}) OR {larger(i, j)})" for j in others(i)) + f" AND to_ <> {i} AND " + " AND ".join(f"NOT (to_ = {j} AND {touch(i, j)})" for j in others(i))
    return f"near AS MATERIALIZED (SELECT p.image, p.x, p.y, p.v, {near} FROM image_pixel p {joins}), grad AS MATERIALIZED (SELECT *, {', '.join(f'{saddle(i)} AS s{i}' for i in range(4))} FROM (SELECT *, {pointer} AS to_ FROM near) t)"


_SADDLES = ("saddle AS (" + " UNION ALL ".join(f"SELECT image, x, y, CAST({i} AS INT) AS edge, v FROM grad WHERE s{i}" for i in range(4)) + ")").replace("%", "")
_STEP = lambda k: f"CASE {{}} WHEN 0 THEN {AROUND[0][k]} WHEN 1 THEN {AROUND[1][k]} WHEN 2 THEN {AROUND[2][k]} WHEN 3 THEN {AROUND[3][k]} ELSE 0 END"
_WALK = (
    f"ways AS (SELECT image, x, y, to_, x + {_STEP(0).format('to_')} AS nx, y + {_STEP(1).format('to_')} AS ny FROM grad), "
    f"walk AS (SELECT image, x, y, edge, side, CAST(0 AS BIGINT) AS seq, CASE side WHEN 0 THEN x ELSE x + {_STEP(0).format('edge')} END AS px, CASE side WHEN 0 THEN y ELSE y + {_STEP(1).format('edge')} END AS py FROM saddle, (SELECT unnest([0, 1]) AS side) e "
    "UNION ALL SELECT /*step*/ w.image, w.x, w.y, w.edge, w.side, w.seq + 1, g.nx, g.ny FROM walk w JOIN ways g ON g.image = w.image AND g.x = w.px AND g.y = w.py WHERE g.to_ < 4)"
)


def complex_of(spark: SparkSession, d: str) -> RidgeComplex:
    return RidgeComplex(fx.image_pixel(spark, d), size=TILE)


@query("r07_critical_points", "SELECT image, x, y, 'maximum' AS kind, CAST(NULL AS INT) AS edge, v FROM grad WHERE to_ = 4 UNION ALL SELECT image, x, y, 'saddle', edge, v FROM saddle", "image_pixel", f"{_gradient_sql()}, {_SADDLES}")
def r07_points(spark, d):
    return complex_of(spark, d).critical_points()


@query("r07_ridge_lines", "SELECT image, x, y, edge, side, seq, px, py FROM walk", "image_pixel", f"{_gradient_sql()}, {_SADDLES}, {_WALK}")
def r07_lines(spark, d):
    return complex_of(spark, d).lines()


@query("r07_valley_lines", "SELECT image, x, y, edge, side, seq, px, py FROM walk", "image_pixel", ("negative AS (SELECT image, x, y, -v AS v FROM image_pixel), " + f"{_gradient_sql()}, {_SADDLES}, {_WALK}").replace("image_pixel p ", "negative p ").replace("JOIN image_pixel", "JOIN negative"))
def r07_valleys(spark, d):
    px = fx.image_pixel(spark, d)
    return RidgeComplex(px.withColumn("v", -F.col("v")), size=TILE).lines()


@query("r07_cancelled_maxima")
def r07_maxima(spark, d):
    """Every maximum, the one that it falls to, and at what persistence, with pairs of less than 0.2 cancelled."""
    return complex_of(spark, d).cancelled(0.2)[0]


@query("r07_ridge_graph")
def r07_graph(spark, d):
    """The saddles that stay, with the surviving maxima that their lines lead to."""
    return complex_of(spark, d).cancelled(0.2)[1].where("NOT cancelled").drop("cancelled")


# --- filters --------------------------------------------------------------------------------------

_SIZES = "isz AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM image_pixel GROUP BY image)"
_BORDERS = {
    "nearest": lambda i, n: f"greatest(0, least({i}, {n} - 1))",
    "mirrored": lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END",
    "zero": lambda i, n: i,
}


def _offsets(offsets) -> str:
    return "(SELECT " + ", ".join(f"unnest([{', '.join(repr(o[k]) for o in offsets)}]) AS {n}" for k, n in enumerate("abw")) + ")"


def focal(source: str, offsets: str, border: str) -> str:
    """A weighted sum over windows; ``offsets`` gives a, b and w. Beyond the border 0 is added, or a pixel inside."""
    at = _BORDERS[border]
    wanted = f"SELECT c.image AS image, c.x AS x, c.y AS y, o.w AS w, {at('c.x + o.a', 'isz.w')} AS qx, {at('c.y + o.b', 'isz.h')} AS qy FROM {source} c JOIN isz ON isz.image = c.image CROSS JOIN {offsets} o"
    return f"SELECT o.image AS image, o.x AS x, o.y AS y, sum(o.w * q.v) AS v FROM ({wanted}) o JOIN {source} q ON q.image = o.image AND q.x = o.qx AND q.y = o.qy GROUP BY o.image, o.x, o.y"


def blurred(source: str, name: str, sigma: float, border: str = "nearest") -> list[str]:
    weights = filters.kernel(sigma).tolist()
    reach = len(weights) // 2
    across = _offsets([(k - reach, 0, w) for k, w in enumerate(weights)])
    down = _offsets([(0, k - reach, w) for k, w in enumerate(weights)])
    return [f"{name}_x AS MATERIALIZED ({focal(source, across, border)})", f"{name} AS MATERIALIZED ({focal(f'{name}_x', down, border)})"]


def _difference(source: str, along: str) -> str:
    w = f"OVER (PARTITION BY image, {'y' if along == 'x' else 'x'} ORDER BY {along})"
    return f"SELECT image, x, y, CASE WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END AS v FROM {source}"


_SOBEL = [[(a if k == 0 else b, b if k == 0 else a, (a / 2) * (2 - abs(b)) / 4) for a in (-1, 1) for b in (-1, 0, 1)] for k in (0, 1)]
_EIGEN = lambda xx, xy, yy, sign: f"(({xx} + {yy}) / 2 {sign} sqrt(pow(({xx} - {yy}) / 2, 2) + {xy} * {xy}))"


def _multiscale_sql() -> tuple[str, str]:
    parts, columns, joins = [_SIZES], [], []
    for k, sigma in enumerate(SIGMAS):
        g = f"g{k}"
        parts += blurred("image_pixel", g, sigma)
        parts += [f"{g}_s{a} AS MATERIALIZED ({focal(g, _offsets(_SOBEL[a]), 'mirrored')})" for a in (0, 1)]
        parts += [f"{g}_d{a} AS MATERIALIZED ({_difference(g, a)})" for a in "xy"]
        parts += [f"{g}_d{a}{b} AS MATERIALIZED ({_difference(f'{g}_d{a}', b)})" for a, b in ("xx", "xy", "yy")]
        joins += [f"JOIN {t} USING (image, x, y)" for t in (g, f"{g}_s0", f"{g}_s1", f"{g}_dxx", f"{g}_dxy", f"{g}_dyy")]
        eigen = [_EIGEN(f"{g}_dxx.v", f"{g}_dxy.v", f"{g}_dyy.v", sign) for sign in "+-"]
        for name, value in ((f"intensity_{k}", f"{g}.v"), (f"edges_{k}", f"sqrt(({g}_s0.v * {g}_s0.v + {g}_s1.v * {g}_s1.v) / 2)"), (f"large_{k}", eigen[0]), (f"small_{k}", eigen[1])):
            columns.append(f"round({value}, 6) + 0.0 AS {name}")
    return f"SELECT image, x, y, {', '.join(columns)} FROM image_pixel p {' '.join(joins)}", ", ".join(parts)


@query("r19_multiscale", _multiscale_sql()[0], "image_pixel", _multiscale_sql()[1])
def r19(spark, d):
    """Sigmas 0.5 to 16, with intensity, edges and texture of each."""
    return rounded(filters.multiscale(fx.image_pixel(spark, d), SIGMAS, size=TILE))


_WINDOW = "(SELECT a, b FROM (SELECT unnest(range(-{n}, {n} + 1)) AS a) ra, (SELECT unnest(range(-{n}, {n} + 1)) AS b) rb)"


@query(
    "r22_bilateral",
    "SELECT image, x, y, round(sum(wt * qv) / sum(wt), 6) + 0.0 AS v FROM (SELECT c.image, c.x, c.y, coalesce(q.v, 0) AS qv, exp(-0.5 * (c.far + pow((coalesce(q.v, 0) - c.v) / sd, 2))) AS wt "
    f"FROM (SELECT p.image, p.x, p.y, p.v, s.sd, p.x + o.a AS qx, p.y + o.b AS qy, o.a * o.a + o.b * o.b AS far FROM image_pixel p JOIN (SELECT image, stddev_pop(v) AS sd FROM image_pixel GROUP BY image) s ON s.image = p.image CROSS JOIN {_WINDOW.format(n=3)} o) c LEFT JOIN image_pixel q ON q.image = c.image AND q.x = c.qx AND q.y = c.qy) t GROUP BY image, x, y",
    "image_pixel",
)
def r22_bilateral(spark, d):
    return rounded(filters.bilateral(fx.image_pixel(spark, d), size=TILE))


@query(
    "r22_entropy",
    "SELECT image, x, y, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS v FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY image, x, y) AS DOUBLE) AS t FROM "
    f"(SELECT c.image, c.x, c.y, floor(q.v * 32) AS level, count(*) AS n FROM (SELECT p.image, p.x, p.y, p.x + o.a AS qx, p.y + o.b AS qy FROM image_pixel p CROSS JOIN {_WINDOW.format(n=3)} o WHERE o.a * o.a + o.b * o.b <= 9) c JOIN image_pixel q ON q.image = c.image AND q.x = c.qx AND q.y = c.qy GROUP BY ALL) u) w GROUP BY image, x, y",
    "image_pixel",
)
def r22_entropy(spark, d):
    levels = fx.image_pixel(spark, d).withColumn("v", F.floor(F.col("v") * 32))
    return rounded(filters.entropy(levels, size=TILE))


def _structure_sql() -> tuple[str, str]:
    sobel = [[(a, b, w * 8) for a, b, w in each] for each in _SOBEL]
    parts = [_SIZES, *(f"s{a} AS MATERIALIZED ({focal('image_pixel', _offsets(sobel[a]), 'zero')})" for a in (0, 1))]
    for a, b in ((0, 0), (0, 1), (1, 1)):
        # windows over the border may be empty: a difference of 0 stands there
        both = f"SELECT p.image, p.x, p.y, coalesce(m.v, 0) * coalesce(n.v, 0) AS v FROM image_pixel p LEFT JOIN s{a} m USING (image, x, y) LEFT JOIN s{b} n USING (image, x, y)"
        parts += [f"t{a}{b} AS MATERIALIZED ({both})", *blurred(f"t{a}{b}", f"b{a}{b}", 1.0, "zero")]
    eigen = [_EIGEN("b00.v", "b01.v", "b11.v", sign) for sign in "+-"]
    return f"SELECT image, x, y, round({eigen[0]}, 6) + 0.0 AS large, round({eigen[1]}, 6) + 0.0 AS small FROM b00 JOIN b01 USING (image, x, y) JOIN b11 USING (image, x, y)", ", ".join(parts)


@query("r22_structure_tensor", _structure_sql()[0], "image_pixel", _structure_sql()[1])
def r22_structure(spark, d):
    return rounded(filters.structure(fx.image_pixel(spark, d), size=TILE))


@query(
    "r21_membrane",
    "SELECT image, x, y, round(sum(v), 6) + 0.0 AS membrane_sum, round(avg(v), 6) + 0.0 AS membrane_mean, round(stddev_pop(v), 6) + 0.0 AS membrane_std, round(median(v), 6) + 0.0 AS membrane_median, round(max(v), 6) + 0.0 AS membrane_max, round(min(v), 6) + 0.0 AS membrane_min FROM "
    f"(SELECT c.image, c.x, c.y, c.k, sum(q.v) AS v FROM (SELECT p.image, p.x, p.y, o.k, p.x + o.a AS qx, p.y + o.b AS qy FROM image_pixel p CROSS JOIN (SELECT k, a, b FROM {_WINDOW.format(n=4)} o, (SELECT unnest(range(30)) AS k) t WHERE abs(cos(pi() * k / 30) * b + sin(pi() * k / 30) * a) <= 0.5 + 1e-9) o) c JOIN image_pixel q ON q.image = c.image AND q.x = c.qx AND q.y = c.qy GROUP BY c.image, c.x, c.y, c.k) t GROUP BY image, x, y",
    "image_pixel",
)
def r21(spark, d):
    """Thirty rotations of a line of nine pixels."""
    return rounded(filters.membrane(fx.image_pixel(spark, d), side=9, size=TILE))


_THETAS = tuple(math.pi * k / 4 for k in range(4))
_GABOR_SIGMA = math.sqrt(math.log(2) / 2) / math.pi * 3 / 0.25


def _gabor_sql() -> tuple[str, str]:
    """Each kernel's weights by its formula; as a convolution, a place goes with the weight of its opposite."""
    parts = [_SIZES]
    for k, t in enumerate(_THETAS):
        reach = len(filters.gabor_kernel(0.25, t)) // 2
        u, v = f"(-b * {math.cos(t)!r} - a * {math.sin(t)!r})", f"(b * {math.sin(t)!r} - a * {math.cos(t)!r})"
        weight = f"exp(-0.5 * ({u} * {u} + {v} * {v}) / {_GABOR_SIGMA**2!r}) / {2 * math.pi * _GABOR_SIGMA**2!r} * cos({2 * math.pi * 0.25!r} * {u})"
        parts.append(f"f{k} AS MATERIALIZED ({focal('image_pixel', f'(SELECT a, b, {weight} AS w FROM {_WINDOW.format(n=reach)} z)', 'mirrored')})")
    names = ", ".join(f"round(f{k}.v, 6) + 0.0 AS gabor_{k}" for k in range(4))
    return f"SELECT image, x, y, {names} FROM f0 JOIN f1 USING (image, x, y) JOIN f2 USING (image, x, y) JOIN f3 USING (image, x, y)", ", ".join(parts)


@query("r22_gabor", _gabor_sql()[0], "image_pixel", _gabor_sql()[1])
def r22_gabor(spark, d):
    """Four directions of a wave of four pixels."""
    return rounded(filters.gabor(fx.image_pixel(spark, d), 0.25, _THETAS, size=TILE))
