import math
from collections import Counter

import numpy as np
import pytest

from filigree.operators import filters
from filigree.operators.ridges import AROUND, RidgeComplex

SCHEMA = "image string, x long, y long, v double"


def image(seed, n, m, levels=None):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, m))
    return np.floor(v * levels) / levels if levels else v


def table(spark, images):
    rows = [(name, x, y, float(v[x, y])) for name, v in images.items() for x in range(v.shape[0]) for y in range(v.shape[1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


#: Ties everywhere, a flat image, one pixel, one row, and sizes that no tile divides.
IMAGES = {"a": image(1, 23, 17), "ties": image(2, 21, 19, 1), "flat": np.zeros((6, 5)), "one": np.ones((1, 1)), "row": image(3, 1, 30), "wide": image(4, 9, 40, 2)}


# --- ridge complexes by brute force -----------------------------------------------------------------


def brute(v):
    """Pointers and saddles, pixel by pixel: groups of larger neighbours by flooding over squares."""
    n, m = v.shape
    inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < m and not math.isnan(v[p])
    key = lambda p: (v[p], p)
    pointer, saddles = {}, []
    for p in [(x, y) for x in range(n) for y in range(m) if inside((x, y))]:
        step = lambda d, p=p: (p[0] + d[0], p[1] + d[1])
        up = {k: step(d) for k, d in enumerate(AROUND) if inside(step(d)) and key(step(d)) > key(p)}
        group = {k: k for k in up}
        for k in range(4):
            j, corner = (k + 1) % 4, step((AROUND[k][0] + AROUND[(k + 1) % 4][0], AROUND[k][1] + AROUND[(k + 1) % 4][1]))
            if k in up and j in up and inside(corner) and key(corner) > key(p):
                old, new = group[j], group[k]
                group = {a: new if g == old else g for a, g in group.items()}
        if not up:
            continue
        best = max(up, key=lambda k: key(up[k]))
        pointer[p] = up[best]
        for g in set(group.values()) - {group[best]}:
            k = max((k for k in up if group[k] == g), key=lambda k: key(up[k]))
            saddles.append((p, k, up[k]))
    return pointer, saddles


def path(pointer, p):
    out = [p]
    while out[-1] in pointer:
        out.append(pointer[out[-1]])
    return out


def brute_cancelled(v, pointer, saddles, persistence):
    """The elder rule over all saddles, highest first."""
    n, m = v.shape
    top = {(x, y): (x, y) for x in range(n) for y in range(m) if not math.isnan(v[x, y]) and (x, y) not in pointer}
    fell, gone = {}, set()

    def full(p):
        return p if top[p] == p else full(top[p])

    def cancelled(p):
        return cancelled(fell[p][0]) if p in fell else p

    for p, k, q in sorted(saddles, key=lambda s: (v[s[0]], s[0], s[1]), reverse=True):
        ends = [path(pointer, e)[-1] for e in (p, q)]
        if full(ends[0]) == full(ends[1]):
            continue
        side = 0 if (v[full(ends[0])], full(ends[0])) < (v[full(ends[1])], full(ends[1])) else 1
        low, high = full(ends[side]), full(ends[1 - side])
        top[low] = high
        if v[low] - v[p] < persistence:
            fell[low] = (ends[1 - side], v[low] - v[p])  # what the saddle's other line leads to
            gone.add((p, k))
    return {t: (cancelled(t), fell[t][1] if t in fell else None) for t in top}, gone


def as_place(at):
    return divmod(at, 1 << 31)


@pytest.mark.parametrize("size", [256, 7, 3])
def test_ridge_complex_equals_brute_force_whatever_the_tiles(spark, size):
    images = IMAGES | {"holes": np.where(image(5, 15, 12) > 1.2, np.nan, image(6, 15, 12))}
    pixels = table(spark, images)
    found = RidgeComplex(pixels.selectExpr("*", "'x' AS at", "0 AS edge"), size=size)
    points, lines, expected_points, expected_lines = Counter(), Counter(), Counter(), Counter()
    for r in found.critical_points().collect():
        points[r["image"], r["x"], r["y"], r["edge"]] += 1
    for r in found.lines().collect():
        lines[r["image"], r["x"], r["y"], r["edge"], r["side"], r["seq"], r["px"], r["py"]] += 1
    for name, v in images.items():
        pointer, saddles = brute(v)
        for x in range(v.shape[0]):
            for y in range(v.shape[1]):
                if (x, y) not in pointer and not math.isnan(v[x, y]):
                    expected_points[name, x, y, None] += 1
        for p, k, q in saddles:
            expected_points[name, *p, k] += 1
            for side, end in enumerate((p, q)):
                expected_lines.update((name, *p, k, side, i, *at) for i, at in enumerate(path(pointer, end)))
    assert points == expected_points
    assert lines == expected_lines


@pytest.mark.parametrize("size, persistence", [(256, 0.8), (7, 0.8), (4, 0.3), (4, 100.0)])
def test_cancellation_equals_the_elder_rule(spark, size, persistence):
    maxima, saddles = RidgeComplex(table(spark, IMAGES), size=size).cancelled(persistence)
    got = {(r["image"], as_place(r["at"])): (as_place(r["survivor"]), r["persistence"]) for r in maxima.collect()}
    left = {(r["image"], as_place(r["at"]), r["edge"]): (r["cancelled"], {as_place(r["a"]), as_place(r["b"])}) for r in saddles.collect()}
    for name, v in IMAGES.items():
        pointer, found = brute(v)
        tops, gone = brute_cancelled(v, pointer, found, persistence)
        assert {k[1]: x for k, x in got.items() if k[0] == name} == tops
        for p, k, q in found:
            ends = {tops[path(pointer, e)[-1]][0] for e in (p, q)}
            assert left[name, p, k] == ((p, k) in gone, ends)
    if persistence > 50:
        assert all(sum(1 for k, x in got.items() if k[0] == name and x[0] == k[1]) == 1 for name in IMAGES)


def test_complex_of_nothing(spark):
    found = RidgeComplex(spark.createDataFrame([("a", 0, 0, None), ("a", 0, 1, float("nan"))], SCHEMA))
    assert found.critical_points().count() == 0 and found.lines().count() == 0
    assert [df.count() for df in found.cancelled(1.0)] == [0, 0]


# --- filters ----------------------------------------------------------------------------------------


def values(df, *names):
    return {(r["image"], r["x"], r["y"]): tuple(r[n] for n in names) for r in df.collect()}


SMALL = {k: IMAGES[k] for k in ("a", "ties", "flat", "wide")}


@pytest.mark.parametrize(
    "of",
    [
        lambda p, size: filters.multiscale(p, [0.5, 2.0], size=size),
        lambda p, size: filters.bilateral(p, size=size),
        lambda p, size: filters.bilateral(p, 1.0, 0.7, size=size),
        lambda p, size: filters.structure(p, size=size),
        lambda p, size: filters.membrane(p, 5, size=size),
        lambda p, size: filters.gabor(p, 0.25, (0.0, 0.7), size=size),
    ],
)
def test_tiling_changes_nothing(spark, of):
    pixels = table(spark, SMALL)
    whole = of(pixels, 256)
    names = [c for c in whole.columns if c not in ("image", "x", "y")]
    one, many = values(whole, *names), values(of(pixels, 6), *names)
    assert one.keys() == many.keys() and len(one) == sum(v.size for v in SMALL.values())
    assert all(a == pytest.approx(many[k], abs=1e-12) for k, a in one.items())


def test_multiscale_by_hand(spark):
    """One sigma, computed pixel by pixel with repeated borders."""
    v = IMAGES["a"]
    n, m = v.shape
    w = filters.kernel(0.5)
    reach = len(w) // 2
    clamp = lambda i, n: min(max(i, 0), n - 1)
    g = np.array([[sum(w[a + reach] * w[b + reach] * v[clamp(x + a, n), clamp(y + b, m)] for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)) for y in range(m)] for x in range(n)])
    found = values(filters.multiscale(table(spark, {"a": v}), [0.5], size=8), "intensity_0", "edges_0", "large_0", "small_0")
    hessian = [[np.gradient(np.gradient(g, axis=a), axis=b) for b in (0, 1)] for a in (0, 1)]
    for (_, x, y), (intensity, edges, large, small) in found.items():
        assert intensity == pytest.approx(g[x, y])
        at = lambda a, b, x=x, y=y: g[clamp(x + a, n), clamp(y + b, m)]
        sx = sum((2 - abs(b)) / 4 * (at(1, b) - at(-1, b)) / 2 for b in (-1, 0, 1))
        sy = sum((2 - abs(a)) / 4 * (at(a, 1) - at(a, -1)) / 2 for a in (-1, 0, 1))
        assert edges == pytest.approx(math.sqrt((sx * sx + sy * sy) / 2))
        e = np.linalg.eigvalsh([[hessian[a][b][x, y] for b in (0, 1)] for a in (0, 1)])
        assert (small, large) == pytest.approx(tuple(e), abs=1e-12)


def test_scales():
    assert filters.scales(0.5, 16.0) == [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]
    assert filters.scales(1.0, 4.0, 2) == [1.0, 4.0]
    with pytest.raises(ValueError):
        filters.multiscale(None, [1.0], intensity=False, edges=False, texture=False)


def test_entropy_equals_counting(spark):
    levels = {k: np.floor(v * 3) for k, v in SMALL.items()}
    for size in (256, 5):
        found = values(filters.entropy(table(spark, levels), size=size), "v")
        for (name, x, y), (h,) in list(found.items())[::7]:
            v = levels[name]
            seen = Counter(v[a, b] for a in range(v.shape[0]) for b in range(v.shape[1]) if (a - x) ** 2 + (b - y) ** 2 <= 9)
            total = sum(seen.values())
            assert h == pytest.approx(-sum(c / total * math.log2(c / total) for c in seen.values()), abs=1e-12)


def test_bilateral_of_a_flat_image_and_kernels(spark):
    found = values(filters.bilateral(table(spark, {"f": np.full((5, 4), 2.5)})), "v")
    assert set(found.values()) == {(2.5,)}
    lines = filters.membranes(9, 30)
    assert lines.shape == (30, 9, 9) and (lines[:, 4, 4] == 1).all() and lines[0].sum() == 9 and (lines[0][:, 4] == 1).all() and (lines[15][4] == 1).all()
    kernel = filters.gabor_kernel(0.25, 0.0)
    assert kernel == pytest.approx(kernel[::-1, ::-1]) and kernel.argmax() == kernel.size // 2


def test_patches_are_looked_up_once_for_each_place(spark):
    """Vertices on one place share its nine pixels: the plan spreads places, not vertices. One pixel has no value."""
    from filigree.operators import raster

    value = {(x, y): None if (x, y) == (1, 1) else (x * 7 + y * 5) % 10 / 10 for x in range(6) for y in range(5)}
    pixels = spark.createDataFrame([(x, y, v) for (x, y), v in value.items()], "x long, y long, v double")
    vertices = [(g, float(a), float(b)) for g in range(3) for a, b in [(1, 2)] * 4 + [(g, g + 1), (4, 5)]]
    points = spark.createDataFrame(vertices, "gid long, p0 double, p1 double")
    out = raster.patch_votes(points, pixels, 0.45, (6, 5))
    got = {r["gid"]: r["share"] for r in out.collect()}
    inside = lambda c, n: n - 2 if c + 1 >= n else c
    for g in range(3):
        seen = [value[(inside(round(p1), 6) + a) % 6, (inside(round(p0), 5) + b) % 5] for own, p0, p1 in vertices if own == g for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen = [v > 0.45 for v in seen if v is not None]
        assert abs(got[g] - sum(seen) / len(seen)) < 1e-12
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spread = plan[plan.index("Generate") :].splitlines()
    assert any("Aggregate" in line for line in spread[1:4])
