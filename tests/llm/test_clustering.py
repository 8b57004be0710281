import hashlib
import math

import numpy as np
import pytest

from filigree.llm import clustering
from filigree.llm.clustering import Settings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, settings=Settings()):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == settings.components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(x)) for x in v]))
    drawn = sorted((hashlib.sha256(f"{settings.draw}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in drawn[: settings.centroids]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(settings.rounds):
        near = assign()
        for k in range(len(centroids)):
            if own := [v for (_, v), (_, n) in zip(kept, near) if n == k]:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    near = assign() if centroids else []
    inertia = [sum(d for d, n in near if n == k) for k in range(len(centroids))]
    return sorted(((i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near)), key=repr)


def vectors(n, seed=3):
    draw = np.random.default_rng(seed)
    centre = draw.normal(0, 1, (5, 64))
    rows = [(i, (centre[i % 5] + draw.normal(0, 0.2, 64)).astype(np.float32).tolist(), 0) for i in range(n)]
    odd = [(1_000, None, 0), (1_001, [], 0), (1_002, [1.0] * 63, 0), (1_003, [1.0] * 65, 0), (1_004, [1.0] * 63 + [None], None), (1_005, [float("nan")] * 64, 0), (1_006, [float("inf")] + [0.0] * 63, 0)]
    ties = [(2_000 + i, [(-0.5) ** (i % 3)] * 64, 0) for i in range(12)]
    return rows + odd + ties + [(None, [0.25] * 64, 0), (7, rows[0][1], 0), rows[9], rows[9], (3_000, [1e5] * 64, 0), (3_001, [-1e5] * 64, 0), (3_002, [-0.001] * 64, 0)]


def found(df):
    return sorted((tuple(r) for r in df.drop("n_measured").collect()), key=repr)


@pytest.mark.parametrize("settings", [Settings(), Settings(centroids=5, rounds=1, segments=3), Settings(centroids=500, segments=64), Settings(rounds=0, draw=9)])
def test_equals_brute_force(spark, settings):
    rows = vectors(150)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "'x' AS cluster", "'x' AS short").repartition(3)
    assert found(clustering.cluster(df, settings=settings)) == brute(rows, settings)


def test_bounds_hold_and_rule_out_centroids():
    draw = np.random.default_rng(1)
    centre = draw.integers(-300, 300, (16, 64))
    x = centre[draw.integers(0, 16, 3_000)] + draw.integers(-20, 21, (3_000, 64))
    best, far, measured = clustering.nearest(x, clustering.compressed(x, 8), centre, 8)
    exact = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert measured.mean() < 2
    a, b = clustering.compressed(x, 8), clustering.compressed(centre, 8)
    assert (((a[:, None, :] - b[None]) ** 2).sum(axis=2) <= exact + 1e-6).all()
    # large components, where a double no longer holds every square
    big = draw.integers(-clustering.LIMIT + 1, clustering.LIMIT, (2_000, 64))
    big[1::2] = big[::2] + draw.integers(-1, 2, (1_000, 64))
    best, far, _ = clustering.nearest(big, clustering.compressed(big, 8), big[:16], 8)
    exact = ((big[:, None, :] - big[None, :16]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


def test_nothing_to_cluster(spark):
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, None, 0), (None, [1.0] * 64, 0)], SCHEMA)).collect() == []
    assert len(clustering.cluster(spark.createDataFrame([(1, [1.0] * 64, 0)], SCHEMA)).collect()) == 1


def test_components_without_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        clustering.cluster(spark.createDataFrame([(1, [3e38] * 64, 0)], SCHEMA))
