import math

import numpy as np
import pytest

from filigree.operators import extra_trees


def local(x, y, *, trees, depth, classes, seed, k):
    """The same forest, node by node over plain lists."""
    lowered = [[0.0] * x.shape[1] for _ in range(trees)]
    tried = []

    def gini(labels):
        return 1 - sum((labels.count(c) / len(labels)) ** 2 for c in range(classes)) if labels else 0.0

    def grow(t, node, rows, level):
        labels = [y[i] for i in rows]
        if level == depth or len(set(labels)) < 2:
            return
        best = None
        for j in extra_trees.drawn_features(seed, t, node, x.shape[1], k):
            own = [x[i][j] for i in rows]
            if min(own) == max(own):
                continue
            cut = min(own) + extra_trees.place_between(seed, t, node, j) * (max(own) - min(own))
            left, right = [i for i in rows if x[i][j] <= cut], [i for i in rows if x[i][j] > cut]
            tried.append((t, node, j, cut, tuple(sum(y[i] == c for i in left) for c in range(classes))))
            drop = (len(rows) * gini(labels) - len(left) * gini([y[i] for i in left]) - len(right) * gini([y[i] for i in right])) / len(x)
            if best is None or drop > best[0] + 1e-12 or (abs(drop - best[0]) <= 1e-12 and j < best[1]):
                best = (drop, j, left, right)
        if best:
            lowered[t][best[1]] += best[0]
            grow(t, 2 * node, best[2], level + 1)
            grow(t, 2 * node + 1, best[3], level + 1)

    for t in range(trees):
        grow(t, 1, list(range(len(x))), 0)
    shares = [[v / sum(own) for v in own] for own in lowered if sum(own) > 0]
    return [sum(c) / trees for c in zip(*shares)], sorted(tried)


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_a_local_forest(spark, classes):
    draw = np.random.default_rng(classes)
    x = draw.normal(size=(120, 9))
    x[:, 3] = 1.0  # constant
    x[:, 4] = np.round(x[:, 4])  # many ties
    y = np.digitize(x[:, 0] + 0.3 * draw.normal(size=120), [0.0, 0.8][: classes - 1])
    rows = [(r.tolist(), int(c)) for r, c in zip(x, y)] + [(None, 1), (x[0].tolist(), None), ([float("nan")] * 9, 0)]
    df = spark.createDataFrame(rows, "f array<double>, y int").repartition(4)
    settings = {"trees": 12, "depth": 4, "classes": classes, "seed": 5}
    expected, tried = local(x, y.tolist(), k=3, **settings)
    forest = extra_trees.fit(df, **settings)
    assert [t[:3] for t in sorted(forest.tried)] == [t[:3] for t in tried]
    assert [t[4] for t in sorted(forest.tried)] == [t[4] for t in tried]
    assert [t[3] for t in sorted(forest.tried)] == pytest.approx([t[3] for t in tried])
    got = extra_trees.importances(df, **settings).orderBy("idx").collect()
    assert [r["importance"] for r in got] == pytest.approx(expected, abs=1e-9)
    assert min(got, key=lambda r: r["rank"])["idx"] == 0 and got[3]["importance"] == 0
    assert math.isclose(sum(r["importance"] for r in got), 1.0)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "f array<double>, y int")
    assert extra_trees.importances(empty, trees=3, depth=2).collect() == []
    one = spark.createDataFrame([([1.0, 2.0], 1)] * 3, "f array<double>, y int")
    assert [r["importance"] for r in extra_trees.importances(one, trees=3, depth=2).collect()] == [0.0, 0.0]


def test_a_task_gives_one_row_for_each_place():
    parts = [(np.array([0, 2]), np.array([[1.0, 5.0, 2.0], [3.0, 3.0, 1.0]])), (np.array([2, 4]), np.array([[-1.0, 2.0, 4.0], [0.0, 0.0, 1.0]]))]
    places, values = extra_trees._combined(iter(parts), ["min", "max", "sum"], 6)
    assert places.tolist() == [0, 2, 4] and values.tolist() == [[1, 5, 2], [-1, 3, 5], [0, 0, 1]]
    assert [len(v) for v in extra_trees._combined(iter([]), ["sum"], 3)] == [0, 0]
