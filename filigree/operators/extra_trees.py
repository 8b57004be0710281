"""Extremely randomised trees, grown level by level over all rows.

At each node some features are drawn, and for each of them one threshold between the least and the
largest value that the node's rows have; the split that lowers the Gini impurity most is taken. Chance
is a digest of tree, node and feature, so a forest is the same however rows are partitioned.

A level takes two passes over the rows for all trees at once: bounds and class counts of the drawn
features, then class counts left of the thresholds. Tasks combine their rows to one number for each
tree, node and drawn feature before anything is shuffled. The forest itself, ``trees`` times 2^depth
nodes at most, is what the driver holds and the tasks are sent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of rows by trees by drawn features that a task holds at a time.
HELD = 1 << 20


def _integer(seed: int, *keys: int) -> int:
    """As functions.keyed.integer."""
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16)


def drawn_features(seed: int, tree: int, node: int, width: int, k: int) -> list[int]:
    return sorted(range(width), key=lambda j: (_integer(seed, tree, node, j), j))[:k]


def place_between(seed: int, tree: int, node: int, feature: int) -> float:
    return (_integer(seed + 1, tree, node, feature) + 0.5) / 4294967296.0


@dataclass
class Forest:
    """By tree and node (1 is the root, 2n and 2n + 1 the children of n): the split feature (-1: none), its threshold, the rows that it splits and by how much it lowers their impurity. tried: every split that was looked at, as (tree, node, feature, threshold, counts left of it)."""

    feature: np.ndarray
    threshold: np.ndarray
    rows: np.ndarray
    lowered: np.ndarray
    tried: list[tuple] = field(default_factory=list)

    def nodes(self, x: np.ndarray, level: int) -> np.ndarray:
        """(rows, trees): each row's node at a level, 0 where it came to rest before."""
        trees = np.arange(len(self.feature))
        at = np.ones((len(x), len(trees)), dtype=np.int64)
        for _ in range(level):
            split = self.feature[trees, at]
            right = np.take_along_axis(x, np.maximum(split, 0), axis=1) > self.threshold[trees, at]
            at = np.where((at > 0) & (split >= 0), 2 * at + right, 0)
        return at

    def importances(self) -> np.ndarray:
        """The share of each feature in what a tree's splits lower, averaged over the trees."""
        width = int(self.feature.max(initial=0)) + 1
        total = np.zeros((len(self.feature), width))
        for tree, node in zip(*np.nonzero(self.feature >= 0), strict=True):
            total[tree, self.feature[tree, node]] += self.lowered[tree, node]
        sums = total.sum(axis=1, keepdims=True)
        return np.divide(total, sums, out=np.zeros_like(total), where=sums > 0).mean(axis=0)


def gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1)
    return 1 - (np.divide(counts, np.maximum(n, 1)[..., None]) ** 2).sum(axis=-1)


def _combined(parts: Iterator[tuple[np.ndarray, np.ndarray]], how: list[str], places: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of parts whose places don't repeat, combined to one row for each place."""
    start = {"min": np.inf, "max": -np.inf, "sum": 0.0}
    total, seen = np.tile([start[h] for h in how], (places, 1)), np.zeros(places, dtype=bool)
    ufunc = {"min": np.minimum, "max": np.maximum, "sum": np.add}
    for own, found in parts:
        seen[own] = True
        for i, h in enumerate(how):
            total[own, i] = ufunc[h](total[own, i], found[:, i])
    return np.flatnonzero(seen), total[seen]


def _pass(rows: DataFrame, width: int, values: int, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], how: list[str], count: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): what tasks make of their rows (features, classes), combined by place; count: how many places there may be."""
    names = [f"v{i}" for i in range(len(how))]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, HELD // values)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                yield of(own.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), own.column(1).to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, found = _combined(parts(batches), how, count)
        yield pa.RecordBatch.from_arrays([pa.array(places), *(pa.array(found[:, i]) for i in range(len(how)))], ["place", *names])

    schema = "place long, " + ", ".join(f"{n} double" for n in names)
    table = rows.mapInArrow(run, schema).groupBy("place").agg(*(getattr(F, h)(n).alias(n) for h, n in zip(how, names, strict=True))).toArrow()  # a row for each tree, node and drawn feature
    return table["place"].to_numpy(), np.stack([table[n].to_numpy() for n in names], axis=1) if table.num_rows else np.zeros((0, len(how)))


def _by_place(places: np.ndarray, parts: list[np.ndarray], how: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values combined by place, as Spark will go on to do."""
    order = np.argsort(places, kind="stable")
    own = places[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    ufunc = {"min": np.minimum, "max": np.maximum, "sum": np.add}
    return own[heads], np.stack([ufunc[h].reduceat(p[order], heads) if len(heads) else p[:0] for h, p in zip(how, parts, strict=True)], axis=1)


def fit(rows: DataFrame, *, trees: int = 250, depth: int = 6, classes: int = 2, seed: int = 0, drawn: int | None = None) -> Forest:
    """A forest over rows (f: numbers, y: class from 0).

    drawn: features tried at a node, the root of their number by default. A node is not split if it is
    pure, has one row, lies at the depth bound, or if all drawn features are constant in it. Rows without
    features, without a class, or with a null or nan among the features are left out.
    """
    known = rows.where("f IS NOT NULL AND y IS NOT NULL").select(F.transform("f", lambda v: v.cast("double")).alias("f"), F.col("y").cast("long").alias("y")).where("NOT exists(f, v -> v IS NULL OR isnan(v))")
    first = known.select(F.size("f").alias("n")).first()
    size = 1 << (depth + 1)
    forest = Forest(np.full((trees, size), -1, dtype=np.int64), np.zeros((trees, size)), np.zeros((trees, size)), np.zeros((trees, size)))
    if first is None:
        return forest
    width = first["n"]
    k = max(1, int(math.sqrt(width))) if drawn is None else drawn
    sc = rows.sparkSession.sparkContext
    live = {(t, 1) for t in range(trees)}
    for level in range(depth):
        chosen = np.zeros((trees, 1 << level, k), dtype=np.int64)
        for t, node in live:
            chosen[t, node - (1 << level)] = drawn_features(seed, t, node, width, k)
        active = np.zeros((trees, size), dtype=bool)
        for t, node in live:
            active[t, node] = True
        sent = sc.broadcast((forest.feature, forest.threshold, chosen, active))
        values = trees * k

        def values_at(x: np.ndarray, sent=sent, level=level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of all rows, trees and drawn features in play: the row, the place and the value."""
            feature, threshold, chosen, active = sent.value
            at = Forest(feature, threshold, threshold, threshold).nodes(x, level)
            row, tree = np.nonzero(active[np.arange(trees), at])
            node = at[row, tree] - (1 << level)
            own = chosen[tree, node]
            place = ((tree << level) + node)[:, None] * k + np.arange(k)
            return np.repeat(row, k), place.ravel(), x[row[:, None], own].ravel()

        how = ["min", "max", *["sum"] * classes]

        def bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, place, value = values_at(x)
            return _by_place(place, [value, value, *((y[row] == c).astype(float) for c in range(classes))], how)

        places, found = _pass(known, width, values, bounds, how, (trees << level) * k)
        at = np.argsort(places)
        places, low, high, counts = places[at], found[at, 0], found[at, 1], found[at, 2:]
        tree, node = places // k >> level, places // k & ((1 << level) - 1)
        feature = chosen[tree, node, places % k]
        node = node + (1 << level)
        mixed = (counts.max(axis=1) < counts.sum(axis=1)) & (low < high)
        cutoff = np.full(trees << level, np.nan).repeat(k)
        for i in np.flatnonzero(mixed).tolist():
            cutoff[places[i]] = low[i] + place_between(seed, int(tree[i]), int(node[i]), int(feature[i])) * (high[i] - low[i])
        limits = sc.broadcast(cutoff)

        def left(x: np.ndarray, y: np.ndarray, limits=limits) -> tuple[np.ndarray, np.ndarray]:
            row, place, value = values_at(x)
            below = value <= limits.value[place]  # nan: never
            return _by_place(place[below], [(y[row[below]] == c).astype(float) for c in range(classes)], ["sum"] * classes)

        left_places, left_found = _pass(known, width, values, left, ["sum"] * classes, len(cutoff))
        sent.destroy()
        limits.destroy()
        lefts = np.zeros((len(cutoff), classes))
        lefts[left_places] = left_found
        best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
        if level == 0:
            n_all = counts[0].sum() if len(counts) else 0
        for i in np.flatnonzero(mixed).tolist():
            t, n, j = int(tree[i]), int(node[i]), int(feature[i])
            own, cut = counts[i], float(cutoff[places[i]])
            mine = lefts[places[i]]
            forest.tried.append((t, n, j, cut, tuple(mine.astype(int).tolist())))
            rest = own - mine
            size_ = own.sum()
            drop = round(float(size_ * gini(own) - mine.sum() * gini(mine) - rest.sum() * gini(rest)) / n_all, 12)  # equal splits tie
            if (t, n) not in best or (drop, -j) > (best[t, n][0], -best[t, n][1]):
                best[t, n] = (drop, j, cut, size_)
        live = set()
        for (t, n), (drop, j, cut, size_) in best.items():
            forest.feature[t, n], forest.threshold[t, n], forest.rows[t, n], forest.lowered[t, n] = j, cut, size_, drop
            if level + 1 < depth:
                live |= {(t, 2 * n), (t, 2 * n + 1)}
        if not live:
            break
    return forest


def importances(rows: DataFrame, **settings) -> DataFrame:
    """idx, importance, rank of each feature, largest first; features that no split uses have 0."""
    spark = rows.sparkSession
    forest = fit(rows, **settings)
    width = rows.where("f IS NOT NULL").select(F.size("f").alias("n")).first()
    found = np.zeros(width["n"] if width else 0)
    own = forest.importances()
    found[: min(len(own), len(found))] = own[: len(found)]
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(found)], "idx int, importance double")  # one number a feature
    return table.selectExpr("idx", "importance", "CAST(row_number() OVER (ORDER BY importance DESC, idx) AS INT) AS rank")
