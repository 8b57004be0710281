import numpy as np
import pytest

from filigree.operators import walk_vectors
from filigree.operators.walk_vectors import walk_vectors as train


def cosines(vectors, groups):
    names = sorted(vectors)
    m = np.array([vectors[n] for n in names])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    same = np.array([[groups(a) == groups(b) for b in names] for a in names])
    c = m @ m.T
    return c[same & ~np.eye(len(names), dtype=bool)].mean(), c[~same].mean()


@pytest.fixture(scope="module")
def pairs(spark):
    """Cliques of eight nodes, pairs in all directions, some of them several times, and rows with nulls."""
    rows = [(8 * g + i, 8 * g + j) for g in range(10) for i in range(8) for j in range(8) if i != j for _ in range(1 + (i + j) % 2)]
    return spark.createDataFrame([*rows, (None, 1), (2, None)], "node long, ctx int")


def test_neighbours_are_nearer_whatever_the_number_of_blocks(spark, pairs):
    gaps = []
    for blocks in (1, 3):
        got = {r["node"]: r["vec"] for r in train(pairs, size=8, epochs=6, rate=0.2, blocks=blocks).collect()}
        assert sorted(got) == list(range(80))
        near, far = cosines(got, lambda n: n // 8)
        gaps.append(near - far)
    assert min(gaps) > 0.3 and abs(gaps[0] - gaps[1]) < 0.3


def test_partitions_change_nothing(spark, pairs):
    one = {r["node"]: r["vec"] for r in train(pairs.repartition(5, "ctx"), size=4, epochs=1, blocks=3).collect()}
    two = {r["node"]: r["vec"] for r in train(pairs.coalesce(1), size=4, epochs=1, blocks=3).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)


def test_one_step_by_hand():
    u, v = np.array([[0.5, -0.2]]), np.array([[0.3, 0.1], [-0.4, 0.6]])
    a, b = u.copy(), v.copy()
    walk_vectors.descend(a, b, np.array([0.0, 1.0]), np.array([0]), np.array([0]), np.array([2.0]), negatives=1, rate=0.1, draw=np.random.default_rng(0))
    s = lambda x: 1 / (1 + np.exp(-x))
    pull, push = 0.2 * (1 - s(u[0] @ v[0])), 0.2 * s(u[0] @ v[1])
    assert a[0] == pytest.approx(u[0] + pull * v[0] - push * v[1])
    assert b == pytest.approx(np.array([v[0] + pull * u[0], v[1] - push * u[0]]))


def test_nothing(spark):
    assert train(spark.createDataFrame([], "node long, ctx long")).collect() == []


def test_rounds_deal_few_rows_and_blocks_of_a_size(spark, pairs, monkeypatch):
    """A round's rows hold many vectors, and a block asked for alone is cut by its nodes."""
    stored, real = [], walk_vectors.store
    monkeypatch.setattr(walk_vectors, "store", lambda df, *a: stored.append(real(df, *a)) or stored[-1])
    monkeypatch.setattr(walk_vectors, "BLOCK_NODES", 20)
    got = {r["node"]: r["vec"] for r in train(pairs, size=8, epochs=1, blocks=1).collect()}
    assert sorted(got) == list(range(80)) and all(len(v) == 8 for v in got.values())
    rounds = stored[2:]
    assert [r.count() for r in rounds] == [8] * 4  # four blocks, both kinds of vectors
    held = [len(r["node"]) for r in rounds[-1].where("kind = 0").collect()]
    assert sum(held) == 80 and max(held) < 40
    monkeypatch.setattr(walk_vectors, "PACKED_ROWS", 3)
    cut = {r["node"]: r["vec"] for r in train(pairs, size=8, epochs=1, blocks=1).collect()}
    assert cut.keys() == got.keys() and all(cut[k] == pytest.approx(v, abs=1e-12) for k, v in got.items())
