import numpy as np
import pyarrow as pa
import pytest

from filigree.operators import sage
from filigree.operators.sage import Adam, Model

WIDTH = 6


def some(model, n, seed):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, model.support, WIDTH))


def numeric(loss, weights, k, at, step=1e-6):
    out = []
    for sign in (1, -1):
        moved = {name: w.copy() for name, w in weights.items()}
        moved[k].ravel()[at] += sign * step
        out.append(loss(moved))
    return (out[0] - out[1]) / (2 * step)


@pytest.mark.parametrize("concat", [True, False])
@pytest.mark.parametrize("pool", sage.POOLS)
def test_slopes_equal_numeric_ones(pool, concat):
    draw = np.random.default_rng(1)
    for kind, positive in (("softmax", 1.0), ("sigmoid", 2.5)):
        model = Model(WIDTH, pool, out=(4, 3), hidden=5, samples=(3, 2), classes=3, concat=concat, loss=kind, positive=positive)
        weights = model.start(2)
        x, y = some(model, 7, 3), draw.integers(0, 3, 7)
        _, slopes = sage.supervised(model, weights, x, y)
        for k, w in weights.items():
            for at in draw.integers(0, w.size, 4):
                assert slopes[k].ravel()[at] == pytest.approx(numeric(lambda v: sage.supervised(model, v, x, y)[0], weights, k, at), rel=1e-4, abs=1e-6)
    u, v, n = some(model, 5, 4), some(model, 5, 5), some(model, 4, 6)
    _, slopes, places = sage.skip_gram(model, weights, u, v, n)
    assert ((places >= 1) & (places <= 5)).all()
    for k, w in weights.items():
        for at in draw.integers(0, w.size, 4):
            assert slopes[k].ravel()[at] == pytest.approx(numeric(lambda z: sage.skip_gram(model, z, u, v, n)[0], weights, k, at), rel=1e-4, abs=1e-6)


def test_unknown_pool_or_loss():
    with pytest.raises(ValueError):
        Model(4, "seq")
    with pytest.raises(ValueError):
        Model(4, loss="hinge")


@pytest.fixture(scope="module")
def graph_of(spark):
    """Forty nodes on a ring with four slots, the last of which is the phantom for some, and a node without neighbours at all."""
    draw = np.random.default_rng(7)
    n = 40
    vectors = {i: draw.normal(size=WIDTH) + (i % 2) for i in range(n)}
    near = {(i, s): -1 if (s == 3 and i % 5 == 0) or i == 39 else (i + 2 + 2 * s) % n for i in range(n) for s in range(4)}
    adj = spark.createDataFrame([(i, s, t) for (i, s), t in near.items()], "node long, slot int, nbr long").repartition(3)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(99, None)], "gid long, f array<double>")
    return vectors, near, adj, features


def test_supports_hold_the_sampled_neighbours(spark, graph_of):
    vectors, near, adj, features = graph_of
    for samples in ((3, 2), (6, 5)):
        model = Model(WIDTH, samples=samples)
        a, b = samples
        got = sage.supports(features.where("gid < 99"), adj, features, model, seed=5).orderBy("gid").toArrow()
        assert got["gid"].to_pylist() == list(range(40))
        x = sage.arrays(got["x"].combine_chunks(), model)
        zero = np.zeros(WIDTH)
        slots = []
        for i in range(40):
            assert x[i, 0] == pytest.approx(vectors[i])
            fits = [{s for s in range(4) if np.allclose(x[i, 1 + j], vectors.get(near[i, s], zero))} for j in range(a)]
            slots = [f & g for f, g in zip(slots, fits)] if slots else fits
        assert all(len(s) == 1 for s in slots)  # the same slot for all nodes
        first = [next(iter(s)) for s in slots]
        assert len(set(first)) == min(a, 4)
        for i in range(40):
            for j in range(a):
                nbr = near[i, first[j]]
                for k in range(b):
                    place = x[i, 1 + a + j * b + k]
                    options = [zero] if nbr < 0 else [vectors.get(near[nbr, s], zero) for s in range(4)]
                    assert any(np.allclose(place, o) for o in options)


def test_training_equals_a_local_one(spark, graph_of):
    """Sums over tasks and batches give the weights that numpy gives with whole batches, Adam's state going on between them."""
    vectors, near, adj, features = graph_of
    model = Model(WIDTH, "maxpool", out=(4, 4), hidden=5, samples=(3, 2))
    known = sage.supports(features.where("gid < 99"), adj, features, model).selectExpr("gid", "x", "CAST(gid % 2 AS INT) AS y")
    rows, n = sage.by_batch(known, 15, 1, "gid")
    assert n == 3
    told = []
    got = sage.train(rows, n, model, epochs=2, rate=0.05, decay=0.01, seed=4, each=lambda epoch, loss, w: told.append((epoch, loss)))
    local = Adam(dict(model.start(4)), 0.05, 0.01)
    table = rows.orderBy("gid").toArrow()
    x, y, batch = sage.arrays(table["x"].combine_chunks(), model), table["y"].to_numpy(), table["batch"].to_numpy()
    for epoch in range(2):
        total = 0.0
        for b in sage._order(n, epoch, 4):
            own = batch == b
            loss, slopes = sage.supervised(model, local.weights, x[own], y[own])
            total += loss
            local.step({k: s / own.sum() for k, s in slopes.items()})
        assert told[epoch] == (epoch, pytest.approx(total / 40))
    assert all(got[k] == pytest.approx(w, abs=1e-9) for k, w in local.weights.items())
    p = {r["gid"]: r["p"] for r in sage.predicted(known, model, got).collect()}
    assert [p[i] for i in range(40)] == pytest.approx([pytest.approx(v) for v in sage.scores(model, got, x)])
    assert told[1][1] < told[0][1]


def test_a_second_phase_begins_with_the_weights_of_the_first(spark, graph_of):
    vectors, near, adj, features = graph_of
    model = Model(WIDTH, out=(4, 4), samples=(2, 2))
    known = sage.supports(features.where("gid < 99"), adj, features, model).selectExpr("gid", "x", "CAST(gid % 2 AS INT) AS y")
    first, n = sage.by_batch(known.where("gid < 20"), 100, 1, "gid")
    second, m = sage.by_batch(known, 100, 1, "gid")
    one = sage.train(first, n, model, epochs=2)
    assert sage.train(second, m, model, epochs=0, weights=one) == one
    table = second.toArrow()
    x, y = sage.arrays(table["x"].combine_chunks(), model), table["y"].to_numpy()
    expected = Adam(dict(one), 0.01)
    expected.step({k: s / len(y) for k, s in sage.supervised(model, one, x, y)[1].items()})
    two = sage.train(second, m, model, epochs=1, weights=one)
    assert all(two[k] == pytest.approx(w, abs=1e-9) for k, w in expected.weights.items())


def test_unsupervised_training_draws_by_degree_and_falls(spark, graph_of):
    vectors, near, adj, features = graph_of
    model = Model(WIDTH, "gcn", out=(6, 6), samples=(3, 2))
    known = sage.supports(features.where("gid < 99"), adj, features, model)
    degrees = spark.createDataFrame([(i, 0 if i % 4 else 1 + i) for i in range(40)], "gid long, degree long")
    drawn = sage.negatives(degrees, known, model, 6, 3, 1)
    own = {tuple(np.round(vectors[i], 9)) for i in range(0, 40, 4)}
    assert len(drawn) == 6 and {tuple(np.round(x, 9)) for x in drawn[:, 0]} <= own
    assert np.array_equal(np.sort(drawn, axis=0), np.sort(sage.negatives(degrees, known, model, 6, 3, 1), axis=0))
    pairs = spark.createDataFrame([(i, (i + 2) % 40) for i in range(40)], "node long, ctx long")
    told = []
    weights = sage.train_unsupervised(pairs, known, degrees, model, epochs=3, size=20, drawn=4, rate=0.05, each=lambda *x: told.append(x[:3]))
    assert [t[0] for t in told] == [0, 1, 2, 3] and told[3][1] < told[0][1] and all(0 < t[2] <= 1 for t in told)
    vec = sage.embeddings(known, model, weights).collect()
    assert len(vec) == 40 and all(sum(v * v for v in r["vec"]) == pytest.approx(1) for r in vec)


@pytest.mark.parametrize("chain, jobs", [(1000, 1), (10, 4), (3, 8)])
def test_small_batches_share_a_job_and_large_ones_their_tasks(spark, graph_of, monkeypatch, chain, jobs):
    """Eight batches of five rows: all in a task, two in each, or more tasks for one batch; the weights are the same."""
    vectors, near, adj, features = graph_of
    model = Model(WIDTH, out=(4, 4), samples=(2, 2))
    known = sage.supports(features.where("gid < 99"), adj, features, model).selectExpr("gid", "x", "CAST(gid % 2 AS INT) AS y")
    rows, n = sage.by_batch(known, 5, 1, "gid")
    calls = []
    for name in ("chained", "summed"):
        monkeypatch.setattr(sage, name, lambda *x, f=getattr(sage, name), name=name: (calls.append(name), f(*x))[1])
    monkeypatch.setattr(sage, "CHAIN_ROWS", chain)
    got = sage.train(rows, n, model, epochs=1)
    assert n == 8 and calls == ["summed" if chain < 5 else "chained"] * jobs
    table = rows.toArrow()
    x, y, batch = sage.arrays(table["x"].combine_chunks(), model), table["y"].to_numpy(), table["batch"].to_numpy()
    local = Adam(dict(model.start()))
    for b in sage._order(n, 0, 0):
        own = batch == b
        if own.any():
            local.step({k: s / own.sum() for k, s in sage.supervised(model, local.weights, x[own], y[own])[1].items()})
    assert all(got[k] == pytest.approx(w, abs=1e-9) for k, w in local.weights.items())


def test_features_of_32_bits_stay_so(spark, graph_of):
    vectors, near, adj, features = graph_of
    model = Model(WIDTH, samples=(3, 2))
    one, two = (sage.supports(f.where("gid < 99"), adj, f, model).orderBy("gid").toArrow()["x"].combine_chunks() for f in (features.selectExpr("gid", "CAST(f AS array<float>) AS f"), features))
    assert 2 * len(one[0].as_py()) == len(two[0].as_py()) and sage.arrays(one, model) == pytest.approx(sage.arrays(two, model), rel=1e-6)
    assert np.array_equal(sage.arrays(two.slice(7, 5), model), sage.arrays(two, model)[7:12]) and sage.arrays(two.slice(0, 0), model).shape == (0, model.support, WIDTH)


def test_nodes_are_drawn_by_degree_without_repetition(spark):
    degrees = spark.createDataFrame([(i, [0, 1, 16][i % 3]) for i in range(30)], "gid long, degree long")
    rows = sage.drawn_nodes(degrees, 200, 2, 4, 5).collect()
    sets = {}
    for r in rows:
        sets.setdefault((r["batch"], r["epoch"]), set()).add(r["gid"])
    assert len(rows) == 1600 and set(sets) == {(b, e) for b in range(200) for e in range(2)} and all(len(s) == 4 for s in sets.values())
    assert all(r["gid"] % 3 for r in rows)
    heavy = np.mean([r["gid"] % 3 == 2 for r in rows])
    draw, trials = np.random.default_rng(0), []
    for _ in range(4000):
        u = -np.log(draw.random(20)) / np.repeat([1, 16**0.75], 10)
        trials.append((np.argsort(u)[:4] >= 10).mean())
    assert heavy == pytest.approx(np.mean(trials), abs=0.03)
    assert len(sage.drawn_nodes(degrees, 3, 1, 50, 5).collect()) == 3 * 20


def test_supports_keep_their_precision():
    for pool in sage.POOLS:
        model = Model(WIDTH, pool, out=(4, 3), hidden=5, samples=(3, 2))
        weights, x = model.start(2), some(model, 7, 3).astype(np.float32)
        column = pa.array([row.tobytes() for row in x], pa.binary())
        read = sage.arrays(column, model)
        assert read.dtype == np.float32 and (read == x).all()
        for f in (lambda z: sage.supervised(model, weights, z, np.arange(7) % 2), lambda z: sage.skip_gram(model, weights, z, z[::-1], z[:3])[:2]):
            (loss, slopes), (loss64, slopes64) = f(x), f(x.astype(np.float64))
            assert loss == pytest.approx(loss64, rel=1e-5)
            for k, s in slopes.items():
                assert s.dtype == np.float64 and s == pytest.approx(slopes64[k], rel=1e-3, abs=1e-4)


def test_fits_are_scored_in_one_reading(spark, graph_of):
    vectors, near, adj, features = graph_of
    models = [Model(WIDTH, pool, out=(4, 4), samples=(2, 2)) for pool in ("mean", "maxpool")]
    known = sage.supports(features.where("gid < 99"), adj, features, models[0]).selectExpr("gid", "x", "CAST(gid % 2 AS INT) AS y")
    fits = [(m, m.start(seed)) for m in models for seed in (1, 2)]
    said = {r["gid"]: r["said"] for r in sage.classes(known, fits).collect()}
    for k, (m, w) in enumerate(fits):
        p = {r["gid"]: r["p"] for r in sage.predicted(known, m, w).collect()}
        assert {g: s[k] for g, s in said.items()} == {g: int(np.argmax(v)) for g, v in p.items()}


def test_epochs_are_not_scored_one_by_one(spark, monkeypatch):
    """Supports are written once and read once for the scores of all epochs and pools; nothing is written for an epoch."""
    from filigree.plans import models

    written, real, classes = [], models.store, []
    monkeypatch.setattr(models, "store", lambda df, *a: written.append(df.columns) or real(df, *a))
    monkeypatch.setattr(sage, "classes", lambda rows, fits, f=sage.classes: classes.append(len(fits)) or f(rows, fits))
    rows = models.m17(spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 1 and classes == [8] and len(rows) == 96
    assert {(r["pool"], r["epoch"], r["partition"], r["avg_type"]) for r in rows} == {(p, e, part, kind) for p in ("mean", "maxpool") for e in (1, 2, 3, 4) for part in models.PARTS for kind in models.AVERAGES}
    assert all(0 <= r["f1"] <= 1 for r in rows)


def test_products_of_many_axes_are_one():
    x, w = np.random.default_rng(1).normal(size=(3, 4, 5, 6)), np.random.default_rng(2).normal(size=(6, 2))
    assert sage._times(x[:, 1:], w) == pytest.approx(x[:, 1:] @ w)


def test_scores_by_columns_equal_those_of_each_part(spark):
    from pyspark.sql import functions as F

    from filigree.operators import metrics

    pred = spark.range(200).selectExpr("id % 3 AS part", "CAST(id % 2 AS INT) AS y", "CAST(id * 7 % 5 > 2 AS INT) AS yhat")
    got = {(r["part"], r["avg_type"]): (r["precision"], r["recall"], r["f1"]) for r in metrics.averaged_scores(pred, "part").collect()}
    expected = {(k, r["avg_type"]): (r["precision"], r["recall"], r["f1"]) for k in range(3) for r in metrics.averaged_scores(pred.where(F.col("part") == k)).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_every_fit_is_below_the_mean_label(spark, tmp_path, monkeypatch):
    """m_fits over labels without any tie to the vectors, where steps end above the mean label's loss and an optimiser gives up after two rounds."""
    from filigree.operators import learning
    from filigree.plans import models

    draw = np.random.default_rng(3)
    rows = [(i, v.tolist(), int(draw.integers(0, 10))) for i, v in enumerate(draw.normal(size=(400, 64)) / 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole, train = learning.MultilayerPerceptronClassifier, sage.train
    monkeypatch.setattr(learning, "MultilayerPerceptronClassifier", lambda maxIter, **more: whole(maxIter=min(maxIter, 2), **more))
    monkeypatch.setattr(sage, "train", lambda *x, **more: train(*x, **more) | {"q": np.array([3.0, -3.0])})
    assert sorted(map(tuple, models.m_fits(spark, str(tmp_path)).collect())) == [(name, 400, True, True) for name in ("m14_graphsage", "m18_logreg", "m19_rf_nodes", "m21_mlp")]
