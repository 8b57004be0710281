"""Queries of models; their numbers have no counterpart in SQL, the tests hold them against held-out labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import aggregation, extra_trees, graph, learning, metrics, neural, raster, sage, spatial, sphere, walk_vectors
from ..operators.keeping import keep, store
from . import fixtures as fx
from .graphs import integer_sql
from .registry import query
from .shapes import r


def train():
    return F.col("gid") % 5 != 0


def labelled(spark, d):
    return fx.feat(spark, d).select("gid", "f", F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"))


@query("m18_logreg")
def m18(spark, d):
    return learning.logistic(labelled(spark, d), train())


@query("m18_majority", "SELECT gid, y, (SELECT arg_min(y, (-n, y)) FROM (SELECT y, count(*) AS n FROM pred WHERE gid % 5 <> 0 GROUP BY y) t) AS said FROM pred", "pred")
def m18_majority(spark, d):
    return learning.majority(labelled(spark, d), train())


@query("m19_rf_nodes")
def m19(spark, d):
    return learning.forest(labelled(spark, d), train())


@query("m20_rf_pixels")
def m20(spark, d):
    """Pixels by their value, their blurred value and the edge there, each with the label of its column; then votes."""
    px = fx.pixel(spark, d)
    blurred, edge = raster.gaussian(px, 1.0).withColumnRenamed("v", "g"), raster.weighted(px, raster.SOBEL).withColumnRenamed("v", "e")
    rows = px.join(blurred, ["x", "y"]).join(edge, ["x", "y"]).select(F.col("x").alias("gid"), F.array("v", "g", "e").alias("f"))
    rows = store(rows.join(fx.pred(spark, d).select("gid", "y"), "gid"))  # the fit reads them several times
    return learning.voted(learning.pixel_forest(rows, train()))


@query("m21_mlp")
def m21(spark, d):
    return learning.perceptron(labelled(spark, d), train(), 64)


def self_and_neighbours(spark, d):
    rows = aggregation.propagate(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f"), "mean", hops=1)
    return rows.join(labelled(spark, d).select("gid", "y"), "gid")


@query("m14_one_hop")
def m14_one_hop(spark, d):
    """A node's vector behind the mean of its neighbours', through weights that are trained with the classifier: the mean aggregator's two matrices are the hidden layer's."""
    return learning.perceptron(store(self_and_neighbours(spark, d)), train(), 128)


@query("m17_more_rounds")
def m17_more_rounds(spark, d):
    """The same model after more and more rounds, with its scores on the nodes it has and hasn't seen."""
    rows, out = store(self_and_neighbours(spark, d)), []  # read by three fits and three scorings
    for rounds in (5, 20, 40):
        said = keep(learning.perceptron(rows, train(), 128, iterations=rounds).withColumn("yhat", (F.col("p") > 0.5).cast("int")))
        for part, chosen in (("train", train()), ("val", ~train())):
            out.append(metrics.averaged_scores(said.where(chosen)).select(F.lit(rounds).alias("rounds"), F.lit(part).alias("partition"), "avg_type", "f1"))
    return reduce(lambda a, b: a.unionByName(b), out)


SAGE_BATCH, SAGE_EPOCHS = 128, 4


def sage_rows(spark, d, model: sage.Model):
    """The support, label and partition of every node."""
    known = sage.supports(fx.feat(spark, d), fx.ring(spark, d), plain(spark, d), model, seed=3)
    return known.join(labelled(spark, d).select("gid", "y"), "gid").withColumn("partition", F.when(train(), "train").when(F.col("gid") % 10 == 0, "val").otherwise("test"))


def sage_batches(rows):
    return sage.by_batch(rows.where("partition = 'train'").select("gid", "x", "y"), SAGE_BATCH, 1, "gid")


def at_once(f, of) -> list:
    """f of each, their jobs side by side: a training's steps wait for each other, those of two trainings don't."""
    with ThreadPoolExecutor(len(of)) as pool:
        return list(pool.map(f, of))


@query("m14_graphsage")
def m14(spark, d):
    """Two hops over sampled supports with max pooling, trained by batches: the probability of class 1 of every node.

    Steps of batches end around the least loss, where labels hardly follow from the features above that of
    the mean label. The last layer is therefore fitted once more, to all training rows over their embeddings.
    """
    model = sage.Model(64, "maxpool")
    rows = store(sage_rows(spark, d, model))
    weights = sage.train(*sage_batches(rows), model, epochs=SAGE_EPOCHS, decay=1e-4)
    embedded = store(sage.embeddings(rows.select("gid", "y", "x"), model, weights))  # the fit reads them several times
    return learning.logistic(embedded.withColumnRenamed("vec", "f"), train(), decay=1e-4)


@query("x13_two_phases")
def x13_two_phases(spark, d):
    """A first phase over the rows of the sublevel set (gid % 7 = 0) alone, then one over all training rows that begins with its weights."""
    model = sage.Model(64, "mean")
    rows = store(sage_rows(spark, d, model))
    seen = rows.where("partition = 'train'").select("gid", "x", "y")
    weights = None
    for chosen, epochs in ((seen.where("gid % 7 = 0"), 2), (seen, 2)):
        batches, n = sage.by_batch(chosen, SAGE_BATCH, 1, "gid")
        weights = sage.train(batches, n, model, epochs=epochs, decay=1e-4, weights=weights)
    return sage.predicted(rows.select("gid", "y", "x"), model, weights).select("gid", "y", F.element_at("p", 2).alias("p"))


PARTS, AVERAGES = ("train", "val", "test"), ("class", "macro", "micro", "weighted")


def epoch_fits(batches, pool: str) -> list:
    """(pool, epoch, loss, model, weights) after each epoch of a training."""
    model, out = sage.Model(64, pool), []
    sage.train(*batches, model, epochs=SAGE_EPOCHS, decay=1e-4, each=lambda epoch, loss, weights: out.append((pool, epoch + 1, loss, model, weights)))
    return out


@query("m17_train_and_evaluate")
def m17(spark, d):
    """The scores of two-hop models on the partitions after each epoch, by pooling, with the epoch's mean loss."""
    rows = store(sage_rows(spark, d, sage.Model(64)))  # the supports are the same for every pooling
    batches = sage_batches(rows)
    fits = [fit for of in at_once(lambda pool: epoch_fits(batches, pool), ("mean", "maxpool")) for fit in of]
    said = sage.classes(rows.select("y", "partition", "x"), [fit[3:] for fit in fits])  # once for all epochs
    scores = metrics.averaged_scores(said.select("y", "partition", F.posexplode("said").alias("fit", "yhat")), "fit", "partition")
    told = spark.createDataFrame([(i, *fit[:3], part, kind) for i, fit in enumerate(fits) for part in PARTS for kind in AVERAGES], "fit int, pool string, epoch int, loss double, partition string, avg_type string")
    return told.join(F.broadcast(scores), ["fit", "partition", "avg_type"], "left").select("pool", "epoch", "partition", "avg_type", "f1", "loss")  # a row for each of these


@query("m17_facts", "SELECT pool, 4 AS epochs, 48 AS n_scores, true AS falls, true AS in_range FROM (VALUES ('mean'), ('maxpool')) t(pool)")
def m17_facts(spark, d):
    """What holds for every training: a score for each epoch, partition and average, all between 0 and 1, and a loss that falls from the first epoch to the last."""
    rows = m17(spark, d)
    return rows.groupBy("pool").agg(F.countDistinct("epoch").cast("int").alias("epochs"), F.count("*").alias("n_scores"), (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("falls"), F.min(F.col("f1").between(0, 1)).alias("in_range"))


def unsupervised(spark, d, pools, epochs: int = 3):
    """Rows (pool, epoch, loss, mrr) of a training on walks for each pool, epoch 0 being the weights to begin with; the supports, the models and their weights."""
    adj, any_pool, out = fx.circles(spark, d), sage.Model(64), []
    known = store(sage.supports(fx.feat(spark, d), adj, plain(spark, d), any_pool, seed=3))  # the same for every pool
    steps = adj.select(F.col("node").alias("src"), F.col("nbr").alias("dst")).distinct()
    pairs = graph.random_walks(fx.feat(spark, d).select("gid"), steps, walks=2, length=2, seed=1).select("node", "ctx").distinct()
    degrees = steps.groupBy(F.col("dst").alias("gid")).agg(F.count("*").alias("degree"))
    written = sage.paired(pairs, known, degrees, epochs=epochs, size=512)
    models = {pool: sage.Model(64, pool) for pool in pools}
    weights = at_once(lambda pool: sage.fit_pairs(written, models[pool], rate=0.05, each=lambda epoch, loss, mrr, _: out.append((pool, epoch, loss, mrr))), pools)
    return spark.createDataFrame(sorted(out), "pool string, epoch int, loss double, mrr double"), known, models, dict(zip(pools, weights, strict=True))


@query("m12_unsupervised")
def m12_unsupervised(spark, d):
    """The embedding of every node after a training by skip-gram with negatives, mean pooling."""
    _, known, models, weights = unsupervised(spark, d, ["mean"])
    return sage.embeddings(known, models["mean"], weights["mean"])


@query("m16_unsupervised_training")
def m16_training(spark, d):
    """Loss and mean reciprocal rank after each epoch, by pooling."""
    return unsupervised(spark, d, sage.POOLS)[0]


@query("m16_facts", "SELECT pool, 4 AS epochs, true AS falls, true AS better FROM (VALUES ('gcn')) t(pool)")
def m16_facts(spark, d):
    """What holds for a training with the gcn pool: the loss falls, and the rank of true pairs is better than under the weights to begin with."""
    return unsupervised(spark, d, ["gcn"])[0].groupBy("pool").agg(F.count("*").cast("int").alias("epochs"), (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("falls"), (F.max_by("mrr", "epoch") > F.min_by("mrr", "epoch")).alias("better"))


@query("m_fits", "SELECT name, n, true AS in_range, true AS fits FROM (VALUES ('m14_graphsage'), ('m18_logreg'), ('m19_rf_nodes'), ('m21_mlp')) t(name), (SELECT count(*) AS n FROM pred) c", "pred")
def m_fits(spark, d):
    """Facts that hold for every fitted model: a probability for each node, and a loss on the training nodes below that of the mean label."""
    data = labelled(spark, d)
    models = {"m14_graphsage": m14, "m18_logreg": m18, "m19_rf_nodes": m19, "m21_mlp": m21}
    share = data.where(train()).agg(F.avg("y").alias("_share"))  # one row
    loss = lambda p: F.avg(F.when(train(), -F.log(F.greatest(F.when(F.col("y") == 1, p).otherwise(1 - p), F.lit(1e-12)))))
    fits = at_once(lambda m: m(spark, d), models.values())
    facts = [fit.crossJoin(F.broadcast(share)).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(F.col("p").between(0, 1)).alias("in_range"), (loss(F.col("p")) < loss(F.col("_share"))).alias("fits")) for name, fit in zip(models, fits, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), facts)


def circle_pairs(spark, d):
    steps = fx.circles(spark, d).select(F.col("node").alias("src"), F.col("nbr").alias("dst")).distinct()
    return graph.random_walks(fx.feat(spark, d).select("gid"), steps, walks=4, length=4, seed=1).select("node", "ctx")


@query("m13_node2vec")
def m13(spark, d):
    """Vectors of all nodes from walks, trained in three blocks."""
    return walk_vectors.walk_vectors(circle_pairs(spark, d), epochs=4, rate=0.2, blocks=3)


@query("m13_facts", "SELECT blocks, (SELECT count(*) FROM feat) AS n, true AS closer FROM (VALUES (1), (3)) t(blocks)", "feat")
def m13_facts(spark, d):
    """What holds however many blocks there are: a vector for each node, and nodes of a circle nearer to each other than to those of the next, on the average by 0.1 of cosine at least."""
    pairs, out = keep(circle_pairs(spark, d)), []
    for blocks in (1, 3):
        vectors = keep(walk_vectors.walk_vectors(pairs, epochs=4, rate=0.2, blocks=blocks))
        cos = lambda a, b: v.dot(F.col(a), F.col(b)) / (v.norm(F.col(a)) * v.norm(F.col(b)))
        tens = vectors.select("node", "vec", F.explode(F.array(F.lit(1), F.lit(12))).alias("by")).select("node", "vec", "by", (F.col("node") + F.col("by")).alias("to"))
        met = tens.join(vectors.select(F.col("node").alias("to"), F.col("vec").alias("other")), "to").where((F.col("by") == 12) | (F.col("node") % 12 != 11))
        means = met.agg(F.avg(F.when(F.col("by") == 1, cos("vec", "other"))).alias("near"), F.avg(F.when(F.col("by") == 12, cos("vec", "other"))).alias("far"))
        out.append(means.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n")))).select(F.lit(blocks).alias("blocks"), "n", (F.col("near") > F.col("far") + 0.1).alias("closer")))
    return out[0].unionByName(out[1])


@query("m13_word2vec")
def m13_word2vec(spark, d):
    walks = graph.random_walks(fx.feat(spark, d).select("gid"), fx.ring(spark, d).select(F.col("node").alias("src"), F.col("nbr").alias("dst")).distinct(), walks=2, length=4, seed=1)
    return learning.walk_embeddings(walks)


@query("g25_forest_importance")
def g25_forest(spark, d):
    return learning.importances(labelled(spark, d))


@query("g25_importance")
def g25(spark, d):
    """Of 250 extremely randomised trees."""
    return extra_trees.importances(labelled(spark, d), trees=250, depth=6, seed=11)


_ROOT = (
    "pick AS MATERIALIZED (SELECT tree, j FROM (SELECT tree, j, row_number() OVER (PARTITION BY tree ORDER BY i, j) AS rk FROM (SELECT tree, j, " + integer_sql(11, "tree", "1", "j") + " AS i FROM (SELECT unnest(range(250)) AS tree) t, (SELECT unnest(range(64)) AS j) f) q) r WHERE rk <= 8), "
    "bound AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM fpos GROUP BY pos), "
    "tried AS (SELECT p.tree, p.j, b.lo + (" + integer_sql(12, "p.tree", "1", "p.j") + " + 0.5) / 4294967296.0::DOUBLE * (b.hi - b.lo) AS threshold FROM pick p JOIN bound b ON b.pos = p.j WHERE b.lo < b.hi)"
)


@query("g25_root_splits", "SELECT t.tree AS tree, t.j AS feature, round(t.threshold, 9) AS threshold, count(*) FILTER (WHERE f.v <= t.threshold AND f.label < 5) AS left_0, count(*) FILTER (WHERE f.v <= t.threshold AND f.label >= 5) AS left_1 FROM tried t JOIN fpos f ON f.pos = t.j GROUP BY t.tree, t.j, t.threshold", "fpos", _ROOT)
def g25_root(spark, d):
    """Every split that is tried at the roots of the 250 trees, with the class counts left of it."""
    forest = extra_trees.fit(labelled(spark, d), trees=250, depth=1, seed=11)
    rows = [(t, j, round(cut, 9), *left) for t, _, j, cut, left in forest.tried]
    return spark.createDataFrame(rows, "tree long, feature long, threshold double, left_0 long, left_1 long")


@query("f24_pca")
def f24(spark, d):
    return learning.principal(fx.feat(spark, d).select("gid", "f"))


@query("x13_curriculum")
def x13(spark, d):
    return learning.curriculum(labelled(spark, d), F.col("gid") % 7 == 0, train())


def plain(spark, d):
    return fx.feat(spark, d).select("gid", "f")


@query("m05_two_layer_pool")
def m05(spark, d):
    layers = [neural.glorot(64, 32, 1), neural.glorot(32, 16, 2)]
    return neural.layered_pool(fx.ring(spark, d), plain(spark, d), layers, F.max("v"))


@query("m06_recurrent")
def m06(spark, d):
    return neural.recurrent(fx.ring(spark, d), plain(spark, d), 64)


@query("m08_hidden_pool")
def m08(spark, d):
    geometry = fx.feat(spark, d).select("gid", F.array((F.col("label") / 10).cast("double"), F.lit(1.0)).alias("g"))
    return neural.product_pool(fx.ring(spark, d), plain(spark, d), geometry, [neural.glorot(64, 16, 1)], [neural.glorot(2, 16, 2)], F.max("v"))


@query("m12_skip_gram_loss", "SELECT count(*) AS n, round(sum(ln(1 + exp(-aff))), 4) AS loss FROM (SELECT a.gid, sum(a.v * b.v) AS aff FROM fpos a JOIN ring r ON r.node = a.gid JOIN fpos b ON b.gid = r.nbr AND b.pos = a.pos GROUP BY a.gid, r.slot) t", "fpos ring")
def m12(spark, d):
    """The loss of true pairs under the present vectors: nodes and their neighbours."""
    f = plain(spark, d)
    pairs = fx.ring(spark, d).join(f.selectExpr("gid AS node", "f AS a"), "node").join(f.selectExpr("gid AS nbr", "f AS b"), "nbr")
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum(F.log1p(F.exp(-v.dot(F.col("a"), F.col("b"))))), 4).alias("loss"))


_NEAR = "SELECT p0, p1, arg_min(i, (d, i)) AS i FROM (SELECT p.gid, p.seq, p.p0, p.p1, s.i, (p.p0 - s.q0) * (p.p0 - s.q0) + (p.p1 - s.q1) * (p.p1 - s.q1) AS d FROM poly_points p, s{k} s) t GROUP BY gid, seq, p0, p1"
_ROUND = "s{n} AS MATERIALIZED (SELECT s.i AS i, coalesce(m.a, s.q0) AS q0, coalesce(m.b, s.q1) AS q1 FROM s{k} s LEFT JOIN (SELECT i, avg(p0) AS a, avg(p1) AS b FROM (" + _NEAR + ") n GROUP BY i) m ON m.i = s.i)"
_LLOYD = ", ".join(["s0 AS MATERIALIZED (SELECT i, a0 + (a1 - a0) * ((i * 0.618034) % 1) AS q0, b0 + (b1 - b0) * (i + 0.5) / 12 AS q1 FROM (SELECT unnest(range(12)) AS i) r, (SELECT min(p0) AS a0, max(p0) AS a1, min(p1) AS b0, max(p1) AS b1 FROM poly_points) b)", *(_ROUND.format(n=k + 1, k=k) for k in range(3))])


@query("x08_spread_seeds", "SELECT CAST(i AS INTEGER) AS qid, round(q0, 5) AS q0, round(q1, 5) AS q1 FROM s3", "poly_points", _LLOYD)
def x08(spark, d):
    return spatial.spread_seeds(fx.poly_points(spark, d), 12, rounds=3).select("qid", r(F.col("q0"), 5).alias("q0"), r(F.col("q1"), 5).alias("q1"))


_FOUND = (
    "h0 AS MATERIALIZED (SELECT DISTINCT gid FROM (SELECT s.i, arg_min(p.gid, (sqrt((p.p0 - s.q0) * (p.p0 - s.q0) + (p.p1 - s.q1) * (p.p1 - s.q1)), p.gid)) AS gid FROM poly_points p, s3 s GROUP BY s.i) t), "
    "h1 AS (SELECT gid FROM h0 UNION SELECT a.dst FROM real_adj a JOIN h0 ON h0.gid = a.src), h2 AS (SELECT gid FROM h1 UNION SELECT a.dst FROM real_adj a JOIN h1 ON h1.gid = a.src)"
)


@query("x09_cvt_subgraphs", "SELECT h.gid AS gid, g.y AS y FROM h2 h JOIN gnode g ON g.gid = h.gid WHERE g.y = 1", "poly_points gnode real_adj", f"{_LLOYD}, {_FOUND}")
def x09(spark, d):
    """Seeds spread over all vertices, the polyline nearest to each, what lies within two steps of those, and of that the positive nodes."""
    points, nodes = fx.poly_points(spark, d), fx.gnode(spark, d)
    seeds = spatial.spread_seeds(points, 12, rounds=3)
    near = keep(spatial.nearest(seeds, points, cell=2.0))
    reached = graph.expand(near.select("gid"), fx.real_adj(spark, d), hops=1).select("gid")
    return reached.intersect(nodes.where("y = 1").select("gid")).withColumn("y", F.lit(1))


@query("f25_neighbour_graph")
def f25_graph(spark, d):
    """The fifteen nearest vectors of each."""
    return sphere.neighbour_graph(plain(spark, d), 15)


@query("f25_recall", "SELECT count(*) AS n, 15 * count(*) AS links, true AS found FROM feat", "feat")
def f25_recall(spark, d):
    """What holds for the graph: fifteen neighbours for each vector, and at least 0.9 of the true ones of a query set (gid % 20 = 0) against all rows."""
    f = plain(spark, d)
    graph_ = keep(sphere.neighbour_graph(f, 15))
    best = sphere.searched(f.where("gid % 20 = 0"), f, 15).select("a", "b")  # the stated query set
    hit = best.join(graph_, ["a", "b"], "left").agg(F.avg(F.col("d").isNotNull().cast("double")).alias("recall"))
    sizes = graph_.agg(F.countDistinct("a").alias("n"), F.count("*").alias("links"))
    return sizes.crossJoin(F.broadcast(hit)).select("n", "links", (F.col("recall") >= 0.9).alias("found"))


@query("f25_sphere")
def f25_sphere(spark, d):
    """Every vector's place on the sphere after twenty epochs."""
    f = plain(spark, d)
    return sphere.spherical_layout(f, keep(sphere.neighbour_graph(f, 15)), epochs=20)
