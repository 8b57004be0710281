from pyspark.sql import functions as F

from filigree.operators import learning


def rows(spark, n=300):
    return spark.range(n).select(F.col("id").alias("gid"), (F.col("id") % 2).cast("int").alias("y"), F.array((F.col("id") % 2) + F.sin("id") * 0.2, F.cos("id"), F.sin(F.col("id") * 3)).alias("f"))


def train():
    return F.col("gid") % 5 != 0


def accuracy(out, cut=0.5):
    return out.where(~train()).agg(F.avg(((F.col("p") > cut) == (F.col("y") == 1)).cast("double"))).first()[0]


def test_classifiers_on_rows_they_have_not_seen(spark):
    data = rows(spark)
    assert accuracy(learning.logistic(data, train())) > 0.95
    assert accuracy(learning.forest(data, train(), trees=10, depth=4)) > 0.95
    assert accuracy(learning.pixel_forest(data, train(), trees=10, share=0.5)) > 0.95
    assert accuracy(learning.perceptron(data, train(), 3)) > 0.95
    assert accuracy(learning.curriculum(data, F.col("gid") < 50, train())) > 0.95


def test_the_telling_feature_ranks_first(spark):
    assert learning.importances(rows(spark), trees=10).where("rank = 1").first()["idx"] == 0


def test_majority(spark):
    data = rows(spark).where("gid < 9")
    assert {r["said"] for r in learning.majority(data, F.lit(True)).collect()} == {0}


def test_rounds_read_what_was_gathered_once(spark, monkeypatch):
    """The neighbours' means are joined and grouped once, not for every fit and scoring."""
    from filigree.plans import models

    plans = []
    monkeypatch.setattr(learning, "perceptron", lambda rows, train, width, iterations=0: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), rows.select("gid", "y", F.lit(0.5).alias("p")))[1])
    assert len(models.m17_more_rounds(spark, "/root/testdata/sf0.001").collect()) == 24
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)


def test_a_perceptron_scales_features(spark):
    data = rows(spark)
    assert accuracy(learning.perceptron(data.withColumn("f", F.transform("f", lambda x: 7 + x / 1000)), train(), 3)) > 0.95


def test_a_perceptron_goes_on_where_the_optimiser_gives_up(spark, monkeypatch):
    """A fit that ends after three rounds, as MLlib's does where a line search fails, is not the end."""
    whole, given = learning.MultilayerPerceptronClassifier, []
    monkeypatch.setattr(learning, "MultilayerPerceptronClassifier", lambda maxIter, **more: (given.append(maxIter), whole(maxIter=min(maxIter, 3), **more))[1])
    out = learning.perceptron(rows(spark), train(), 3, iterations=40)
    assert accuracy(out) > 0.95
    assert given[:4] == [40, 37, 34, 31] and min(given) > 0
    given.clear()
    learning.perceptron(rows(spark), train(), 3, iterations=3)
    assert given == [3]
