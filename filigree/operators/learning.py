"""Classical models over features, as Spark ML pipelines."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(rows: DataFrame, vector: str = "f") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def weighted_rows(rows: DataFrame, label: str = "y") -> DataFrame:
    """rows with w: n / (2 n_class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))  # one row
    return rows.join(F.broadcast(n.crossJoin(total)), label).withColumn("w", F.col("_t") / (2 * F.col("_n"))).drop("_n", "_t")


def scored(model, rows: DataFrame) -> DataFrame:
    """gid, y, p: the probability of class 1."""
    return model.transform(rows).select("gid", "y", F.element_at(vector_to_array("probability"), 2).alias("p"))


def logistic(rows: DataFrame, train, iterations: int = 30, decay: float = 0.01) -> DataFrame:
    data = as_vectors(rows)
    return scored(LogisticRegression(labelCol="y", maxIter=iterations, regParam=decay).fit(data.where(train)), data)


def majority(rows: DataFrame, train) -> DataFrame:
    """The baseline: the most frequent class of the training rows, the smaller of equally frequent ones."""
    top = rows.where(train).groupBy("y").agg(F.count("*").alias("n")).agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("said"))
    return rows.select("gid", "y").crossJoin(F.broadcast(top))  # one row


def forest(rows: DataFrame, train, trees: int = 50, depth: int = 10, seed: int = 666) -> DataFrame:
    data = as_vectors(weighted_rows(rows))
    return scored(RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(data.where(train)), data)


def importances(rows: DataFrame, trees: int = 250, seed: int = 666) -> DataFrame:
    """idx, importance, rank of each feature, largest first."""
    model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=5, seed=seed).fit(as_vectors(rows))
    found = [(i, float(x)) for i, x in enumerate(model.featureImportances.toArray())]  # one number a feature
    return rows.sparkSession.createDataFrame(found, "idx int, importance double").selectExpr("idx", "importance", "row_number() OVER (ORDER BY importance DESC, idx) AS rank")


def pixel_forest(rows: DataFrame, train, trees: int = 50, depth: int = 10, share: float = 0.05, seed: int = 666) -> DataFrame:
    """A regressor whose trees see a share of the pixels each: gid, y, p, one row a pixel."""
    data = as_vectors(rows)
    model = RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, subsamplingRate=share, seed=seed).fit(data.where(train))
    return model.transform(data).select("gid", "y", F.col("prediction").alias("p"))


def voted(pixels: DataFrame) -> DataFrame:
    """gid, y, p: the mean prediction of a polyline's pixels (gid, y, p)."""
    return pixels.groupBy("gid").agg(F.max("y").alias("y"), F.avg("p").alias("p"))


def perceptron(rows: DataFrame, train, width: int, hidden: tuple[int, ...] = (16, 8), iterations: int = 40, seed: int = 1) -> DataFrame:
    """gid, y, p: features are scaled by the training rows.

    MLlib's optimiser gives up where its line search fails, on large tables after a few rounds and near the
    mean label. The rounds that are left then go on from its weights, as long as the loss falls.
    """
    data = as_vectors(rows)
    data = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data.where(train)).transform(data).drop("features")
    seen, model, loss, left = data.where(train), None, float("inf"), iterations
    while True:
        fit = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=[width, *hidden, 2], maxIter=left, seed=seed)
        model = (fit if model is None else fit.setInitialWeights(model.weights)).fit(seen)
        told = model.summary().objectiveHistory
        left -= len(told) - 1
        if left <= 0 or not told[-1] < loss:
            return scored(model, data)
        loss = told[-1]


#: Walks that one task trains on, about.
TRAINED_WALKS = 25_000


def walk_embeddings(walks: DataFrame, size: int = 16, seed: int = 1, trained_walks: int = TRAINED_WALKS) -> DataFrame:
    """node, vec from walks (node, walk, step, ctx), each walk a sentence.

    Training is dealt over tasks by the number of walks, but MLlib holds the vocabulary, all nodes and their
    vectors, on the driver and in each task.
    """
    sentences = walks.groupBy("node", "walk").agg(F.sort_array(F.collect_list(F.struct("step", F.col("ctx").cast("string").alias("c")))).alias("s"))
    words = sentences.select(F.concat(F.array(F.col("node").cast("string")), F.transform("s", lambda x: x["c"])).alias("words"))
    tasks = -(-words.count() // trained_walks) or 1
    model = Word2Vec(vectorSize=size, minCount=1, inputCol="words", outputCol="v", seed=seed, maxIter=1, numPartitions=tasks).fit(words)
    return model.getVectors().select(F.col("word").cast("long").alias("node"), vector_to_array("vector").alias("vec"))


def principal(rows: DataFrame, k: int = 2) -> DataFrame:
    """gid and the first k principal components."""
    data = as_vectors(rows)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(data).transform(data).select("gid", vector_to_array("pc").alias("pc"))


def curriculum(rows: DataFrame, first, train, weight: float = 100.0) -> DataFrame:
    """A model that sees the rows of ``first`` with a larger weight: gid, y, p."""
    data = as_vectors(rows.withColumn("w", F.when(first, weight).otherwise(1.0)))
    return scored(LogisticRegression(labelCol="y", weightCol="w", maxIter=20, regParam=0.01).fit(data.where(train)), data)
