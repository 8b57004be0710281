"""Functions of array columns as vectors, and of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp((x - top).cast("double")))
    return F.transform(powers, lambda x: x / total(powers))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def kl_divergence(p: Column, q: Column, least: float = 1e-9) -> Column:
    """Of two arrays of weights, made distributions, with nothing below ``least``."""
    as_shares = lambda a: F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(least)) / total(F.transform(a, lambda y: F.greatest(y.cast("double"), F.lit(least)))))
    return total(F.zip_with(as_shares(p), as_shares(q), lambda x, y: x * F.log(x / y)))


def cross_entropy(score: Column, label: Column) -> Column:
    """Of a logit and a 0/1 label, without overflow."""
    return F.greatest(score, F.lit(0.0)) - score * label + F.log1p(F.exp(-F.abs(score)))


def hinge(good: Column, bad: Column, margin: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), bad - good + margin)


def one_hot(y: Column) -> Column:
    """[1, 0] for class 0, [0, 1] for class 1."""
    return F.when(y == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))


def argmax(a: Column) -> Column:
    """The first place of the largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def column_cosine(a: Column, b: Column) -> Column:
    """Of n x 2 arrays, row after row: the dot product of their second columns over the norms of the whole arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    second = F.aggregate(F.filter(products, lambda x, i: i % 2 == 1), F.lit(0.0), lambda s, x: s + x)
    return second / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
