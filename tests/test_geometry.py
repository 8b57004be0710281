"""Cases that can be checked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from filigree.functions import geometry as g
from filigree.functions import vectors as v
from filigree.operators import features


def line(spark, *points):
    return spark.createDataFrame([([tuple(map(float, p)) for p in points],)], "points array<struct<p0:double,p1:double>>")


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def pts():
    return F.col("points")


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        ([(1, 2)], [(1, 2), (1, 2), (1, 2)]),
        ([(0, 10), (4, 20)], [(0, 10), (15, 2), (4, 20)]),  # the midpoint of two is swapped
        ([(0, 0), (1, 5), (2, 9)], [(0, 0), (1, 5), (2, 9)]),
        ([(0, 0), (1, 5), (2, 9), (3, 3)], [(0, 0), (2, 9), (3, 3)]),
    ],
)
def test_sampling(spark, points, expected):
    assert [tuple(p) for p in value(line(spark, *points), g.sampled(pts()))] == expected


def test_lengths(spark):
    one, three = line(spark, (5, 5)), line(spark, (0, 0), (3, 4), (3, 0))
    assert value(one, g.end_to_end(pts())) == 0 and value(one, g.path_length(pts())) == 0
    assert value(three, g.end_to_end(pts())) == 3 and value(three, g.path_length(pts())) == 9
    assert value(three, g.slope(pts())) == 0 and value(line(spark, (1, 0), (1, 5)), g.slope(pts())) == 0


def test_poincare_is_a_distance_from_the_origin_by_the_known_formula(spark):
    a, b = g.point(0, 0), g.point(0.5, 0)
    assert value(line(spark, (0, 0)), g.poincare(a, b)) == pytest.approx(2 * math.atanh(0.5))


def test_histogram_of_a_single_value_widens(spark):
    rows = spark.createDataFrame([(1, 0.3)] * 3, "gid long, v double")
    r = features.histogram_moments(rows).first()
    assert r["mu"] == pytest.approx(0.35) and r["var"] == pytest.approx(0)


def test_mode_takes_the_smallest_of_equally_frequent_values(spark):
    rows = spark.createDataFrame([(1, x) for x in (1.0, 1.0, 2.0, 2.0, 5.0)], "gid long, v double")
    assert features.smallest_mode(rows).first()["mode"] == 1.0


def test_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(F.rint("x")).collect()] == [2.0, 4.0]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 4.0, 4.0])], "a array<double>, b array<double>")
    assert value(df, v.norm(F.col("a"))) == 3 and value(df, v.dot(F.col("a"), F.col("b"))) == 18 and value(df, v.euclidean(F.col("a"), F.col("b"))) == 3
    assert value(df, v.kl_divergence(F.col("a"), F.col("b"))) == pytest.approx(0, abs=1e-12)
    assert sum(value(df, v.softmax(F.col("a")))) == pytest.approx(1) and value(df, v.argmax(F.col("a"))) == 1
    assert value(df, v.cross_entropy(F.lit(0.0), F.lit(1))) == pytest.approx(math.log(2))


def test_nulls_and_empty_lines(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, None, 2.0)], "gid long, seq int, p0 double, p1 double")
    assert features.polylines(rows).select(g.path_length(pts())).first()[0] is None
    assert features.polylines(rows.limit(0)).count() == 0
