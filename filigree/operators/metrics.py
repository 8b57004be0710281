"""Scores of predictions, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoffs of the sweep: 0.01 to 0.97, from integers.
CUTOFFS = range(1, 98)


def f1_sweep(pred: DataFrame, weight: Column | None = None) -> DataFrame:
    """cutoff, tp, fp, fn, tn, f1 at every cutoff: above it (strictly) counts as positive, for labels y too.

    One pass: rows are counted by how many cutoffs lie below their prediction and their label, a table of
    bounded size, and only these counts meet the cutoffs.
    """
    cuts = F.array(*(F.lit(c / 100) for c in CUTOFFS))
    below = lambda col: F.size(F.filter(cuts, lambda c: c < col))
    counted = pred.groupBy(below(F.col("p")).alias("kp"), below(F.col("y").cast("double")).alias("ky")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    each = counted.select("kp", "ky", "n", F.posexplode(cuts).alias("i", "cutoff"))
    positive, true = F.col("kp") > F.col("i"), F.col("ky") > F.col("i")
    of = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    sums = each.groupBy("cutoff").agg(of(positive & true, "tp"), of(positive & ~true, "fp"), of(~positive & true, "fn"), of(~positive & ~true, "tn"))
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return sums.withColumn("f1", f1)


def best_cutoff(sweep: DataFrame) -> DataFrame:
    """The cutoff with the largest f1, the largest of equally good ones."""
    return sweep.agg(F.max_by("cutoff", F.struct("f1", "cutoff")).alias("cutoff"), F.max("f1").alias("f1"))


def class_counts(pred: DataFrame, *by: str) -> DataFrame:
    """class, tp, fp, fn, support of 0/1 columns y and yhat, in one pass; by: columns whose values are counted apart."""
    each = pred.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("class")), F.struct(F.lit(1).alias("class")))).alias("c"), "y", "yhat").select(*by, "c.class", "y", "yhat")
    is_, said = F.col("y") == F.col("class"), F.col("yhat") == F.col("class")
    count = lambda c, name: F.count_if(c).alias(name)
    return each.groupBy(*by, "class").agg(count(is_ & said, "tp"), count(~is_ & said, "fp"), count(is_ & ~said, "fn"), count(is_, "support"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def averaged_scores(pred: DataFrame, *by: str) -> DataFrame:
    """avg_type, precision, recall, f1 for class, macro, micro and weighted averages; by: columns whose values are scored apart, those that occur."""
    per = class_counts(pred, *by).select(*by, "class", "support", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"), ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))
    s = lambda c: F.sum(c)
    one = per.groupBy(*by).agg(
        *(F.avg(c).alias(f"macro_{c}") for c in "prf"),
        *((s(F.col(c) * F.col("support")) / s("support")).alias(f"weighted_{c}") for c in "prf"),
        *(F.max(F.when(F.col("class") == 1, F.col(c))).alias(f"class_{c}") for c in "prf"),
        ratio(s("tp"), s("tp") + s("fp")).alias("micro_p"),
        ratio(s("tp"), s("tp") + s("fn")).alias("micro_r"),
        ratio(2.0 * s("tp"), 2 * s("tp") + s("fp") + s("fn")).alias("micro_f"),
    )
    rows = [F.struct(F.lit(t).alias("avg_type"), F.col(f"{t}_p").alias("precision"), F.col(f"{t}_r").alias("recall"), F.col(f"{t}_f").alias("f1")) for t in ("class", "macro", "micro", "weighted")]
    return one.select(*by, F.inline(F.array(*rows)))


def mean_iou(pred: DataFrame) -> DataFrame:
    """iou of soft predictions p with labels y."""
    both = F.sum(F.col("p") * F.col("y"))
    return pred.agg((both / (F.sum("p") + F.sum("y") - both)).alias("iou"))


def histogram(values: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n: equal bins from lo to hi, the last one closed; values outside are left out."""
    width = (hi - lo) / bins
    inside = values.where(F.col(value).between(lo, hi))
    return inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


def exponential_average(rows: DataFrame, group: str, order: str, value: str, rate: float = 0.01) -> DataFrame:
    """group, ema: s -= rate * (s - x), from the first value on; a null value makes its group's average null.

    Equal rows are counted before the shuffle, n of them being one step of (1 - rate)^n. Rows are then cut into
    ranges by group and order; within a block, a range's rows of one group, each value has its weight at the
    block's end, and only block results are folded in order.
    """
    keep_ = lambda n: F.pow(F.lit(1.0 - rate), n)
    runs = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("x")).groupBy("g", "o", "x").agg(F.count("*").alias("n"))
    cut = runs.repartitionByRange("g", "o", "x").withColumn("_block", F.spark_partition_id())
    later = cut.selectExpr("*", "coalesce(sum(n) OVER (PARTITION BY g, _block ORDER BY o DESC, x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _later")
    blocks = later.groupBy("g", "_block").agg(
        F.sum(F.col("x") * (1 - keep_(F.col("n"))) * keep_(F.col("_later"))).alias("_sum"),
        keep_(F.sum("n")).alias("_factor"),
        F.min_by(F.struct("x"), F.struct("o", "x"))["x"].alias("_first"),
        F.count_if(F.col("x").isNull()).alias("_nulls"),
    )
    ordered = blocks.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("_block", "_sum", "_factor", "_first"))).alias("_b"), F.sum("_nulls").alias("_nulls"))
    fold = F.aggregate("_b", F.get("_b", F.lit(0))["_first"], lambda s, b: s * b["_factor"] + b["_sum"])
    return ordered.select(F.col("g").alias(group), F.when(F.col("_nulls") == 0, fold).alias("ema"))
