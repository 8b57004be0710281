"""Queries of predictions, scores, summaries of runs, ordered and top-k operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import features, metrics
from . import fixtures as fx
from .graphs import NEGATIVES, negatives
from .registry import query
from .shapes import r


@query("c01_one_hot_class", "SELECT gid, y AS by_index, CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END AS second, y AS by_argmax FROM gnode", "gnode")
def c01(spark, d):
    hot = v.one_hot(F.col("y"))
    return fx.gnode(spark, d).select("gid", F.element_at(hot, 2).cast("int").alias("by_index"), F.element_at(hot, 2).alias("second"), v.argmax(hot).alias("by_argmax"))


@query("c02_threshold", "SELECT gid, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM pred", "pred")
def c02(spark, d):
    return fx.pred(spark, d).select("gid", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("yhat"))


@query("c03_strict_threshold", "SELECT gid, p > 0.5 AS said, y > 0.5 AS truth FROM pred", "pred")
def c03(spark, d):
    return fx.pred(spark, d).select("gid", (F.col("p") > 0.5).alias("said"), (F.col("y") > 0.5).alias("truth"))


@query("c04_not_train", "SELECT gid, y FROM part_of WHERE partition <> 'train'", "part_of")
def c04(spark, d):
    return fx.part_of(spark, d).where("partition <> 'train'").select("gid", "y")


@query("c08_skip_list", "SELECT label AS gid, channel, min(v) AS min, CASE WHEN channel <> 'c1' THEN max(v) END AS max FROM (SELECT label, 'c' || (pos % 2) AS channel, v FROM fpos) t GROUP BY label, channel", "fpos")
def c08(spark, d):
    rows = fx.feat(spark, d).select(F.col("label").alias("gid"), F.posexplode("f").alias("pos", "v")).select("gid", F.concat(F.lit("c"), (F.col("pos") % 2).cast("string")).alias("channel"), F.col("v").cast("double").alias("v"))
    return features.pixel_features(rows, {k: features.PIXEL_OPS[k] for k in ("min", "max")}, skip=("c1_max",))


@query("g09_confusion", "SELECT c / 100.0 AS cutoff, CAST(sum(CASE WHEN p > c / 100.0 AND y > c / 100.0 THEN w ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p > c / 100.0 AND NOT y > c / 100.0 THEN w ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT p > c / 100.0 AND y > c / 100.0 THEN w ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT p > c / 100.0 AND NOT y > c / 100.0 THEN w ELSE 0 END) AS BIGINT) AS tn FROM (SELECT p.*, l.n AS w FROM pred p JOIN line l ON l.gid = p.gid) t, (SELECT unnest(range(1, 98)) AS c) s GROUP BY c", "pred line")
def g09(spark, d):
    length = fx.poly_points(spark, d).groupBy("gid").agg(F.count("*").alias("w"))
    return metrics.f1_sweep(fx.pred(spark, d).join(length, "gid"), F.col("w")).drop("f1")


_SWEEP = "sweep AS (SELECT c / 100.0 AS cutoff, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT c, count(*) FILTER (WHERE p > c / 100.0 AND y > c / 100.0) AS tp, count(*) FILTER (WHERE p > c / 100.0 AND NOT y > c / 100.0) AS fp, count(*) FILTER (WHERE NOT p > c / 100.0 AND y > c / 100.0) AS fn FROM pred, (SELECT unnest(range(1, 98)) AS c) s GROUP BY c) t)"


@query("g10_f1_sweep", "SELECT round(arg_max(cutoff, (f1, cutoff)), 2) AS cutoff, round(max(f1), 8) AS f1 FROM sweep", "pred", _SWEEP)
def g10(spark, d):
    best = metrics.best_cutoff(metrics.f1_sweep(fx.pred(spark, d)))
    return best.select(F.round("cutoff", 2).alias("cutoff"), F.round("f1", 8).alias("f1"))


@query("g12_opt_f1", "SELECT t, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, round(2.0 * count(*) FILTER (WHERE p >= t AND y = 1) / (count(*) FILTER (WHERE p >= t) + count(*) FILTER (WHERE y = 1)), 8) AS f1 FROM pred, (SELECT unnest([0.3, 0.4, 0.5, 0.6]) AS t) s GROUP BY t", "pred")
def g12(spark, d):
    each = fx.pred(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, (0.3, 0.4, 0.5, 0.6)))))
    said, true = F.col("p") >= F.col("t"), F.col("y") == 1
    f1 = 2.0 * F.count_if(said & true) / (F.count_if(said) + F.count_if(true))
    return each.groupBy("t").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.round(f1, 8).alias("f1"))


_PER = "per AS (SELECT c, count(*) FILTER (WHERE y = c AND h = c) AS tp, count(*) FILTER (WHERE y <> c AND h = c) AS fp, count(*) FILTER (WHERE y = c AND h <> c) AS fn, count(*) FILTER (WHERE y = c) AS s FROM (SELECT y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS h FROM pred) t, (SELECT unnest([0, 1]) AS c) k GROUP BY c), sc AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE 1.0 * tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE 1.0 * tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f FROM per)"


@query("g11_prf", "SELECT 'class' AS avg_type, round(p, 7) AS precision, round(r, 7) AS recall, round(f, 7) AS f1 FROM sc WHERE c = 1 UNION ALL SELECT 'macro', round(avg(p), 7), round(avg(r), 7), round(avg(f), 7) FROM sc UNION ALL SELECT 'micro', round(1.0 * sum(tp) / (sum(tp) + sum(fp)), 7), round(1.0 * sum(tp) / (sum(tp) + sum(fn)), 7), round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 7) FROM sc UNION ALL SELECT 'weighted', round(sum(p * s) / sum(s), 7), round(sum(r * s) / sum(s), 7), round(sum(f * s) / sum(s), 7) FROM sc", "pred", _PER)
def g11(spark, d):
    scored = metrics.averaged_scores(fx.pred(spark, d).select("y", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("yhat")))
    return scored.select("avg_type", *(F.round(c, 7).alias(c) for c in ("precision", "recall", "f1")))


@query("g18_metric_summary", "SELECT metric, avg_type, count(*) AS n, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sigma FROM run_metric GROUP BY metric, avg_type", "run_metric")
def g18(spark, d):
    return fx.run_metric(spark, d).groupBy("metric", "avg_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mu"), r(F.stddev_pop("value")).alias("sigma"))


@query("g19_histogram", "SELECT least(9, CAST(floor(value / 20.0) AS INTEGER)) AS bin, count(*) AS n FROM run_metric WHERE value BETWEEN 0 AND 200 GROUP BY 1", "run_metric")
def g19(spark, d):
    return metrics.histogram(fx.run_metric(spark, d), "value", 0.0, 200.0, 10)


@query("g22_bincount", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def g22(spark, d):
    return fx.feat(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("g23_masked_accuracy", "SELECT round(sum(ok * m) / sum(m), 8) AS accuracy, round(sum(abs(p - y) * m) / sum(m), 8) AS error FROM (SELECT p, y, CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN gid % 3 = 0 THEN 1.0 ELSE 0.0 END AS m FROM pred) t", "pred")
def g23(spark, d):
    m = F.when(F.col("gid") % 3 == 0, 1.0).otherwise(0.0)
    ok = F.when((F.col("p") > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    return fx.pred(spark, d).agg(F.round(F.sum(ok * m) / F.sum(m), 8).alias("accuracy"), F.round(F.sum(F.abs(F.col("p") - F.col("y")) * m) / F.sum(m), 8).alias("error"))


@query("g24_mean_iou", "SELECT round(sum(p * y) / (sum(p) + sum(y) - sum(p * y)), 8) AS iou FROM pred", "pred")
def g24(spark, d):
    return metrics.mean_iou(fx.pred(spark, d)).select(F.round("iou", 8).alias("iou"))


@query("g27_rollup", "SELECT metric, CAST(run AS VARCHAR) AS run, count(*) AS n, round(sum(value), 4) AS total FROM run_metric GROUP BY ROLLUP (metric, run)", "run_metric")
def g27(spark, d):
    return fx.run_metric(spark, d).rollup("metric", "run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("metric", F.col("run").cast("string").alias("run"), "n", "total")


_RANKS = "aff AS (SELECT a.gid AS gid, b.gid AS other, round(sum(a.v * b.v), 9) AS aff, b.gid = a.gid + 1 AS good FROM fpos a JOIN fpos b ON a.pos = b.pos AND (b.gid = a.gid + 1 OR b.gid IN (SELECT gid FROM neg)) GROUP BY a.gid, b.gid)"


@query("w06_mrr", "SELECT round(avg(1.0 / rk), 8) AS mrr, count(*) AS n FROM (SELECT gid, good, rank() OVER (PARTITION BY gid ORDER BY aff DESC, good) AS rk FROM aff) t WHERE good", "feat fpos", f"{NEGATIVES}, {_RANKS}")
def w06(spark, d):
    """The mean reciprocal rank of every node's true neighbour among 20 negatives. The rank is one more than the negatives that are as near or nearer."""
    f = fx.feat(spark, d)
    good = f.selectExpr("gid", "f AS fa").join(f.selectExpr("gid - 1 AS gid", "f AS fb"), "gid").select("gid", "fa", F.round(v.dot(F.col("fa"), F.col("fb")), 9).alias("true"))
    each = good.crossJoin(F.broadcast(negatives(f).selectExpr("gid AS other", "f AS fn")))  # 20 negatives
    above = (F.col("other") != F.col("gid") + 1) & (F.round(v.dot(F.col("fa"), F.col("fn")), 9) >= F.col("true"))
    ranks = each.groupBy("gid").agg((1 + F.count_if(above)).alias("rk"))
    return ranks.agg(F.round(F.avg(1.0 / F.col("rk")), 8).alias("mrr"), F.count("*").alias("n"))


@query("w07_ema", "SELECT label, n, round(first, 6) AS first FROM (SELECT label, count(*) AS n, arg_min(CAST(embedding[1] AS DOUBLE), vec_id) AS first FROM embeddings GROUP BY label) t")
def w07(spark, d):
    """With rate 0 an exponential average stays at its first value; tests hold other rates against a loop."""
    rows = fx.feat(spark, d).select("label", "gid", F.element_at("f", 1).cast("double").alias("x"))
    ema = metrics.exponential_average(rows, "label", "gid", "x", rate=0.0)
    return ema.join(rows.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", r(F.col("ema")).alias("first"))


@query("w07_ema_decay", "SELECT label, count(*) AS n, round(sum(x * pow(0.99, n - k) * CASE WHEN k = 1 THEN 1 ELSE 0.01 END), 6) + 0.0 AS ema FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) t GROUP BY label")
def w07_decay(spark, d):
    """At rate 0.01; w07_ema has rate 0, at which the first value stays."""
    rows = fx.feat(spark, d).select("label", "gid", F.element_at("f", 1).cast("double").alias("x"))
    ema = metrics.exponential_average(rows, "label", "gid", "x")
    return ema.join(rows.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", r(F.col("ema")).alias("ema"))


@query("w08_running_mean", "SELECT event_id, CAST(sum(CAST(round(value * 10000) AS BIGINT)) OVER w AS DOUBLE) / (10000.0 * count(*) OVER w) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def w08(spark, d):
    """In whole ten-thousandths, so that the order of sums does not matter."""
    return fx.table(spark, d, "events").selectExpr("event_id", "CAST(sum(CAST(round(value * 10000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (10000.0 * count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS mean")


@query("w12_group_pairs", "SELECT gid, seq // 2 AS pair, max(CASE WHEN seq % 2 = 0 THEN p0 END) AS a, max(CASE WHEN seq % 2 = 1 THEN p0 END) AS b FROM poly_points GROUP BY gid, seq // 2", "poly_points")
def w12(spark, d):
    side = lambda k: F.max(F.when(F.col("seq") % 2 == k, F.col("p0")))
    return fx.poly_points(spark, d).groupBy("gid", F.floor(F.col("seq") / 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))


@query("t01_sort_by_size", "SELECT n, min(gid) AS first, count(*) AS lines FROM line GROUP BY n ORDER BY n, first", "line")
def t01(spark, d):
    sizes = fx.poly_points(spark, d).groupBy("gid").agg(F.count("*").alias("n"))
    return sizes.groupBy("n").agg(F.min("gid").alias("first"), F.count("*").alias("lines")).orderBy("n", "first")


@query("t02_sort_runs", "SELECT CAST(run AS VARCHAR) AS run, count(*) AS n FROM run_metric GROUP BY run ORDER BY run", "run_metric")
def t02(spark, d):
    return fx.run_metric(spark, d).groupBy(F.col("run").cast("string").alias("run")).agg(F.count("*").alias("n")).orderBy("run")


@query("t03_top_ten", "SELECT gid, p FROM pred ORDER BY p DESC, gid LIMIT 10", "pred")
def t03(spark, d):
    return fx.pred(spark, d).select("gid", "p").orderBy(F.desc("p"), "gid").limit(10)


@query("t04_sigma_persistence", "SELECT sigma, persistence FROM (SELECT DISTINCT p_size % 8 + 1 AS sigma FROM part) a, (SELECT DISTINCT l_linenumber AS persistence FROM lineitem) b ORDER BY sigma, persistence")
def t04(spark, d):
    """Every blur with every persistence, in order; both are lists of a few values, taken from tables here."""
    sigmas = fx.table(spark, d, "part").select((F.col("p_size") % 8 + 1).alias("sigma")).distinct()
    persistences = fx.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("persistence")).distinct()
    return sigmas.crossJoin(F.broadcast(persistences)).orderBy("sigma", "persistence")  # line numbers


@query("t05_first_n", "SELECT vec_id AS gid, label FROM embeddings WHERE vec_id < 25")
def t05(spark, d):
    return fx.feat(spark, d).where("gid < 25").select("gid", "label")


@query("t07_string_order", "SELECT s, row_number() OVER (ORDER BY s) AS rk FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS s FROM part) t")
def t07(spark, d):
    """The order of sizes as strings; there are few different ones."""
    return fx.table(spark, d, "part").select(F.col("p_size").cast("string").alias("s")).distinct().selectExpr("s", "row_number() OVER (ORDER BY s) AS rk")


@query("a14_run_rollup", "SELECT CAST(run AS VARCHAR) AS run, metric, round(max(value), 4) AS best, round(arg_max(value, value), 4) AS last FROM run_metric GROUP BY run, metric", "run_metric")
def a14_rollup(spark, d):
    return fx.run_metric(spark, d).groupBy(F.col("run").cast("string").alias("run"), "metric").agg(F.round(F.max("value"), 4).alias("best"), F.round(F.max_by("value", "value"), 4).alias("last"))
