"""Queries of the graph: joins, sampling, iteration, sets, splits and message passing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import keyed
from ..functions import vectors as v
from ..operators import aggregation, features, graph, named, neural, spatial, splits
from ..operators.keeping import dense_ids, keep
from ..operators.neural import patterned
from . import fixtures as fx
from .registry import query
from .shapes import r


def digest_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def integer_sql(seed: int, *keys: str) -> str:
    return f"CAST(('0x' || substr({digest_sql(seed, *keys)}, 1, 8)) AS BIGINT)"


@query("j01_incidence", "SELECT gid AS edge, v1 AS node FROM gedge UNION SELECT gid, v2 FROM gedge", "gedge")
def j01(spark, d):
    return graph.incidence(fx.gedge(spark, d))


@query("j02_adjacency", "SELECT src, dst FROM adj", "adj")
def j02(spark, d):
    return fx.adj(spark, d)


@query("g02_degree", "SELECT gid, degree, max(degree) OVER () AS max_degree FROM (SELECT v AS gid, count(DISTINCT e) AS degree FROM (SELECT gid AS e, v1 AS v FROM gedge UNION SELECT gid, v2 FROM gedge) i GROUP BY v) g", "gedge")
def g02(spark, d):
    deg = keep(graph.degrees(fx.junctions(spark, d)))
    return deg.crossJoin(F.broadcast(deg.agg(F.max("degree").alias("max_degree"))))  # one row


@query("w11_dense_ids", "SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS idx FROM gnode", "gnode")
def w11(spark, d):
    return dense_ids(fx.gnode(spark, d), "gid").select("gid", F.col("idx").cast("long").alias("idx"))


@query("j03_id_chain", "SELECT g.gid AS gid, g.y AS y, i.idx AS idx, len(f.f) AS n FROM gnode g JOIN (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS idx FROM gnode) i ON i.gid = g.gid JOIN feat f ON f.gid = g.gid", "gnode feat")
def j03(spark, d):
    nodes = fx.gnode(spark, d)
    ids = dense_ids(nodes, "gid").select("gid", F.col("idx").cast("long").alias("idx"))
    return nodes.join(ids, "gid").join(fx.feat(spark, d), "gid").select("gid", "y", "idx", F.size("f").cast("long").alias("n"))


BOX_TEST = "p.p1 BETWEEN b.x0 AND b.x1 AND p.p0 BETWEEN b.y0 AND b.y1"


@query("j04_box_select", f"SELECT partition, y, count(*) AS n FROM (SELECT g.gid, g.y, CASE WHEN g.gid IN (SELECT p.gid FROM poly_points p JOIN box b ON {BOX_TEST}) THEN 'train' ELSE 'test' END AS partition FROM gnode g) t GROUP BY partition, y", "gnode poly_points box")
def j04(spark, d):
    chosen = spatial.partition_by_boxes(fx.gnode(spark, d), fx.poly_points(spark, d), fx.box(spark))
    return chosen.groupBy("partition", "y").agg(F.count("*").alias("n"))


@query("g17_set_sizes", f"SELECT count(*) FILTER (WHERE s) AS n_train, count(*) FILTER (WHERE NOT s) AS n_test, count(*) FILTER (WHERE s AND y = 1) AS n_positive FROM (SELECT y, gid IN (SELECT p.gid FROM poly_points p JOIN box b ON {BOX_TEST}) AS s FROM gnode) t", "gnode poly_points box")
def g17(spark, d):
    t = spatial.partition_by_boxes(fx.gnode(spark, d), fx.poly_points(spark, d), fx.box(spark))
    train = F.col("partition") == "train"
    return t.agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.count_if(train & (F.col("y") == 1)).alias("n_positive"))


_MARKS = "marks AS (SELECT DISTINCT CAST(round_even(p1, 0) AS BIGINT) AS r, CAST(round_even(p0, 0) AS BIGINT) AS c FROM poly_points WHERE gid % 7 = 0)"


@query("j05_sublevel", "SELECT p.gid AS gid, count(*) AS n_points, count(m.r) AS n_hit, count(m.r) >= 0.4 * count(*) AS inside FROM poly_points p LEFT JOIN marks m ON m.r = round_even(p.p1, 0) AND m.c = round_even(p.p0, 0) GROUP BY p.gid", "poly_points", _MARKS)
def j05(spark, d):
    pts = fx.poly_points(spark, d)
    marks = pts.where("gid % 7 = 0").select(F.rint("p1").cast("long").alias("r"), F.rint("p0").cast("long").alias("c")).distinct()
    return spatial.overlap_counts(pts, marks).withColumn("inside", F.col("n_hit") >= 0.4 * F.col("n_points"))


@query("j06_sublevel_dilated", "SELECT p.gid AS gid, count(*) AS n_points, count(m.r) AS n_hit FROM poly_points p LEFT JOIN (SELECT DISTINCT r + a AS r, c + b AS c FROM marks, (SELECT unnest(range(-1, 2)) AS a) x, (SELECT unnest(range(-1, 2)) AS b) z) m ON m.r = round_even(p.p1, 0) AND m.c = round_even(p.p0, 0) GROUP BY p.gid", "poly_points", "marks AS (SELECT DISTINCT CAST(round_even(p1, 0) AS BIGINT) AS r, CAST(round_even(p0, 0) AS BIGINT) AS c FROM poly_points WHERE gid % 97 = 0)")
def j06(spark, d):
    pts = fx.poly_points(spark, d)
    marks = pts.where("gid % 97 = 0").select(F.rint("p1").cast("long").alias("r"), F.rint("p0").cast("long").alias("c")).distinct()
    return spatial.overlap_counts(pts, marks, union_radius=1)


@query("j07_nearest", "SELECT qid, arg_min(gid, (dist, gid)) AS gid, round(min(dist), 6) AS dist FROM (SELECT q.qid, p.gid, sqrt((p.p0 - q.q0) * (p.p0 - q.q0) + (p.p1 - q.q1) * (p.p1 - q.q1)) AS dist FROM poly_points p, (SELECT i AS qid, (i * 37 % 60) + 0.25 AS q0, (i * 53 % 130) + 0.5 AS q1 FROM (SELECT unnest(range(40)) AS i) s) q) t GROUP BY qid", "poly_points")
def j07(spark, d):
    i = F.col("id")
    seeds = spark.range(40).select(i.alias("qid"), (i * 37 % 60 + 0.25).alias("q0"), (i * 53 % 130 + 0.5).alias("q1"))
    return spatial.nearest(seeds, fx.poly_points(spark, d), cell=2.0).select("qid", "gid", r(F.col("dist")).alias("dist"))


_HOPS = "h0 AS (SELECT gid FROM gnode WHERE gid % 701 = 0), h1 AS (SELECT gid FROM h0 UNION SELECT a.dst FROM real_adj a JOIN h0 ON h0.gid = a.src), h2 AS (SELECT gid FROM h1 UNION SELECT a.dst FROM real_adj a JOIN h1 ON h1.gid = a.src)"


@query("j08_khop", "SELECT gid, CASE WHEN gid IN (SELECT gid FROM h0) THEN 0 WHEN gid IN (SELECT gid FROM h1) THEN 1 ELSE 2 END AS hop FROM h2", "gnode real_adj", _HOPS)
def j08(spark, d):
    return graph.expand(fx.gnode(spark, d).where("gid % 701 = 0"), fx.real_adj(spark, d), hops=1)


@query("j12_map_priors", "SELECT v AS node, count(*) AS n, min(gid) AS first, max(gid) AS last FROM (SELECT gid, v1 AS v FROM gedge UNION SELECT gid, v2 FROM gedge) t GROUP BY v", "gedge")
def j12(spark, d):
    return graph.incidence(fx.gedge(spark, d)).groupBy("node").agg(F.count("*").alias("n"), F.min("edge").alias("first"), F.max("edge").alias("last"))


@query("j13_write_back", "SELECT g.gid AS gid, round(coalesce(p.p, -1), 6) AS p, partition FROM part_of g LEFT JOIN pred p ON p.gid = g.gid", "part_of pred")
def j13(spark, d):
    return fx.part_of(spark, d).join(fx.pred(spark, d).select("gid", "p"), "gid", "left").select("gid", r(F.coalesce("p", F.lit(-1.0))).alias("p"), "partition")


@query("j14_train_removed", "SELECT e.gid AS gid, coalesce(a.partition IN ('val', 'test'), false) OR coalesce(b.partition IN ('val', 'test'), false) AS train_removed FROM gedge e LEFT JOIN part_of a ON a.gid = e.v1 LEFT JOIN part_of b ON b.gid = e.v2", "gedge part_of")
def j14(spark, d):
    return graph.train_removed(fx.gedge(spark, d), fx.part_of(spark, d)).select("gid", "train_removed")


@query("x14_edge_labels", "SELECT train_removed, count(*) AS n FROM (SELECT coalesce(a.partition IN ('val', 'test'), false) OR coalesce(b.partition IN ('val', 'test'), false) AS train_removed FROM gedge e LEFT JOIN part_of a ON a.gid = e.v1 LEFT JOIN part_of b ON b.gid = e.v2) t GROUP BY train_removed", "gedge part_of")
def x14(spark, d):
    return graph.train_removed(fx.gedge(spark, d), fx.part_of(spark, d)).groupBy("train_removed").agg(F.count("*").alias("n"))


@query("j15_gather", "SELECT r.node AS node, r.slot AS slot, f.v AS first FROM ring r JOIN fpos f ON f.gid = r.nbr AND f.pos = 0", "ring fpos")
def j15(spark, d):
    first = fx.feat(spark, d).select(F.col("gid").alias("nbr"), F.element_at("f", 1).cast("double").alias("first"))
    return fx.ring(spark, d).join(first, "nbr").select("node", F.col("slot").cast("long").alias("slot"), "first")


@query("j16_train_nodes", "SELECT gid FROM gnode WHERE gid NOT IN (SELECT gid FROM part_of WHERE partition IN ('val', 'test'))", "gnode part_of")
def j16(spark, d):
    return fx.gnode(spark, d).select("gid").join(fx.part_of(spark, d).where(F.col("partition").isin("val", "test")), "gid", "left_anti")


@query("j17_cutoff_cross", "SELECT c / 100.0 AS cutoff, count(*) FILTER (WHERE p > c / 100.0) AS n FROM pred, (SELECT unnest(range(1, 98)) AS c) t GROUP BY c", "pred")
def j17(spark, d):
    cutoffs = spark.range(1, 98).select((F.col("id") / 100).alias("cutoff"))
    return fx.pred(spark, d).crossJoin(F.broadcast(cutoffs)).groupBy("cutoff").agg(F.count_if(F.col("p") > F.col("cutoff")).alias("n"))  # 97 rows


@query("j18_box_cross", "SELECT a.box_id AS i, b.box_id AS j, a.x0 AS x0, a.x1 AS x1, b.y0 AS y0, b.y1 AS y1 FROM nation_area a, nation_area b", "nation_area")
def j18(spark, d):
    """Every x range with every y range of the nations' boxes."""
    b = keep(fx.nation_area(spark, d))
    return b.select(F.col("box_id").alias("i"), "x0", "x1").crossJoin(F.broadcast(b.select(F.col("box_id").alias("j"), "y0", "y1")))  # nations


@query("j19_box_zip", "SELECT box_id, x0, y1 FROM area", "area")
def j19(spark, d):
    """x ranges and y ranges, two lists, joined by their places."""
    b = fx.area(spark, d)
    xs, ys = (dense_ids(b.select("box_id", c), "box_id", name="place") for c in ("x0", "y1"))
    return xs.join(ys.select("place", "y1"), "place").select("box_id", "x0", "y1")


NEGATIVES = f"neg AS (SELECT gid FROM feat ORDER BY {digest_sql(5, 'gid')}, gid LIMIT 20)"


def negatives(f):
    """gid, f of 20 nodes drawn by digest, however many there are."""
    return f.orderBy(keyed.digest(5, F.col("gid")), "gid").limit(20)


@query("j20_affinities", "SELECT a.gid AS a, b.gid AS b, round(sum(a.v * b.v), 6) + 0.0 AS aff FROM fpos a JOIN fpos b ON a.pos = b.pos WHERE b.gid IN (SELECT gid FROM neg) GROUP BY a.gid, b.gid", "feat fpos", NEGATIVES)
def j20(spark, d):
    """Every node against the negatives."""
    f = fx.feat(spark, d)
    return f.selectExpr("gid AS a", "f AS fa").crossJoin(F.broadcast(negatives(f).selectExpr("gid AS b", "f AS fb"))).select("a", "b", r(v.dot(F.col("fa"), F.col("fb"))).alias("aff"))  # 20 negatives


# --- predicates on edges and nodes ------------------------------------------------------------------------


@query("c05_valid_nodes", "SELECT gid, partition FROM part_of WHERE partition IS NOT NULL AND y >= 0", "part_of")
def c05(spark, d):
    hot = v.one_hot(F.col("y"))
    return fx.part_of(spark, d).where(F.col("partition").isNotNull() & (v.total(hot) != 0)).select("gid", "partition")


@query("c06_isolated_edges", "SELECT e.gid AS gid FROM gedge e LEFT JOIN (SELECT src, count(*) AS n FROM real_adj GROUP BY src) a ON a.src = e.v1 LEFT JOIN (SELECT src, count(*) AS n FROM real_adj GROUP BY src) b ON b.src = e.v2 LEFT JOIN part_of p ON p.gid = e.v1 LEFT JOIN part_of q ON q.gid = e.v2 WHERE NOT ((coalesce(a.n, 0) = 0 OR coalesce(b.n, 0) = 0) AND coalesce(p.partition, 'train') <> 'test' AND coalesce(q.partition, 'train') <> 'test')", "gedge real_adj part_of")
def c06(spark, d):
    edges, parts = fx.gedge(spark, d), fx.part_of(spark, d).withColumn("is_test", F.col("partition") == "test")
    deg = fx.real_adj(spark, d).groupBy(F.col("src").alias("gid")).agg(F.count("*").alias("n"))
    flagged = graph.with_end_flags(graph.with_end_flags(edges, deg, "n").withColumnsRenamed({"f1": "n1", "f2": "n2"}), parts, "is_test")
    zero = (F.coalesce("n1", F.lit(0)) == 0) | (F.coalesce("n2", F.lit(0)) == 0)
    out = zero & ~F.coalesce("f1", F.lit(False)) & ~F.coalesce("f2", F.lit(False))
    return flagged.where(~out).select("gid")


@query("c07_prune_context", "SELECT src, dst FROM real_adj WHERE dst IN (SELECT gid FROM part_of WHERE partition = 'train')", "real_adj part_of")
def c07(spark, d):
    train = fx.part_of(spark, d).where("partition = 'train'").select(F.col("gid").alias("dst"))
    return fx.real_adj(spark, d).join(train, "dst", "left_semi").select("src", "dst")


@query("c09_ridge_arcs", "SELECT e.gid AS gid, CASE WHEN a.y = 0 OR b.y = 0 THEN false ELSE true END AS ridge FROM gedge e JOIN gnode a ON a.gid = e.v1 JOIN gnode b ON b.gid = e.v2", "gedge gnode")
def c09(spark, d):
    both = graph.with_end_flags(fx.gedge(spark, d), fx.gnode(spark, d), "y").where("f1 IS NOT NULL AND f2 IS NOT NULL")
    return both.select("gid", (~F.array_contains(F.array("f1", "f2"), F.lit(0))).alias("ridge"))


@query("c10_valid_partition", "SELECT y, count(*) > 0 AS ok FROM part_of WHERE partition = 'train' AND gid NOT IN (SELECT gid FROM part_of WHERE partition = 'val') GROUP BY y", "part_of")
def c10(spark, d):
    p = fx.part_of(spark, d)
    train = p.where("partition = 'train'").join(p.where("partition = 'val'").select("gid"), "gid", "left_anti")
    return train.groupBy("y").agg((F.count("*") > 0).alias("ok"))


@query("c12_components", "SELECT n AS size, count(*) AS n_parts FROM (SELECT component, count(*) AS n FROM (SELECT gid, gid - gid % 4 AS component FROM (SELECT gid FROM gnode UNION SELECT gid - gid % 4 FROM gnode) u) c GROUP BY component HAVING count(*) >= 2) t GROUP BY n", "gnode")
def c12(spark, d):
    """Small parts go: each node hangs on the node of its number less the remainder by four."""
    base = (F.col("gid") - F.col("gid") % 4).alias("up")
    ids = fx.gnode(spark, d).select("gid")
    nodes = ids.union(ids.select(base)).distinct()
    up = nodes.select("gid", base).where("gid <> up")
    adjacent = up.selectExpr("gid AS src", "up AS dst").union(up.selectExpr("up AS src", "gid AS dst"))
    sizes = graph.components(nodes, adjacent).groupBy("component").agg(F.count("*").alias("size")).where("size >= 2")
    return sizes.groupBy("size").agg(F.count("*").alias("n_parts"))


# --- sets ---------------------------------------------------------------------------------------------------


@query("s01_union", "SELECT gid FROM gnode WHERE y = 1 UNION SELECT gid FROM gnode WHERE gid % 3 = 0", "gnode")
def s01(spark, d):
    n = fx.gnode(spark, d)
    return n.where("y = 1").select("gid").union(n.where("gid % 3 = 0").select("gid")).distinct()


@query("s02_intersect", "SELECT gid FROM gnode WHERE y = 1 INTERSECT SELECT gid FROM gnode WHERE gid % 3 = 0", "gnode")
def s02(spark, d):
    n = fx.gnode(spark, d)
    return n.where("y = 1").select("gid").intersect(n.where("gid % 3 = 0").select("gid"))


@query("s03_difference", "SELECT gid FROM gnode EXCEPT SELECT gid FROM part_of WHERE partition IN ('val', 'test')", "gnode part_of")
def s03(spark, d):
    return fx.gnode(spark, d).select("gid").subtract(fx.part_of(spark, d).where(F.col("partition").isin("val", "test")).select("gid"))


@query("s04_union_all", "SELECT gid FROM gnode WHERE y = 1 UNION ALL SELECT gid FROM gnode WHERE gid % 3 = 0", "gnode")
def s04(spark, d):
    n = fx.gnode(spark, d)
    return n.where("y = 1").select("gid").unionAll(n.where("gid % 3 = 0").select("gid"))


@query("g26_ordered_distinct", "SELECT dst, min(src) AS first FROM real_adj GROUP BY dst", "real_adj")
def g26(spark, d):
    return fx.real_adj(spark, d).groupBy("dst").agg(F.min("src").alias("first"))


# --- splits -------------------------------------------------------------------------------------------------


@query("x10_split", "SELECT gid, CASE WHEN partition = 'val' OR gid IN (SELECT gid FROM gnode ORDER BY gid LIMIT 2) THEN 'val' ELSE partition END AS final FROM part_of", "part_of")
def x10(spark, d):
    return splits.final_split(fx.part_of(spark, d), compat=True).select("gid", "final")


@query("x10_split_union_space", "SELECT gid, CASE WHEN partition = 'val' THEN 'val' ELSE 'train' END AS final FROM part_of", "part_of")
def x10_union(spark, d):
    return splits.final_split(fx.part_of(spark, d), union_space=True).select("gid", "final")


@query("x11_informed_split", "SELECT g.gid AS gid, g.partition AS final, CASE WHEN g.gid % 7 = 0 THEN 1 ELSE 0 END AS n_sets, CASE WHEN g.gid % 7 = 0 THEN g.gid ELSE -1 END AS set_id FROM part_of g", "part_of")
def x11(spark, d):
    parts = splits.final_split(fx.part_of(spark, d))
    sets = parts.where("gid % 7 = 0").select("gid", F.col("gid").alias("_set"))
    joined = parts.join(sets, "gid", "left")
    return joined.select("gid", "final", F.when(F.col("_set").isNull(), 0).otherwise(1).alias("n_sets"), F.coalesce("_set", F.lit(-1)).alias("set_id"))


@query("x15_merge_selections", "SELECT coalesce(n.gid, o.gid) AS gid, coalesce(n.y, o.y) AS y FROM (SELECT gid, 1 - y AS y FROM gnode WHERE gid % 5 = 0) n FULL JOIN (SELECT gid, y FROM gnode WHERE gid % 3 = 0) o ON n.gid = o.gid", "gnode")
def x15(spark, d):
    n = fx.gnode(spark, d)
    return splits.merge_selections(n.where("gid % 3 = 0").select("gid", "y"), n.where("gid % 5 = 0").select("gid", (1 - F.col("y")).alias("y")))


@query("x12_batches", f"SELECT gid, (row_number() OVER (ORDER BY {digest_sql(5, 'gid')}, gid) - 1) // 100 AS batch FROM gnode", "gnode")
def x12(spark, d):
    return splits.batches(fx.gnode(spark, d), "gid", 100, seed=5).select("gid", "batch")


@query("t06_hash_split", f"SELECT partition, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS partition FROM (SELECT ({integer_sql(9, 'gid')} + 0.5) / 4294967296.0 AS u FROM gnode) t) s GROUP BY partition", "gnode")
def t06(spark, d):
    return splits.hash_split(fx.gnode(spark, d), "gid", seed=9).groupBy("partition").agg(F.count("*").alias("n"))


@query("g01_graph_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE partition = 'train') AS n_train, count(*) FILTER (WHERE partition <> 'train') AS n_test, count(*) FILTER (WHERE partition = 'train' AND y = 1) AS n_train_positive, sum(CASE WHEN partition = 'train' THEN l.n ELSE 0 END) AS train_length, sum(l.n) AS length FROM part_of g JOIN line l ON l.gid = g.gid", "part_of line")
def g01(spark, d):
    length = fx.poly_points(spark, d).groupBy("gid").agg(F.count("*").alias("len"))
    t, train = fx.part_of(spark, d).join(length, "gid"), F.col("partition") == "train"
    return t.agg(F.count("*").alias("n"), F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.count_if(train & (F.col("y") == 1)).alias("n_train_positive"), F.sum(F.when(train, F.col("len")).otherwise(0)).alias("train_length"), F.sum("len").alias("length"))


@query("g08_class_weights", "SELECT round(count(*) / (2.0 * count(*) FILTER (WHERE y = 0)), 8) AS w0, round(count(*) / (2.0 * count(*) FILTER (WHERE y = 1)), 8) AS w1 FROM gnode", "gnode")
def g08(spark, d):
    return splits.class_weights(fx.gnode(spark, d)).select(r(F.col("w0"), 8).alias("w0"), r(F.col("w1"), 8).alias("w1"))


_TAGS = "SELECT set, count(*) AS n, sum(y) AS positive FROM (SELECT 'train' AS set, y FROM part_of WHERE partition = 'train' UNION ALL SELECT 'val', y FROM part_of WHERE partition = 'val' UNION ALL SELECT 'test', y FROM part_of WHERE {test} UNION ALL SELECT 'all', y FROM part_of) t GROUP BY set"


@query("g15_partition_pairs", _TAGS.format(test="partition <> 'val'"), "part_of")
def g15(spark, d):
    return splits.tagged_sets(fx.part_of(spark, d)).groupBy("set").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


@query("g16_partition_pairs_all", _TAGS.format(test="true"), "part_of")
def g16(spark, d):
    return splits.tagged_sets(fx.part_of(spark, d), test_all=True).groupBy("set").agg(F.count("*").alias("n"), F.sum("y").alias("positive"))


@query("g20_label_tallies", "SELECT partition, y, count(*) AS n FROM part_of GROUP BY partition, y", "part_of")
def g20(spark, d):
    return fx.part_of(spark, d).groupBy("partition", "y").agg(F.count("*").alias("n"))


# --- sampling -----------------------------------------------------------------------------------------------

_RANKED = f"ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {digest_sql(3, 'src', 'dst')}, dst) - 1 AS slot, count(*) OVER (PARTITION BY src) AS degree FROM real_adj)"
_FIXED = "SELECT n.gid AS node, s.slot AS slot, coalesce(r.dst, -1) AS nbr FROM {nodes} n CROSS JOIN (SELECT unnest(range(6)) AS slot) s LEFT JOIN (SELECT src, least(max(degree), 6) AS k FROM ranked GROUP BY src) k ON k.src = n.gid LEFT JOIN ranked r ON r.src = n.gid AND r.slot = s.slot % k.k"


@query("x01_adj_train", _FIXED.format(nodes="(SELECT gid FROM part_of WHERE partition = 'train')").replace("FROM ranked GROUP", "FROM ranked GROUP"), "part_of real_adj", _RANKED.replace("FROM real_adj", "FROM (SELECT a.* FROM real_adj a JOIN part_of p ON p.gid = a.src AND p.partition = 'train' JOIN part_of q ON q.gid = a.dst AND q.partition = 'train') a"))
def x01(spark, d):
    train = fx.part_of(spark, d).where("partition = 'train'").select("gid")
    both = fx.real_adj(spark, d).join(train.withColumnRenamed("gid", "src"), "src", "left_semi").join(train.withColumnRenamed("gid", "dst"), "dst", "left_semi").select("src", "dst")
    return graph.fixed_adjacency(train, both, 6, seed=3)


@query("x02_adj_test", _FIXED.format(nodes="gnode"), "gnode real_adj", _RANKED)
def x02(spark, d):
    return graph.fixed_adjacency(fx.gnode(spark, d), fx.real_adj(spark, d), 6, seed=3)


@query("w09_first_neighbours", "SELECT src, dst, slot FROM ranked WHERE slot < 3", "real_adj", _RANKED)
def w09(spark, d):
    return graph.first_neighbours(fx.real_adj(spark, d), 3, seed=3)


_SLOTS = f"slots AS (SELECT layer, slot, row_number() OVER (PARTITION BY layer ORDER BY {digest_sql(4, 'layer', 'slot')}, slot) AS rk FROM (SELECT unnest(range(5)) AS slot) s, (SELECT unnest([1, 2]) AS layer) l)"


@query("x03_uniform_sampler", "SELECT r.node AS node, r.slot AS slot, r.nbr AS nbr FROM ring r JOIN slots s ON s.slot = r.slot AND s.layer = 1 AND s.rk <= 3", "ring", _SLOTS)
def x03(spark, d):
    rows = graph.sample_layers(fx.feat(spark, d).select("gid"), fx.ring(spark, d), [3], seed=4)
    return rows.select(F.col("root").alias("node"), F.substring("path", 2, 9).cast("long").alias("slot"), "nbr")


@query("x05_layered_sample", "SELECT 1 AS layer, f.gid AS root, a.nbr AS nbr, '/' || a.slot AS path FROM feat f JOIN ring a ON a.node = f.gid JOIN slots s ON s.slot = a.slot AND s.layer = 1 AND s.rk <= 3 UNION ALL SELECT 2, f.gid, b.nbr, '/' || a.slot || '/' || b.slot FROM feat f JOIN ring a ON a.node = f.gid JOIN slots s ON s.slot = a.slot AND s.layer = 1 AND s.rk <= 3 JOIN ring b ON b.node = a.nbr JOIN slots t ON t.slot = b.slot AND t.layer = 2 AND t.rk <= 2", "feat ring", _SLOTS)
def x05(spark, d):
    return graph.sample_layers(fx.feat(spark, d).select("gid"), fx.ring(spark, d), [3, 2], seed=4).select("layer", "root", "nbr", "path")


@query("x04_informed_sampler", f"SELECT node, slot, nbr FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(ln(w) - ln(-ln(u)), 9) DESC, slot) AS rk FROM (SELECT r.*, 1 / (abs(a.v - b.v) + 1e-3) AS w, ({integer_sql(6, 'r.node', 'r.nbr')} + 0.5) / 4294967296.0 AS u FROM ring r JOIN fpos a ON a.gid = r.node AND a.pos = 0 JOIN fpos b ON b.gid = r.nbr AND b.pos = 0) t) s WHERE rk <= 2", "ring fpos")
def x04(spark, d):
    """Two neighbours of each node, drawn by inverse distance."""
    places = fx.feat(spark, d).select("gid", F.element_at("f", 1).cast("double").alias("at"))
    return graph.sample_by_distance(fx.ring(spark, d), places, 2, seed=6)


_STEP = "w{t} AS MATERIALIZED (SELECT w.node, w.walk, r.dst AS cur FROM w{s} w JOIN ranked r ON r.src = w.cur AND r.slot = " + integer_sql(8, "w.node", "w.walk", "{t}") + " % r.degree)"
_WALKS = ", ".join([_RANKED.replace("md5(concat_ws('|', '3'", "md5(concat_ws('|', '8'").replace("ranked AS (", "ranked AS MATERIALIZED ("), "w0 AS MATERIALIZED (SELECT gid AS node, walk, gid AS cur FROM gnode, (SELECT unnest(range(2)) AS walk) k)", *(_STEP.format(t=t, s=t - 1) for t in (1, 2, 3))])


@query("x06_walks", " UNION ALL ".join(f"SELECT node, walk, {t} AS step, cur AS ctx FROM w{t} WHERE cur <> node" for t in (1, 2, 3)), "gnode real_adj", _WALKS)
def x06(spark, d):
    return graph.random_walks(fx.gnode(spark, d), fx.real_adj(spark, d), walks=2, length=3, seed=8)


_CUM = "deg AS (SELECT src AS gid, pow(count(*), 0.75) AS w FROM real_adj GROUP BY src), cum AS (SELECT gid, round(sum(w) OVER (ORDER BY gid), 6) AS hi, round(sum(w) OVER (ORDER BY gid) - w, 6) AS lo, round(sum(w) OVER (), 6) AS total FROM deg)"


@query("x07_negatives", f"SELECT i, gid FROM (SELECT i, ({integer_sql(2, 'i')} + 0.5) / 4294967296.0 AS u FROM (SELECT unnest(range(200)) AS i) s) q JOIN cum ON u * total >= lo AND u * total < hi", "real_adj", _CUM)
def x07(spark, d):
    """200 draws by degree to the power 0.75: a draw falls into the span of a node on the cumulative sum. Spans are summed by range of gid first, so no task sees all nodes."""
    deg = fx.real_adj(spark, d).groupBy(F.col("src").alias("gid")).agg(F.pow(F.count("*"), 0.75).alias("w")).withColumn("_r", F.floor(F.col("gid") / 10_000))
    before = deg.groupBy("_r").agg(F.sum("w").alias("_w")).selectExpr("_r", "sum(_w) OVER (ORDER BY _r) - _w AS _before", "sum(_w) OVER () AS total")
    cum = deg.selectExpr("*", "sum(w) OVER (PARTITION BY _r ORDER BY gid) AS _own").join(F.broadcast(before), "_r").select("gid", F.round(F.col("_before") + F.col("_own"), 6).alias("hi"), F.round(F.col("_before") + F.col("_own") - F.col("w"), 6).alias("lo"), F.round("total", 6).alias("total"))
    draws = spark.range(200).select(F.col("id").alias("i"), keyed.uniform(2, F.col("id")).alias("u"))
    return cum.join(F.broadcast(draws), (F.col("u") * F.col("total") >= F.col("lo")) & (F.col("u") * F.col("total") < F.col("hi"))).select("i", "gid")  # 200 draws


# --- message passing ----------------------------------------------------------------------------------------


def pool_sql(of: str, source: str = "SELECT r.node AS node, f.pos AS pos, f.v AS v FROM ring r JOIN fpos f ON f.gid = r.nbr") -> str:
    return f"SELECT node, pos, round({of}, 6) + 0.0 AS v FROM ({source}) m GROUP BY node, pos"


def out(df):
    return df.select("node", F.col("pos").cast("long").alias("pos"), r(F.col("v")).alias("v"))


@query("m01_mean_agg", pool_sql("avg(v)"), "ring fpos")
def m01(spark, d):
    return out(aggregation.mean(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f")))


@query("m02_gcn_agg", pool_sql("avg(v)", "SELECT r.node AS node, f.pos AS pos, f.v AS v FROM ring r JOIN fpos f ON f.gid = r.nbr UNION ALL SELECT gid, pos, v FROM fpos"), "ring fpos")
def m02(spark, d):
    return out(aggregation.graph_convolution(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f")))


@query("m03_max_pool", pool_sql("max(greatest(v, 0)) * 100"), "ring fpos")
def m03(spark, d):
    return out(aggregation.max_pool(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f"), weight=100.0))


@query("m04_mean_pool", pool_sql("avg(greatest(v, 0))"), "ring fpos")
def m04(spark, d):
    return out(aggregation.mean_pool(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f")))


_GEO = "SELECT r.node AS node, f.pos AS pos, f.v * (f.label + 1) AS v FROM ring r JOIN fpos f ON f.gid = r.nbr"


@query("m07_geto_max_pool", pool_sql("max(v)", _GEO), "ring fpos")
def m07(spark, d):
    f = fx.feat(spark, d)
    return out(aggregation.geometric_pool(fx.ring(spark, d), f.select("gid", "f"), f.select("gid", (F.col("label") + 1.0).alias("g")), F.max("v")))


@query("m07_geto_mean_pool", pool_sql("avg(v)", _GEO), "ring fpos")
def m07_mean(spark, d):
    f = fx.feat(spark, d)
    return out(aggregation.geometric_pool(fx.ring(spark, d), f.select("gid", "f"), f.select("gid", (F.col("label") + 1.0).alias("g")), F.avg("v")))


@query("m09_edge_pool", pool_sql("max(v)", "SELECT r.node AS node, f.pos AS pos, f.v * (1 / (sqrt((a.v - b.v) * (a.v - b.v) + (a2.v - b2.v) * (a2.v - b2.v)) + 1e-9)) AS v FROM ring r JOIN fpos f ON f.gid = r.nbr JOIN fpos a ON a.gid = r.node AND a.pos = 0 JOIN fpos b ON b.gid = r.nbr AND b.pos = 0 JOIN fpos a2 ON a2.gid = r.node AND a2.pos = 1 JOIN fpos b2 ON b2.gid = r.nbr AND b2.pos = 1"), "ring fpos")
def m09(spark, d):
    f = fx.feat(spark, d)
    places = f.select("gid", F.element_at("f", 1).cast("double").alias("p0"), F.element_at("f", 2).cast("double").alias("p1"))
    return out(aggregation.edge_pool(fx.ring(spark, d), f.select("gid", "f"), places))


@query("m10_two_hops", "SELECT n1.gid AS gid, len(f.f) * 3 AS n, round(n2.v, 6) + 0.0 AS last FROM feat f JOIN (SELECT node AS gid, avg(v) AS v FROM (SELECT r.node AS node, f.v AS v FROM ring r JOIN fpos f ON f.gid = r.nbr AND f.pos = 63) a GROUP BY node) n1 ON n1.gid = f.gid JOIN (SELECT r.node AS gid, avg(m.v) AS v FROM ring r JOIN (SELECT r.node AS node, avg(f.v) AS v FROM ring r JOIN fpos f ON f.gid = r.nbr AND f.pos = 63 GROUP BY r.node) m ON m.node = r.nbr GROUP BY r.node) n2 ON n2.gid = f.gid", "feat ring fpos")
def m10(spark, d):
    rows = aggregation.propagate(fx.ring(spark, d), fx.feat(spark, d).select("gid", "f"), "mean", hops=2)
    return rows.select("gid", F.size("f").cast("long").alias("n"), r(F.element_at("f", -1)).alias("last"))


# --- with weights: by a rule, so that SQL has the same ------------------------------------------------------


def weight_sql(i: str, j: str, seed: int) -> str:
    """neural.patterned in SQL."""
    return f"((({i} * 31 + {j} * 17 + {seed} * 7) % 13 - 6) / 8.0)"


def times_sql(source: str, columns: int, seed: int, rectify: bool = False) -> str:
    """node, pos, v of source times weights, from (node, pos, v)."""
    total = f"sum(s.v * {weight_sql('s.pos', 'j.j', seed)})"
    return f"SELECT s.node AS node, j.j AS pos, {f'greatest({total}, 0)' if rectify else total} AS v FROM ({source}) s, (SELECT unnest(range({columns})) AS j) j GROUP BY s.node, j.j"


_OWN = "SELECT gid AS node, pos, v FROM fpos"


def around_sql(of: str, source: str) -> str:
    """node, pos, v: of over the neighbours' values in source."""
    return f"SELECT r.node AS node, s.pos AS pos, {of} AS v FROM ring r JOIN ({source}) s ON s.node = r.nbr GROUP BY r.node, s.pos"


def weighted_sql(around: str, concat: bool = False) -> str:
    own, other = times_sql(_OWN, 8, 1), times_sql(around, 8, 2)
    if concat:
        return f"SELECT node, pos, round(greatest(v, 0), 6) + 0.0 AS v FROM ({own} UNION ALL SELECT node, pos + 8, v FROM ({other}) o) t"
    return f"SELECT a.node AS node, a.pos AS pos, round(greatest(a.v + b.v, 0), 6) + 0.0 AS v FROM ({own}) a JOIN ({other}) b ON b.node = a.node AND b.pos = a.pos"


def by_position(arrays):
    return out(arrays.select(F.col("gid").alias("node"), F.posexplode("f").alias("pos", "v")))


def vectors_of(spark, d):
    return fx.feat(spark, d).select("gid", "f")


_SELF_TOO = f"SELECT node, pos, avg(v) AS v FROM (SELECT r.node AS node, f.pos AS pos, f.v AS v FROM ring r JOIN fpos f ON f.gid = r.nbr UNION ALL {_OWN}) t GROUP BY node, pos"


@query("m01_mean_weights", weighted_sql(around_sql("avg(s.v)", _OWN), concat=True), "ring fpos")
def m01_weights(spark, d):
    f = vectors_of(spark, d)
    return by_position(neural.with_weights(f, aggregation.mean(fx.ring(spark, d), f), patterned(64, 8, 1), patterned(64, 8, 2), concat=True))


@query("m02_gcn_weights", f"SELECT node, pos, round(v, 6) + 0.0 AS v FROM ({times_sql(_SELF_TOO, 8, 2, rectify=True)}) t", "ring fpos")
def m02_weights(spark, d):
    """The mean over neighbours and the node itself has one weight matrix."""
    arrays = neural.as_arrays(aggregation.graph_convolution(fx.ring(spark, d), vectors_of(spark, d)))
    return by_position(arrays.select("gid", neural.dense(F.col("f"), [patterned(64, 8, 2)]).alias("f")))


@query("m03_max_pool_weights", weighted_sql(around_sql("max(s.v)", times_sql(_OWN, 16, 3, rectify=True)), concat=True), "ring fpos")
def m03_weights(spark, d):
    f = vectors_of(spark, d)
    rows = neural.layered_pool(fx.ring(spark, d), f, [patterned(64, 16, 3)], F.max("v"))
    return by_position(neural.with_weights(f, rows, patterned(64, 8, 1), patterned(16, 8, 2), concat=True))


@query("m04_mean_pool_weights", weighted_sql(around_sql("avg(s.v)", times_sql(_OWN, 16, 3, rectify=True))), "ring fpos")
def m04_weights(spark, d):
    f = vectors_of(spark, d)
    rows = neural.layered_pool(fx.ring(spark, d), f, [patterned(64, 16, 3)], F.avg("v"))
    return by_position(neural.with_weights(f, rows, patterned(64, 8, 1), patterned(16, 8, 2)))


@query("m05_two_layer_weights", pool_sql("max(v)", f"SELECT r.node AS node, s.pos AS pos, s.v AS v FROM ring r JOIN ({times_sql(times_sql(_OWN, 32, 1, rectify=True), 16, 2, rectify=True)}) s ON s.node = r.nbr"), "ring fpos")
def m05_weights(spark, d):
    return out(neural.layered_pool(fx.ring(spark, d), vectors_of(spark, d), [patterned(64, 32, 1), patterned(32, 16, 2)], F.max("v")))


_INNER = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in patterned(8, 32, 6)) + "]"
_GATE = "(x.w[{j}] + list_sum(list_transform(range(1, 9), lambda k: s.h[k] * u.u[k][{j}])))"
_LSTM = (
    f"u AS (SELECT {_INNER} AS u), "
    f"w AS (SELECT r.node AS node, r.slot AS slot, list(p.v ORDER BY p.pos) AS w FROM ring r JOIN ({times_sql(_OWN, 32, 5)}) p ON p.node = r.nbr GROUP BY r.node, r.slot), "
    "st AS (SELECT gid AS node, 0 AS step, list_transform(range(8), lambda k: CAST(0 AS DOUBLE)) AS h, list_transform(range(8), lambda k: CAST(0 AS DOUBLE)) AS c FROM feat "
    "UNION ALL SELECT /*step*/ node, step, list_transform(range(1, 9), lambda k: tanh(c[k]) / (1 + exp(-g[16 + k]))) AS h, c FROM "
    "(SELECT node, step, g, list_transform(range(1, 9), lambda k: c[k] / (1 + exp(-g[8 + k])) + tanh(g[24 + k]) / (1 + exp(-g[k]))) AS c FROM "
    f"(SELECT s.node AS node, s.step + 1 AS step, s.c AS c, list_transform(range(1, 33), lambda j: {_GATE.format(j='j')}) AS g FROM st s JOIN w x ON x.node = s.node AND x.slot = s.step, u) a) b)"
)


@query("m06_recurrent_weights", "SELECT node, unnest(range(8)) AS pos, round(unnest(h), 6) + 0.0 AS v FROM st WHERE step = 5", "ring feat fpos", _LSTM)
def m06_weights(spark, d):
    state = neural.recurrent(fx.ring(spark, d), vectors_of(spark, d), 64, 8, weights=patterned(64, 32, 5), inner=patterned(8, 32, 6))
    return out(state.select("node", F.posexplode("h").alias("pos", "v")))


_GEOMETRY = "SELECT gid AS node, 0 AS pos, label / 10.0 AS v FROM feat UNION ALL SELECT gid, 1, 1.0 FROM feat"


def geometry_of(spark, d):
    return fx.feat(spark, d).select("gid", F.array((F.col("label") / 10).cast("double"), F.lit(1.0)).alias("g"))


@query("m08_hidden_weights", pool_sql("max(v)", f"SELECT r.node AS node, a.pos AS pos, a.v * b.v AS v FROM ring r JOIN ({times_sql(_OWN, 16, 1, rectify=True)}) a ON a.node = r.nbr JOIN ({times_sql(_GEOMETRY, 16, 2, rectify=True)}) b ON b.node = r.nbr AND b.pos = a.pos"), "ring feat fpos")
def m08_weights(spark, d):
    return out(neural.product_pool(fx.ring(spark, d), vectors_of(spark, d), geometry_of(spark, d), [patterned(64, 16, 1)], [patterned(2, 16, 2)], F.max("v")))


_HOP = around_sql("avg(s.v)", _OWN)


@query("m10_jumping_knowledge", f"SELECT o.node AS node, o.pos AS pos, round(greatest(o.v, a.v, b.v), 6) + 0.0 AS v FROM ({_OWN}) o JOIN ({_HOP}) a ON a.node = o.node AND a.pos = o.pos JOIN ({around_sql('avg(s.v)', _HOP)}) b ON b.node = o.node AND b.pos = o.pos", "ring fpos")
def m10_jumping(spark, d):
    """The largest of a node's own vector and those of one and two hops."""
    f, ring = vectors_of(spark, d), fx.ring(spark, d)
    one = neural.as_arrays(aggregation.mean(ring, f))
    return by_position(neural.largest([f, one, neural.as_arrays(aggregation.mean(ring, one))]))


def named_sql(names) -> str:
    """Each name's nodes and dimensions."""
    wide = {"mean": 64, "gcn": 64, "edge": 64, "geto-maxpool": 64, "geto-meanpool": 64}
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS nodes, {wide.get(names[n][0], named.HIDDEN)} * count(*) AS n FROM feat" for n in names)


def by_name(spark, d, names):
    """Every model's aggregator once: its nodes and rows."""
    f, ring = vectors_of(spark, d), fx.ring(spark, d)
    geometry = fx.feat(spark, d).select("gid", F.array(F.element_at("f", 1).cast("double"), F.element_at("f", 2).cast("double")).alias("g"))
    each = [named.aggregated(n, ring, f, geometry).agg(F.lit(n).alias("name"), F.count_distinct("node").alias("nodes"), F.count("*").alias("n")) for n in names]
    return reduce(lambda a, b: a.unionByName(b), each).select("name", "nodes", "n")


@query("m15_supervised_names", named_sql(named.SUPERVISED), "feat")
def m15(spark, d):
    return by_name(spark, d, named.SUPERVISED)


@query("m16_unsupervised_names", named_sql({n: p for n, p in named.UNSUPERVISED.items() if p}), "feat")
def m16(spark, d):
    """All names but n2v, which is m13_node2vec."""
    return by_name(spark, d, [n for n, p in named.UNSUPERVISED.items() if p])
