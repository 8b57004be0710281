"""The graph of polylines (nodes) that meet at junctions (edges)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from .keeping import keep, spread, store


def incidence(edges: DataFrame) -> DataFrame:
    """edge, node: a row for each different end of a junction."""
    return edges.select(F.col("gid").alias("edge"), F.explode(F.array_distinct(F.array("v1", "v2"))).alias("node"))


def adjacency(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """src, dst in both directions, each pair once, without loops. rows: how many edges there are at most, if known; they are spread by it."""
    pairs = edges.where("v1 <> v2").select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))
    pairs = (pairs if rows is None else spread(pairs, rows, "a", "b")).distinct()
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.inline(both))


def degrees(edges: DataFrame) -> DataFrame:
    """gid, degree: the junctions at each polyline; each row of edges is a junction, with or without an id."""
    ends = edges.select(F.explode(F.array_distinct(F.array("v1", "v2"))).alias("gid"))
    return ends.groupBy("gid").agg(F.count("*").alias("degree"))


def with_end_flags(edges: DataFrame, nodes: DataFrame, flag: str) -> DataFrame:
    """edges with f1 and f2, the flag of each end; ends without a node have null."""
    one = nodes.select(F.col("gid").alias("v1"), F.col(flag).alias("f1"))
    two = nodes.select(F.col("gid").alias("v2"), F.col(flag).alias("f2"))
    return edges.join(one, "v1", "left").join(two, "v2", "left")


def train_removed(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """edges with train_removed: whether either end is val or test."""
    flagged = with_end_flags(edges, partitions.withColumn("_out", F.col("partition").isin("val", "test")), "_out")
    return flagged.select("gid", "v1", "v2", (F.coalesce("f1", F.lit(False)) | F.coalesce("f2", F.lit(False))).alias("train_removed"))


def expand(seeds: DataFrame, adjacent: DataFrame, hops: int) -> DataFrame:
    """gid, hop: what lies within hops + 1 steps of the seeds, with the first step that reaches it.

    Each step joins only the frontier, drops what has been seen, and is kept, so that lineage stays short.
    """
    seen = keep(seeds.select("gid").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 2):
        found = frontier.join(adjacent, frontier["gid"] == adjacent["src"]).select(F.col("dst").alias("gid")).distinct()
        frontier = keep(found.join(seen, "gid", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = keep(seen.union(frontier))
    return seen


#: Neighbours of a polyline beyond which several tasks rank them.
HUB_ROWS = 100_000


def ranked_neighbours(adjacent: DataFrame, seed: int = 0) -> DataFrame:
    """src, dst, slot, degree: neighbours in an order drawn by digest.

    A hub's neighbours are ranked in 256 parts, by how their digests begin; a part goes on from the sizes of
    those before it. There are few hubs, as each has over ``HUB_ROWS`` rows, and the order is the same. The
    pairs are written once; without hubs, one pass ranks them.
    """
    adjacent = store(adjacent.select("src", "dst"), "adjacent")
    hubs = adjacent.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n") > HUB_ROWS)
    drawn = adjacent.withColumn("_key", keyed.digest(seed, F.col("src"), F.col("dst")))
    if hubs.isEmpty():
        return drawn.selectExpr("src", "dst", "CAST(row_number() OVER (PARTITION BY src ORDER BY _key, dst) - 1 AS BIGINT) AS slot", "count(*) OVER (PARTITION BY src) AS degree")
    drawn = drawn.join(hubs, "src", "left")
    parted = drawn.withColumn("_part", F.when(F.col("_n").isNotNull(), F.substring("_key", 1, 2)).otherwise(""))
    before = parted.where("_n IS NOT NULL").groupBy("src", "_part").agg(F.count("*").alias("_size")).selectExpr("src", "_part", "sum(_size) OVER (PARTITION BY src ORDER BY _part) - _size AS _before")
    ranked = parted.selectExpr("src", "dst", "_part", "row_number() OVER (PARTITION BY src, _part ORDER BY _key, dst) - 1 AS _own", "coalesce(_n, count(*) OVER (PARTITION BY src, _part)) AS degree")
    return ranked.join(before, ["src", "_part"], "left").selectExpr("src", "dst", "coalesce(_before, 0) + _own AS slot", "degree")


def first_neighbours(adjacent: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """src, dst, slot: the neighbours of slots 0 to k - 1 in the order of ``ranked_neighbours``; Spark drops the others before it shuffles."""
    drawn = adjacent.withColumn("_key", keyed.digest(seed, F.col("src"), F.col("dst")))
    first = drawn.selectExpr("src", "dst", "row_number() OVER (PARTITION BY src ORDER BY _key, dst) AS _rank").where(F.col("_rank") <= k)
    return first.selectExpr("src", "dst", "_rank - 1 AS slot")


def fixed_adjacency(nodes: DataFrame, adjacent: DataFrame, max_degree: int, sentinel: int = -1, seed: int = 0) -> DataFrame:
    """node, slot, nbr with exactly max_degree slots for each node.

    More neighbours than slots: the first by digest. Fewer: slot modulo degree. None: the sentinel.
    """
    ranked = first_neighbours(adjacent, max_degree, seed)
    slots = nodes.select(F.col("gid").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_degree - 1).cast("long"))).alias("slot"))
    degree = ranked.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "node")
    wanted = slots.join(degree, "node", "left").withColumn("at", F.when(F.col("n").isNotNull(), F.col("slot") % F.col("n")))
    picked = wanted.join(ranked.select(F.col("src").alias("node"), F.col("slot").alias("at"), "dst"), ["node", "at"], "left")
    return picked.select("node", "slot", F.coalesce("dst", F.lit(sentinel)).alias("nbr"))


def random_walks(nodes: DataFrame, adjacent: DataFrame, walks: int, length: int, seed: int = 0) -> DataFrame:
    """node, walk, step, ctx: walks from each node; steps that return to the start are left out.

    A step takes the neighbour whose place is a digest modulo the degree; every step is one join, as a
    neighbour comes with its own degree. A walk ends where there are no neighbours.
    """
    ranked = store(ranked_neighbours(adjacent, seed), "ranked")
    degree = ranked.where("slot = 0").select("src", "degree")
    onward = store(ranked.select(F.col("src").alias("cur"), "slot", "dst").join(degree.withColumnRenamed("src", "dst"), "dst", "left"), "onward")
    at = nodes.join(degree.withColumnRenamed("src", "gid"), "gid").select(F.col("gid").alias("node"), F.col("gid").alias("cur"), "degree", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    out = []
    for step in range(1, length + 1):
        drawn = at.select("node", "walk", "cur", (keyed.integer(seed, F.col("node"), F.col("walk"), F.lit(step)) % F.col("degree")).alias("slot"))
        at = store(drawn.join(onward, ["cur", "slot"]).select("node", "walk", F.col("dst").alias("cur"), "degree"), "step")
        out.append(at.where("cur <> node").select("node", "walk", F.lit(step).alias("step"), F.col("cur").alias("ctx")))
    return reduce(DataFrame.unionByName, out)


def sample_layers(roots: DataFrame, adj: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """layer, root, path, nbr: sampled supports, layer by layer; each layer takes the same slots for all nodes, drawn by digest.

    adj: node, slot, nbr.
    """
    spark = roots.sparkSession
    width = adj.agg(F.max("slot")).first()[0] + 1
    support = roots.select(F.col("gid").alias("root"), F.col("gid").alias("at"), F.lit("").alias("path"))
    out = []
    for layer, size in enumerate(sizes, 1):
        slots = spark.range(width).select(F.col("id").alias("slot")).orderBy(keyed.digest(seed, F.lit(layer), F.col("id")), "id").limit(size)
        chosen = adj.join(F.broadcast(slots), "slot")  # size rows
        step = support.join(chosen, support["at"] == chosen["node"])
        support = step.select("root", F.col("nbr").alias("at"), F.concat("path", F.lit("/"), F.col("slot").cast("string")).alias("path"))
        out.append(support.select(F.lit(layer).alias("layer"), "root", "path", F.col("at").alias("nbr")))
    return reduce(DataFrame.unionByName, out)


def sample_by_distance(adj: DataFrame, places: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """node, slot, nbr: k neighbours of each node, drawn by inverse distance: the largest of log-weights with Gumbel noise from digests.

    places: gid, at (a number).
    """
    pairs = adj.join(places.selectExpr("gid AS node", "at AS _a"), "node").join(places.selectExpr("gid AS nbr", "at AS _b"), "nbr")
    u = keyed.uniform(seed, F.col("node"), F.col("nbr"))
    scored = pairs.withColumn("_s", F.round(F.log(1 / (F.abs(F.col("_a") - F.col("_b")) + 1e-3)) - F.log(-F.log(u)), 9))
    return scored.selectExpr("node", "slot", "nbr", "row_number() OVER (PARTITION BY node ORDER BY _s DESC, slot) AS rk").where(F.col("rk") <= k).drop("rk")


def components(nodes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """gid, component: the least gid that is connected with it, by rounds of least labels and pointer jumps."""
    labels = keep(nodes.select("gid", F.col("gid").alias("component")))
    while True:
        offered = adjacent.join(labels.select(F.col("gid").alias("src"), "component"), "src").groupBy(F.col("dst").alias("gid")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "gid", "left").select("gid", "component", F.least("component", F.coalesce("offer", "component")).alias("own"))
        jumped = lower.join(labels.select(F.col("gid").alias("own"), F.col("component").alias("_up")), "own", "left")
        new = keep(jumped.select("gid", F.least("own", F.coalesce("_up", "own")).alias("next"), "component"))
        if new.where("next <> component").isEmpty():
            return labels
        labels = new.select("gid", F.col("next").alias("component"))


def followed(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys, node, next: edges (keys, node, next), one for each node and without cycles, with next moved on to where following them ends.

    Each round doubles the way that is known, so a way of n steps takes about log2(n) joins.
    """
    known = edges.select(*keys, "node", "next")
    while True:
        further = known.select(*keys, F.col("node").alias("next"), F.col("next").alias("_next"))
        step = store(known.join(further, [*keys, "next"], "left").select(*keys, "node", F.coalesce("_next", "next").alias("next"), F.col("_next").isNotNull().alias("_moved")))
        known = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return known
