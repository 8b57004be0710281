"""Connected components of a graph given by links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """From links (u, v) to (u, v): every node but the least of its component, with that least node.

    Alternates two contractions until nothing changes: every node's larger neighbours are hung on its
    least neighbour, then every node and its smaller neighbours on the least of them. Least neighbours
    are combined before they are shuffled and joined back to the links, so no node's links are ever
    gathered in one place. Each round is kept in the shared folder.
    """
    stars = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(stars)
    while state[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    return stars
