"""Sharding by a hierarchical weighted hash tree.

A row goes down from regions to racks to shards. At each level every child draws -ln(u) / weight,
with u from a hash of the row's key and the child's name, and the least draw wins. A child whose
weight grows only wins rows, so a change moves rows into or out of the subtrees whose weights change
and nowhere else. New capacity joins as a subtree of its own under the root: its one shard then takes
rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows that one task numbers at a time, about.
SLOT_ROWS = 200_000


@dataclass(frozen=True)
class Tree:
    """regions[i][j] holds the weights of the shards of rack j of region i; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
        """Shards of weight 1; full regions first, then a region for those left."""
        full, left = divmod(shards, per_rack * racks)
        regions = [((1.0,) * per_rack,) * racks] * full
        if left:
            regions.append(tuple((1.0,) * min(per_rack, left - at) for at in range(0, left, per_rack)))
        return cls(tuple(regions))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a new region."""
        return Tree((*self.regions, ((weight,),)))

    def reweighted(self, region: int, rack: int, shard: int, weight: float) -> Tree:
        racks = list(map(list, self.regions[region]))
        racks[rack][shard] = weight
        regions = list(self.regions)
        regions[region] = tuple(map(tuple, racks))
        return Tree(tuple(regions))


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 52 bits of a digest of the child's name and the key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(name + ":"), key)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    return -F.log(u) / weight


def _least(draws: list[Column]) -> Column:
    """The place of the least draw, the first of equal ones."""
    return F.array_min(F.array(*(F.struct(d.alias("draw"), F.lit(i).alias("at")) for i, d in enumerate(draws))))["at"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key (string)."""
    first, regions = 0, []
    for i, racks in enumerate(tree.regions):
        inner = []
        for j, shards in enumerate(racks):
            at = _least([_draw(key, f"s{i}.{j}.{k}", w) for k, w in enumerate(shards)]) if len(shards) > 1 else F.lit(0)
            inner.append(at + first)
            first += len(shards)
        at = _least([_draw(key, f"k{i}.{j}", sum(shards)) for j, shards in enumerate(racks)]) if len(racks) > 1 else F.lit(0)
        regions.append(_choose(at, inner))
    at = _least([_draw(key, f"r{i}", sum(map(sum, racks))) for i, racks in enumerate(tree.regions)])
    return _choose(at, regions).cast("int")


def _choose(at: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i, option in reversed(list(enumerate(options[:-1]))):
        out = F.when(at == i, option).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Tree, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's shard and its place there.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ("key"), shard, slot (from 0,
    without gaps in a shard) and grown_shard (with one more shard). Id and tree decide the shard, so
    copies of an id stay together. A null text has no bytes and the crc32 of an empty text; null ids
    share a shard; repeated rows get a slot each; other columns are not read; an empty table gives an
    empty result.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), key.alias("_key"))
    rows = rows.select("doc_id", "size", "text_crc32", place(F.col("_key"), tree).alias("shard"), place(F.col("_key"), tree.grown()).alias("grown_shard"))
    rows = cut(rows)
    # A shard is numbered in buckets: each bucket by itself, from the number of rows in the buckets before it.
    buckets = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.selectExpr("shard", "_bucket", "sum(_n) OVER (PARTITION BY shard ORDER BY _bucket) - _n AS _first")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, _bucket ORDER BY doc_id, text_crc32, size) - 1 AS _at")
    out = numbered.join(before, ["shard", "_bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_first")).cast("long").alias("slot"), "grown_shard")
