import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filigree.llm import sharding
from filigree.llm.queries import QUERIES
from filigree.llm.sharding import Tree, assign, place

from .fixtures import clashing, documents, edge_rows, empty


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    got = assign(clashing(documents(spark)), Tree.even(24)).collect()
    expected = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in edge_rows()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 4}) == 1


def shards(spark, tree, n=6_000):
    return {r["id"]: r["at"] for r in spark.range(n).select("id", place(F.col("id").cast("string"), tree).alias("at")).collect()}


def drawn(key: str, tree: Tree) -> int:
    """The descent in plain Python: at each level the least -ln(u) / weight wins."""

    def least(children: list[tuple[str, float]]) -> int:
        draws = [-math.log((int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52) / weight for name, weight in children]
        return draws.index(min(draws))

    i = least([(f"r{i}", sum(map(sum, racks))) for i, racks in enumerate(tree.regions)])
    j = least([(f"k{i}.{j}", sum(shards)) for j, shards in enumerate(tree.regions[i])])
    k = least([(f"s{i}.{j}.{k}", w) for k, w in enumerate(tree.regions[i][j])])
    return sum(len(shards) for racks in tree.regions[:i] for shards in racks) + sum(map(len, tree.regions[i][:j])) + k


@pytest.mark.parametrize("tree", [Tree.even(24), Tree.even(24).grown(), Tree.even(13), Tree.even(24).reweighted(1, 0, 2, 3.0)])
def test_places_equal_plain_draws(spark, tree):
    assert shards(spark, tree, 400) == {i: drawn(str(i), tree) for i in range(400)}


def test_query_equals_plain_draws(spark):
    sf_dir, tree = "/root/testdata/sf0.001", Tree.even(24)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got, slots = QUERIES["op6_sharding"](spark, sf_dir).collect(), defaultdict(list)
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), drawn(str(r["doc_id"]), tree), drawn(str(r["doc_id"]), tree.grown()))
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_weights_fill_evenly_and_growth_moves_rows_into_the_new_shard_only(spark):
    tree = Tree.even(24)
    assert [len(r) for r in tree.regions] == [2, 2, 2]
    before, after = shards(spark, tree), shards(spark, tree.grown())
    counts = Counter(before.values())
    assert sorted(counts) == list(range(24)) and max(counts.values()) < 1.35 * 250 and min(counts.values()) > 0.7 * 250
    moved = [i for i in before if before[i] != after[i]]
    assert {after[i] for i in moved} == {24} and 0.5 * 240 < len(moved) < 1.5 * 240


def test_new_weights_move_rows_only_into_or_out_of_the_changed_subtree(spark):
    tree = Tree.even(24)
    before, after = shards(spark, tree), shards(spark, tree.reweighted(1, 0, 2, 3.0))
    region = set(range(8, 16))
    assert all(after[i] in region for i in before if before[i] != after[i])
    assert Counter(after.values())[10] > 2 * Counter(before.values())[10]
    lighter = shards(spark, tree.reweighted(1, 0, 2, 0.2))
    assert all(before[i] in region for i in before if before[i] != lighter[i])


def test_odd_trees_and_empty_table(spark):
    assert set(shards(spark, Tree.even(1), 50).values()) == {0}
    assert sorted(set(shards(spark, Tree.even(13), 3_000).values())) == list(range(13))
    assert assign(empty(spark), Tree.even(24)).count() == 0
