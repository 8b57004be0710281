import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from filigree.llm import simhash
from filigree.llm.components import connected

from .fixtures import LOWER, clashing, documents, edge_rows, empty


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(fps):
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {x: root(x) for x in fps}


def clustered(n, seed=1):
    """Random fingerprints, chains of copies with 1 to 6 flipped bits, and one crowded ball."""
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)

    def flip(x, k):
        for bit in draw.choice(64, k, replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        return x

    out = [*base, *(flip(base[i], 1 + i % 6) for i in range(n)), *(flip(base[0], int(draw.integers(1, 5))) for _ in range(n))]
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("sizes", [(4_096, 50_000, 400_000), (60, 40, 90)])
def test_links_connect_exactly_what_brute_force_connects(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD", "PIECE", "QUERY_PIECE"), sizes, strict=True):
        monkeypatch.setattr(simhash, name, size)
    fps = clustered(200)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    got = {r["u"]: r["v"] for r in connected(simhash.links(df)).collect()}
    own = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    expected = brute_classes([int(x) for x in fps])
    assert len({*zip(own, (expected[int(x)] for x in fps), strict=True)}) == len(set(own)) == len(set(expected.values()))


@pytest.mark.parametrize("n", [1, 1 << 26, 1 << 35])
def test_masks_leave_one_flip_at_most(n):
    chosen = simhash.masks(n)
    draw = np.random.default_rng(n)
    for _ in range(500):
        flips = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        assert min((flips & mask).bit_count() for mask, _ in chosen) <= 1
    assert all(band & ~mask == 0 and band.bit_count() == 16 for mask, band in chosen)


def test_documents(spark):
    rows = edge_rows()
    got = simhash.near_duplicates(clashing(documents(spark)))
    fps = [brute_fingerprint(r[1]) for r in rows]
    classes, least = brute_classes(set(fps)), defaultdict(list)
    for r, fp in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[classes[fp]].append(r[0])
    expected = [(r[0], f"{fp:016x}", min(least[classes[fp]], default=None)) for r, fp in zip(rows, fps, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_one_of_each_stays(spark):
    docs = clashing(documents(spark))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sorted(ids, key=repr) == sorted([a for a, b in found if a == b or a is None], key=repr)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(40)] + [(5, 5)]
    got = {r["u"]: r["v"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101 + i: 100 for i in range(40)}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


def test_ids_with_several_texts_lose_no_class(spark):
    x, y, z = ("".join(f"{w}{i} " for i in range(40)) for w in ("alpha", "brook", "cedar"))
    fps = [simhash.fingerprint(v.encode()) for v in (x, y, z)]
    assert all((a ^ b).bit_count() > 4 for a in fps for b in fps if a != b) and len(set(fps)) == 3
    keep = lambda rows: sorted(map(tuple, simhash.keep_one_of_each(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "text").collect()))
    assert keep([(3, y), (5, x), (5, y), (7, x)]) == [(3, y), (5, x)]
    assert keep([(1, x), (1, y), (1, y), (2, x), (4, y), (6, z), (6, z)]) == sorted([(1, x), (1, y), (6, z)])
