from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import line_dedup
from filigree.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines, rewrite

from .fixtures import LOWER, clashing, documents, edge_rows, empty, prose

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= 40:
                holders[key_of(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc_id is not None and len(own := holders.get(key_of(x), ())) >= 5 and doc_id != max(own)
        kept = [x for x in lines if not gone(x)]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def many_rows():
    long, short = "ä" * 40, "ä" * 39
    rows = [(r[0], r[1]) for r in edge_rows()]
    rows += [(200 + i, f"{long}\n{short}\nown {i}\n \t{long.upper().replace('Ä', 'ä')}\r") for i in range(5)]
    rows += [(300 + i, "B" * 45 + ("\n" + "c" * 50 if i < 4 else "")) for i in range(6)]
    return rows + [(305, "b" * 45)]


@pytest.mark.parametrize("filter_bytes", [64_000_000, 0])
def test_equals_brute_force(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    docs = clashing(documents(spark, [(*r, None, None, None) for r in many_rows()]))
    got = dedup_lines(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == brute(many_rows())
    assert dedup_lines(docs).columns == docs.columns


def test_deletion_undoes_insertion(spark):
    first = documents(spark, [(i, "a" * 50 + f"\n{i}", None, None, None) for i in range(6)])
    more = documents(spark, [(10 + i, "a" * 50 + "\n" + "b" * 50, None, None, None) for i in range(7)])
    index = LineIndex.create(spark)
    index.insert(first)
    before = sorted(map(tuple, rewrite(first, index).collect()))
    counts = sorted(map(tuple, index.counts().collect()))
    index.insert(more)
    assert sorted(map(tuple, index.counts().collect())) != counts
    assert all(r["text"] == str(r["doc_id"]) for r in rewrite(first, index).collect())
    index.delete(more)
    assert sorted(map(tuple, index.counts().collect())) == counts
    assert sorted(map(tuple, rewrite(first, index).collect())) == before
    index.delete(first.where(F.col("doc_id") == 5))
    assert {r["doc_id"] for r in rewrite(first, index).collect() if "aaa" in r["text"]} == {4, 5}  # document 5 is no longer in the index: 4 is the last holder, 5 isn't held


def stored(index):
    """Each shard's filter."""
    return {r["shard"]: line_dedup._loaded(r["buckets"], r["table"]) for r in index.filters().collect()}


def marks(filters):
    """The fingerprints of each shard, with the pair of buckets each may lie in."""
    out = {}
    for shard, f in filters.items():
        place, slot = np.nonzero(f.table)
        own = f.table[place, slot].astype(int)
        both = np.sort(np.stack([place, (place ^ own * 0x5BD1E995) & (f.buckets - 1)], axis=1), axis=1)
        out[shard] = sorted(map(tuple, np.column_stack([own, both]).tolist()))
    return {s: m for s, m in out.items() if m}


@pytest.mark.parametrize("shard_keys", [2, 40_000])
def test_stored_filters_follow_insertions_and_deletions(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    line = lambda c, i: chr(97 + c) * 50 + f" {i}"
    first = documents(spark, [(i, "\n".join(line(0, k) for k in range(8)), None, None, None) for i in range(6)])
    more = documents(spark, [(10 + i, "\n".join(line(1, k) for k in range(300)) + "\n" + line(0, 0), None, None, None) for i in range(7)])
    index = LineIndex.create(spark)
    index.insert(first)
    before, filters = sorted(map(tuple, index.frequent().collect())), marks(stored(index))
    assert len(before) == 8 and sum(map(len, filters.values())) == 8
    index.insert(more)  # filters that are too small are built anew
    keys = np.array([(r["h1"], r["h2"]) for r in index.frequent().collect()])
    assert len(keys) == 308
    own = stored(index)
    assert all(own[a % index.shards].contains(np.array([[a, b]]))[0] for a, b in keys)
    index.delete(more)
    assert sorted(map(tuple, index.frequent().collect())) == before
    assert {s: [m[0] for m in own] for s, own in marks(stored(index)).items()} == {s: [m[0] for m in own] for s, own in filters.items()}
    index.delete(first.where("doc_id < 2"))  # four holders are left: no longer frequent
    assert index.frequent().count() == 0 and marks(stored(index)) == {}


def test_deletion_leaves_the_filter_that_a_rebuild_gives(spark):
    first = documents(spark, [(i, "\n".join(f"{k} " + "a" * 45 for k in range(40)), None, None, None) for i in range(9)])
    more = documents(spark, [(20 + i, "\n".join(f"{k} " + "a" * 45 for k in range(30, 50)), None, None, None) for i in range(5)])
    index, other = LineIndex.create(spark), LineIndex.create(spark)
    index.insert(first)
    index.insert(more)
    index.delete(more)
    other.insert(first)
    assert index.batch == 3 and index.shards == other.shards
    assert marks(stored(index)) == marks(stored(other))


def test_insertion_without_room_changes_nothing():
    own = CuckooFilter(1)
    assert all(own.insert(1 << 20, 5) for _ in range(4)) and own.insert(1 << 20, 5) is False
    full = CuckooFilter(4)
    draw, n = np.random.default_rng(2), 0
    while True:
        before = full.table.copy()
        if not full.insert(*map(int, draw.integers(0, 1 << 62, 2))):
            break
        n += 1
    assert n > 8 and (full.table == before).all()


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    words = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, (5_000, 2), dtype=np.int64)
    own = CuckooFilter.of(words[:4_000])
    assert own.contains(words[:4_000]).all()
    assert own.contains(words[4_000:]).mean() < 0.01
    assert all(own.delete(int(a), int(b)) for a, b in words[:2_000])
    assert own.contains(words[2_000:4_000]).all()
    assert own.contains(words[:2_000]).mean() < 0.01
    assert not CuckooFilter(8).contains(words).any()


def test_very_long_text_and_empty_table(spark):
    rows = [(i, prose(3, 20_000), None, None, None) for i in range(5)]
    got = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(documents(spark, rows), counts=True).collect()}
    assert got[4] == 0 and all(got[i] > 100 for i in range(4))
    assert dedup_lines(empty(spark)).count() == 0


def test_clashing_counts_are_refused(spark):
    docs = documents(spark).withColumnRenamed("source", "n_lines")
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.dedup_lines(docs, counts=True)
    assert line_dedup.dedup_lines(docs).columns == docs.columns
