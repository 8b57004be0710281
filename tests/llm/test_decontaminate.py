import re
from collections import defaultdict

import pytest

from filigree.llm import decontaminate

from .fixtures import LOWER, clashing, documents, edge_rows, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    owners = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        if item is not None and size:
            for i in range(len(w) - size + 1):
                owners[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in owners}:
            for i in range(len(w) - size + 1):
                if own := owners.get(tuple(w[i : i + size])):
                    found |= own
                    hit.update(range(i, i + size))
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def items():
    return [(1, " ".join(prose(1, 160).split()[20:45])), (2, "Shared by MANY documents"), (3, None), (None, "a text"), (4, ""), (5, "?!"), (6, prose(2, 30_000)[9_000:9_900]), (6, "without an id"), (70, "istanbul"), (8, "aa " * 12)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_brute_force(spark, block_bytes):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(99, "aa " * 40)]
    docs = documents(spark, [(a, b, None, None, None) for a, b in rows])
    found = decontaminate.find_contamination(clashing(docs), spark.createDataFrame(items(), ITEMS), block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found.collect()), key=repr)
    assert got == brute(rows, items())
    assert all(sum(s["end"] - s["start"] for s in r["hit_spans"]) == r["n_hit"] for r in found.collect())


def test_dropping_keeps_clean_rows_whole(spark):
    docs = clashing(documents(spark))
    clean = [r[0] for r in brute([(r[0], r[1]) for r in edge_rows()], items()) if not r[5]]
    for block_bytes in (1 << 20, 200):
        kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items(), ITEMS), block_bytes=block_bytes)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_shift_table_skips(monkeypatch):
    (one,) = decontaminate.window_sets([("1", b"a b c d e f g h i j")])
    looked = []
    monkeypatch.setattr(decontaminate, "hash_words", lambda w: looked.append(1) or 0)
    one.search([b"x"] * 1_000, bytearray(1_000), set())
    assert not looked


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_contamination(empty(spark), nothing).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.find_contamination(documents(spark), nothing).collect())


def test_blocks_are_bounded_whatever_an_item_holds(spark, monkeypatch):
    """One very long item, one id with a third of the rows, and repeated rows: small blocks, and every window in some block."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 30)
    benchmark = [(1, prose(5, 3_000))] + [(2, prose(100 + i, 20)) for i in range(50)] + [(3, "the same row again and again")] * 50
    blocks = decontaminate.benchmark_blocks(spark.createDataFrame(benchmark, ITEMS), "item_id", "text", block_bytes=2_000)
    sizes = [sum(len(r["text"]) for r in b.collect()) for b in blocks]
    assert len(blocks) > 5 and max(sizes) < 8_000
    windows = {w for s in decontaminate.window_sets((r["item"], r["text"].encode()) for b in blocks for r in b.collect()) for w in s.owners}
    assert windows == {w for s in decontaminate.window_sets((str(i), t.encode()) for i, t in benchmark) for w in s.owners}
