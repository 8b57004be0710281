import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filigree.llm import exact_dedup

from .fixtures import clashing, documents, edge_rows, empty, prose


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        last = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, last, len(ids), i == last and not kept, sha))
            kept |= i == last
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    long = prose(7, 4_000)
    rows = edge_rows() + [(100 + i, long, "en", "a", 1) for i in range(5)] + [(200, long[:-1], "en", "a", 1), (201, long[:9_000] + "x" + long[9_000:], "en", "a", 1)]
    rows += [(300, "\U0001f642" * 20_000, "en", "a", 1), (301, "\U0001f642" * 20_000, "en", "a", 1), (302, "\U0001f642" * 19_999, "en", "a", 1), (None, "", "en", "a", 1), (None, "only without id", "en", "a", 1), (None, "only without id", "en", "a", 1)]
    return rows


def test_equals_brute_force(spark):
    assert found(exact_dedup.find_copies(clashing(documents(spark, cases())))) == brute(cases())


def test_chunks_are_the_text_and_an_edit_moves_few_cuts(spark):
    long = prose(7, 4_000, "aeioustrnldhgé")
    edited = long[:5_000] + " inserted " + long[5_000:]
    first, second, empty_, flat = (r[0] for r in spark.createDataFrame([(long,), (edited,), ("",), ("a" * 20_000,)], "t string").select(exact_dedup.chunks(F.col("t"))).collect())
    assert "".join(first) == long and "".join(second) == edited and empty_ == [] and [len(c) for c in flat] == [8_192, 8_192, 3_616]
    assert len(first) > 10 and all(exact_dedup.LEAST < len(c) for c in first[:-1])
    assert len(set(first) - set(second)) <= 3


@pytest.mark.parametrize("bits", [1, 6])
def test_colliding_digests_get_more(spark, bits):
    """With digests of a few bits, chunks collide until enough digests tell them apart; results stay exact."""
    weak = lambda chunk, k: F.pmod(exact_dedup.digest(chunk, k), F.lit(1 << bits))
    docs = documents(spark, cases())
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    assert exact_dedup.verified_digests(texts) == exact_dedup.DIGESTS < exact_dedup.verified_digests(texts, digest_of=weak)
    assert found(exact_dedup.find_copies(docs, digest_of=weak)) == brute(cases())


def test_drop_copies(spark, monkeypatch):
    docs = clashing(documents(spark, cases()))
    expected = sorted((r[0], r[4]) for r in brute(cases()) if r[3] and r[0] is not None)
    for bound in (exact_dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", bound)
        left = exact_dedup.drop_copies(docs)
        assert left.columns == docs.columns
        rows = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in left.collect()]
        assert len(rows) == len(set(r[4] for r in brute(cases())))
        assert sorted(r for r in rows if r[0] is not None) == expected


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "copy " * 30 if i % 3 == 0 else prose(i, 30), "en", "a", 1) for i in range(900)]
    assert found(exact_dedup.find_copies(documents(spark, rows))) == brute(rows)


def test_empty(spark):
    assert exact_dedup.find_copies(empty(spark)).collect() == []
    assert exact_dedup.drop_copies(empty(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.find_copies(documents(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
