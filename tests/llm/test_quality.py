import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filigree.llm import quality

from .fixtures import clashing, documents, edge_rows, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_brute_force(spark):
    rows = [(r[0], r[1], r[2], None, None) for r in edge_rows()]
    rows += [(100 + i, t, "en", None, None) for i, t in enumerate(["a b c d e a b c d e", "a a a a a a", "x\n\nx\n x\nx", "#$ <b> | a&b *%", "a b c d e f\n" * 4])]
    got = quality.judge_quality(clashing(documents(spark, rows)), spark.createDataFrame([], LABELS))
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())


@pytest.mark.parametrize("share", [0.0025, 0.05])
def test_binomial_tail(spark, share):
    pairs = [(n, k) for n in (1, 10, 300, 2_000) for k in (0, 1, 4, 60) if k <= n]
    df = spark.createDataFrame([*pairs, (0, 0)], "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), share).alias("p"))
    for n, k, p in df.collect():
        exact = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(exact if n and k < n * share else 1.0, rel=1e-9)


def test_cutoffs_need_evidence_and_keep_good_documents(spark):
    control = quality.RiskControl(share=0.2, error=0.1)
    good = [(i, prose(i, 40), "en", None, None) for i in range(200)]
    bad = [(1_000 + i, " | ".join(prose(5_000 + i, 40).split()), "en", None, None) for i in range(20)]
    few = [(2_000 + i, " | ".join(prose(9_000 + i, 40).split()), "rare", None, None) for i in range(3)]
    docs = documents(spark, good + bad + few)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 1, 0) for i in range(5)] + [(1_000, 0, 0), (2_000, 1, 0), (None, 1, 0), (3, None, 0)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, labels, control=control).collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[1_000 + i] for i in range(20))
    assert all(kept[2_000 + i] for i in range(3))  # one label proves nothing in this stratum
    stays = quality.keep_good(clashing(docs).drop("stratum"), labels, control=control)
    assert sorted(r["doc_id"] for r in stays.collect()) == sorted(i for i, k in kept.items() if k)


def test_one_test_for_all_rules_and_steps_only_up_to_the_first_that_fails(spark):
    """At most one good document in a hundred: 437 clean ones certify every step in one of four strata, 436 none; a step that rejects a good one too many ends the sequence."""
    measures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_word_lines long, base_failed boolean"
    rows, clean = [], (100, 500, 0, 0, 5, False)
    for stratum, n in (("a", 437), ("b", 436), (None, 2_000), ("d", 2_000)):
        rows += [(f"{stratum}{i}", stratum, *clean) for i in range(n)]
    rows += [(f"d-{i}", "d", 100, 1_100, 0, 0, 5, False) for i in range(60)]  # long words, in one good document of 34
    rows += [(f"a-{i}", "a", 100, 1_100, 0, 0, 5, True) for i in range(60)]  # left out: base_failed
    measured = spark.createDataFrame(rows, "doc_id string, stratum string, " + measures)
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    safe = {r["stratum"]: (r["n"], r["steps"]) for r in quality.safe_steps(measured, labels, "stratum").collect()}
    every = len(quality.STEPS)
    assert safe == {"a": (437, every), "b": (436, 0), None: (2_000, every), "d": (2_060, quality.STEPS.index(("long_words", 10.0)))}


def test_filter_keeps_columns_and_repeated_rows(spark):
    docs = clashing(documents(spark))
    kept = quality.keep_good(docs, spark.createDataFrame([], LABELS))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in edge_rows() if not brute(r[1])[5]), key=repr)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert quality.judge_quality(empty(spark), nothing).count() == 0
    assert quality.keep_good(empty(spark), nothing).count() == 0


def test_copies_of_a_labelled_document_certify_nothing(spark):
    """One good document in 500 rows is one document; rows that are judged differently count as rejected."""
    copies = [(1, prose(1, 40), "en", None, None)] * 500 + [(i, " | ".join(prose(i, 40).split()), "en", None, None) for i in range(2, 5)]
    labels = spark.createDataFrame([(1, 1, 0)] * 3, LABELS)
    judged = quality.judge_quality(documents(spark, copies), labels).collect()
    assert all(r["kept"] for r in judged)
    measures = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_word_lines long, base_failed boolean"
    rows = [(i, "a", 100, 500, 0, 0, 5, False) for i in range(437)] + [(7, "a", 100, 500, 90, 0, 5, False), (8, "a", 100, 500, 90, 0, 5, True)]
    measured = spark.createDataFrame(rows, measures)
    safe = quality.safe_steps(measured, measured.selectExpr("doc_id", "1 AS quality"), "stratum").collect()
    assert [(r["n"], r["steps"]) for r in safe] == [(437, 0)]
