import math
import re
import zlib

import numpy as np

from filigree.llm import toxicity
from filigree.llm.toxicity import Fit, score_toxicity, train

from .fixtures import LOWER, clashing, documents, edge_rows, empty, prose

LABELS = "doc_id long, quality int, toxic int"
BAD = ["scumbag", "vilewort", "trashling"]


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(i, 60), i % 5 == 0
        if toxic:
            sentences = text.split(". ")
            at = i % len(sentences)
            sentences[at] = sentences[at] + f" you {BAD[i % 3]}{'s' * (i % 2)}"
            text = ". ".join(sentences)
        rows.append((i, text, "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_labels_and_offending_sentences(spark):
    rows, labels = corpus()
    docs, truth = clashing(documents(spark, rows)), {i: t for i, _, t in labels}
    got = score_toxicity(docs, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in got:
        if r["predicted"] and truth[r["doc_id"]]:
            found = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["offending"]]
            assert any(b in s for b in BAD for s in found)


def test_held_out_rows_are_never_learnt_from(spark):
    rows, labels = corpus(100)
    sample, _ = toxicity.training_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), Fit())
    ids = [r["id"] for r in sample.collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    small, _ = toxicity.training_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), Fit(documents=7))
    assert small.count() <= 14


def test_sample_is_bounded_where_many_rows_share_an_id(spark):
    rows, labels = corpus(50)
    many = documents(spark, rows + [(7, prose(9_000 + i, 10), "en", "a", 1) for i in range(300)])
    sample, _ = toxicity.training_sample(many, spark.createDataFrame(labels, LABELS), Fit())
    ids = [r["id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids


def test_scores_equal_brute_force(spark):
    """The noisy-or of sentences over words and their beginnings, recomputed from the fitted weights."""
    rows, labels = corpus(120)
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    sample, sizes = toxicity.training_sample(docs, labels, Fit())
    model = toxicity.fitted(sample, sizes, Fit())
    for r in score_toxicity(docs, labels).collect():
        none = 1.0
        for sentence in re.split(r"[.!?\n]+", dict((i, t) for i, t, *_ in rows)[r["doc_id"]]):
            words = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence.translate(LOWER))}
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + b"*" for n in (3, 4, 5, 6) if len(w) > n)])
            none *= 1 - 1 / (1 + math.exp(-z))
        assert abs(r["score"] - (1 - none)) < 1e-9


def test_noisy_or_gradient_prefers_the_word_that_only_toxic_bags_share():
    texts = [b"a b c. d e bad" if i % 2 else b"a b c. d e fine" for i in range(60)]
    model = train(texts, np.array([i % 2 for i in range(60)]), {0: 30, 1: 30})
    assert max(model.weights, key=model.weights.get) == b"bad"


def test_edge_rows(spark):
    rows, labels = corpus(60)
    got = score_toxicity(documents(spark, rows + [(r[0] if r[0] is None else 1_000 + r[0], *r[1:]) for r in edge_rows()]), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 60 + len(edge_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1_001]["score"] == by_id[1_002]["score"] and by_id[1_001]["n_sentences"] == 1
    assert by_id[None]["held_out"] is False


def test_without_labels_and_without_documents(spark):
    nothing = spark.createDataFrame([], LABELS)
    assert all(r["score"] < 0.01 for r in score_toxicity(documents(spark, corpus(10)[0]), nothing).collect())
    assert score_toxicity(empty(spark), nothing).count() == 0


def test_places_of_many_sentences_take_linear_time():
    import time

    import numpy as np

    text = ("é bad. " * 60_000).encode()
    scores = np.ones(60_001)
    began = time.perf_counter()
    spans = toxicity.offending(text, scores, 0.5)
    assert time.perf_counter() - began < 3
    decoded = text.decode()
    assert len(spans) == 60_001 and all(decoded[s["start"] : s["end"]].strip() in ("é bad", "") for s in spans[::997])
