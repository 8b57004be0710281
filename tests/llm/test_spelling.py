import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filigree.llm import spelling
from filigree.llm.spelling import WaveletTree

from .fixtures import LOWER, clashing, documents, edge_rows, empty


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    i = next((k for k in range(len(u)) if u[k] != v[k]), len(u))
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def brute_counts(rows):
    total = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def brute(counts):
    form, size = {}, {}
    for w, n in counts.items():
        around = [(-counts[v], v) for v in counts if near(w, v)]
        size[w] = len(around)
        if around and -min(around)[0] >= 2 * n:
            form[w] = min(around)[1]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, size[w], counts[form[w]] if w in form else None) for w, n in counts.items()), key=repr)


def variants(n, seed, alphabet="abcdé"):
    """Words, chains of their variants and repeated letters, as rows of documents."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(5, 9))) for _ in range(n)] + ["aaaaaa", "aaaaa", "aaaaaaa", "baaaaaa", "ÀÉÿÿø", "Àéÿÿø"]
    for w in list(words):
        i = draw.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + draw.choice(alphabet) + w[i:], w[:i] + draw.choice(alphabet) + w[i + 1 :]]
    return [(k, " ".join(w for w in words for _ in range(draw.randint(0, 6) ** 2 // 4)) + "\n" + draw.choice(words).upper(), "en", "a", 1) for k in range(3)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = variants(150, 1) + edge_rows() + [(500 + i, ("x" * 3_000 + "yz") + " " + "x" * 3_000 + "y", "en", "a", 1) for i in range(3)]
    expected = brute(brute_counts(rows))
    assert any(r[1] and r[2] != r[1] for r in expected) and max(r[4] for r in expected) > 3
    assert found(spelling.spelling_variants(clashing(documents(spark, rows)))) == expected


@pytest.mark.parametrize("shard, cell, few", [(500_000, 1_000_000, 1_000), (300, 100, 3), (40, 20, 1)])
def test_shards_and_divided_cells_lose_nothing(spark, shard, cell, few):
    """A third of the vocabulary shares its first half, another its last."""
    draw = random.Random(4)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(5, 9))) for _ in range(200)}
    words |= {"aaaa" + "".join(draw.choice("abc") for _ in range(4)) for _ in range(60)} | {"".join(draw.choice("abc") for _ in range(4)) + "bbbb" for _ in range(60)}
    counts = {w: draw.randint(3, 40) for w in words}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    got: Counter = Counter()
    best = {}
    for word, n, form_n, form in spelling.near_words(df, shard=shard, cell=cell, few=few).collect():
        got[word] += n
        best[word] = min(best.get(word, (0, "")), (-form_n, form))
    around = {w: [(-counts[v], v) for v in counts if near(w, v)] for w in counts}
    assert got == Counter({w: len(x) for w, x in around.items() if x})
    assert best == {w: min(x) for w, x in around.items() if x}


def test_cells_stop_at_one_place():
    assert {c[:3] for c in spelling.cells_of("abcdef", frozenset())} == {(6, 0, 2), (6, 2, 6), (7, 0, 3), (7, 3, 7)}

    class Every(frozenset):
        def __contains__(self, _):
            return True

    assert sorted(c[:3] for c in spelling.cells_of("abcdef", Every())) == [(6, i, i + 1) for i in range(6)] + [(7, i, i + 1) for i in range(7)]


def test_wavelet_tree_reports_exactly_the_points_inside():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 64, 500):
        y = draw.permutation(n)
        left, low = draw.integers(0, n + 1, 200), draw.integers(0, n + 1, 200)
        right, high = left + draw.integers(0, n + 1, 200).clip(0, n - left), low + draw.integers(0, n + 1, 200).clip(0, n - low)
        query, found_y = WaveletTree(y).report(left, right, low, high)
        got = sorted(zip(query.tolist(), found_y.tolist()))
        assert got == sorted((q, int(v)) for q in range(200) for v in y[left[q] : right[q]] if low[q] <= v < high[q])


def test_long_chains_of_forms(spark):
    edges = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "c")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(edges).collect()} == {f"w{i}": "w37" for i in range(37)} | {"a": "w37", "b": "c"}


def test_empty(spark):
    assert spelling.spelling_variants(empty(spark)).collect() == []
    assert spelling.spelling_variants(documents(spark, [(1, "too few words", "en", "a", 1)])).collect() == []
