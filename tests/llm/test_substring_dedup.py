import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from filigree.llm import substring_dedup
from filigree.llm.substring_dedup import Suffixes, anchors, remove_repeats, repeated_starts

from .fixtures import clashing, documents, edge_rows, empty

L, P = substring_dedup.LENGTH, substring_dedup.PASSAGE


def brute(texts):
    strings = [[t[p : p + L] for p in range(len(t) - L + 1)] for t in texts]
    seen = Counter(s for own in strings for s in own)
    out = []
    for t, own in zip(texts, strings, strict=True):
        covered = bytearray(len(t))
        for p, s in enumerate(own):
            if seen[s] > 1:
                covered[p : p + L] = b"\1" * L
        kept = bytes(c for c, v in zip(t, covered, strict=True) if not v)
        out.append((len(t), sum(covered), len([r for r in bytes(covered).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def brute_repeated(texts):
    seen = Counter(t[p : p + P] for t in texts for p in range(len(t) - P + 1))
    return [len({q for p in range(len(t) - P + 1) if seen[t[p : p + P]] > 1 for q in range(p, p + P)}) for t in texts]


def rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghé") for _ in range(draw.randint(2, 9))) for _ in range(200)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passages = [text(90) for _ in range(3)] + [text(250)]
    out = [(r[0], r[1][:6_000] if r[1] else r[1], *r[2:]) for r in edge_rows()]
    out += [(600, "a" * 399, None, None, None), (601, "a" * 400, None, None, None), (604, "c" * 280, None, None, None), (605, "c" * 281, None, None, None), (606, "d" * 279, None, None, None), (602, "ab" * 500, None, None, None), (603, "b" * 3_000, None, None, None)]
    for i in range(60):
        x = text(draw.randint(1, 150))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            a = draw.randint(0, len(p) // 2)
            x += p[a : draw.randint(a, len(p))] + text(draw.randint(0, 40))
        out.append((700 + i, x, None, None, None))
        if i % 4 == 0:
            y = list(x)
            y[draw.randrange(len(y))] = "Z"
            out.append((800 + i, "".join(y), None, None, None))
    return out


@pytest.mark.parametrize(("shard", "crowd"), [(4_000, 8_000), (5, 8_000), (4_000, 1), (20, 4)])
def test_equals_brute_force(spark, monkeypatch, shard, crowd):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    data = rows()
    got = remove_repeats(clashing(documents(spark, data)))
    texts = [(r[1] or "").encode() for r in data]
    expected = [(r[0], *b, n) for r, b, n in zip(data, brute(texts), brute_repeated(texts), strict=True)]
    assert sum(e[5] > 0 and e[2] == 0 for e in expected) > 5  # passages too short to be removed
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(e[2] for e in expected) > 10_000


def test_anchors_depend_on_bytes_alone_even_over_chunks(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 101, 3_000, dtype=np.uint8))
    whole = [(p, s) for _, place, first, last in anchors(text) for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)]
    assert [s for _, s in whole] == list(range(len(text) - P + 1)) and all(s <= p <= s + P - substring_dedup.PART for p, s in whole)
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    chunked = [(p, s) for _, place, first, last in anchors(text) for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)]
    assert chunked == whole


def test_suffix_sort():
    draw = np.random.default_rng(2)
    contents = [bytes(draw.integers(97, 99, int(draw.integers(5, 60)), dtype=np.uint8)) for _ in range(300)]
    offsets, groups = np.array([int(draw.integers(0, 5)) for _ in contents]), draw.integers(0, 4, 300)
    order = Suffixes(contents, offsets, groups).sorted()
    assert sorted(order.tolist()) == list(range(300))
    keys = [(int(groups[i]), contents[i][offsets[i] :]) for i in order]
    assert keys == sorted(keys)


def test_collisions_of_hashes_are_found_and_mended(monkeypatch):
    monkeypatch.setattr(Suffixes, "hashes", lambda self, which, start, size: np.zeros(len(which), dtype=np.uint64))
    draw = np.random.default_rng(3)
    core = bytes(draw.integers(97, 123, L, dtype=np.uint8))
    other = bytes(draw.integers(97, 123, L, dtype=np.uint8))
    [found] = repeated_starts([core + b"x", core + b"y", other + b"z"], np.array([10, 10, 10]), np.array([7, 7, 7]))
    assert [f.tolist() for f in found] == [[0], [0], []]


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0
