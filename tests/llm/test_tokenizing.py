import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filigree.llm import bpe, token_counts
from filigree.llm.word_bpe import byte_level, prefix_encoder

from .fixtures import clashing, documents, edge_rows, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("alphabet", ["ab", "the", "inthare", "àéö", "!?-", "abcdefghijklmnopqrstuvwxyz"])
def test_prefix_encoder_equals_merging(library, alphabet):
    draw, encoder = random.Random(alphabet), prefix_encoder(PATH)
    for _ in range(400):
        word = byte_level("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 25))))
        assert encoder.encode(word) == [t.id for t in library.model.tokenize(word)]


def test_prefix_encoder_on_a_very_long_word(library):
    word = "ab" * 5_000
    assert prefix_encoder(PATH).encode(word) == [t.id for t in library.model.tokenize(word)]


def test_counts_and_round_trip_equal_the_library(spark, library):
    docs = clashing(documents(spark))
    expected = []
    for doc_id, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len((text or "").encode()), len(ids), ids, decoded))
    counts = token_counts.count_tokens(docs, PATH, limit=100)
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(((d, b, n, n > 100) for d, b, n, _, _ in expected), key=repr)
    encoded = bpe.encode_decode(docs, PATH)
    assert sorted(map(tuple, encoded.collect()), key=repr) == sorted(((d, n, ids, text) for d, _, n, ids, text in expected), key=repr)
    digests = bpe.encode_decode(docs, PATH, digests=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(tuple, digests.collect()), key=repr) == sorted(((d, n, sha(" ".join(map(str, ids))), sha(text)) for d, _, n, ids, text in expected), key=repr)


@pytest.mark.parametrize("sample", [0, 1_000_000])
def test_small_samples_and_caches_do_not_change_counts(spark, library, monkeypatch, sample):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(token_counts, "SAMPLE_TEXTS", sample)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(documents(spark), PATH).collect()}
    assert counts[7] == len(library.encode(edge_rows()[8][1], add_special_tokens=False).ids)


def test_no_pretoken_is_shuffled(spark):
    plan = token_counts.count_tokens(documents(spark).where("doc_id > 3"), PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of documents(spark) itself


def test_caches_that_overflow_do_not_change_ids(monkeypatch):
    text = edge_rows()[8][1][:5_000]
    before = bpe.encode_text(text, PATH)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    assert bpe.encode_text(text, PATH) == before


def test_empty_tables(spark):
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0
    assert bpe.encode_decode(empty(spark), PATH).count() == 0
