from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from . import test_decontaminate, test_line_dedup, test_quality, test_simhash
from .fixtures import documents, edge_rows, prose


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = edge_rows() + [(900 + i, prose(900 + i, 80), "en", "a", 1) for i in range(10)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(900, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(prose(903, 80).split()[5:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_and_the_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/out{k}")
        docs = spark.read.parquet(f"{sf_dir}/out{k}")
        ids.append({r["doc_id"] for r in docs.collect()})
    assert not {1, 2, 3} & ids[0] and 4 in ids[0]
    assert {4, 5} <= ids[1] and 5 not in ids[2] and 4 in ids[2]
    assert 903 in ids[2] and 903 not in ids[3]
    assert {900 + i for i in range(10) if i != 3} <= ids[4]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_stages_equal_brute_force(spark, sf_dir):
    """Every stage over its own input, in plain Python; one good label certifies no cutoff."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def quality(rows):
        return [r for r in rows if not test_quality.brute(r[1])[5]]

    def lines(rows):
        texts = defaultdict(list)
        for doc_id, text, *_ in test_line_dedup.brute([(r[0], r[1]) for r in rows]):
            texts[doc_id].append(text)
        out = [(r[0], texts[r[0]].pop(), *r[2:4]) for r in rows]
        return [(*r, None if r[1] is None else len(r[1])) for r in out]

    def near(rows):
        fp = {r: test_simhash.brute_fingerprint(r[1]) for r in rows}
        classes = test_simhash.brute_classes(set(fp.values()))
        leads = {}
        for r in rows:
            if r[0] is not None:
                leads[classes[fp[r]]] = min(r[0], leads.get(classes[fp[r]], r[0]))
        stay = [r for r in rows if r[0] is None or leads[classes[fp[r]]] == r[0]]
        return [r for i, r in enumerate(stay) if r[0] is None or r not in stay[:i]]

    def clean(rows):
        hit = {(d, n) for d, n, *_, contaminated in test_decontaminate.brute([(r[0], r[1]) for r in rows], items) if contaminated}
        return [r for r in rows if (r[0], len(test_decontaminate.words(r[1]))) not in hit]

    def encoded(rows):
        out = []
        for r in rows:
            ids = library.encode(r[1] or "", add_special_tokens=False).ids
            out.append((r[0], len(ids), ids, library.decode(ids, skip_special_tokens=False)))
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, ((_, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, (quality, lines, near, clean, encoded), strict=True)):
        rows = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/brute{k}")
        docs = spark.read.parquet(f"{sf_dir}/brute{k}")
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(brute(rows), key=repr), k
