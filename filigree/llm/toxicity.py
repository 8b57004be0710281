"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; the
document's is their noisy-or, 1 - prod(1 - p). Weights are fitted to labels of whole documents by the
gradient through the noisy-or, so the sentences that cause a label are found without labels of their
own. The fit takes a bounded sample of labelled documents; scoring is map-only over all of them.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_batches, texts_of
from .decontaminate import WORD

_STOP = re.compile(rb"[.!?\n]+")
#: Lengths in bytes of the word beginnings that are features beside the word, so that forms of a word share weight.
_STEMS = (3, 4, 5, 6)
#: Weighed words that a worker keeps.
CACHE_ENTRIES = 300_000


@dataclass(frozen=True)
class Fit:
    """Bounds and constants of the fit: labelled documents of each class and their largest text in bytes, features with a weight, the fewest documents of such a feature, how many clean documents flagged count as much as one toxic one missed, and the descent."""

    documents: int = 4_000
    text_bytes: int = 20_000
    features: int = 4_096
    feature_documents: int = 5
    toxic_cost: float = 6.0
    steps: int = 200
    rate: float = 0.25
    shrink: float = 1e-4


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:n] + b"*" for n in _STEMS if len(word) > n)]


@dataclass
class Model:
    bias: float = -12.0
    weights: dict[bytes, float] = field(default_factory=dict)


class Scorer(dict):
    """Word to weight under a model; its distinct words' weights and the bias make a sentence's score."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        get = self.model.weights.get
        out = self[word] = sum(get(f, 0.0) for f in features(word))
        return out

    def sentences(self, text: bytes) -> np.ndarray:
        """The score of each sentence; of a text without any, that of one empty sentence."""
        weight, bias = self.__getitem__, self.model.bias
        z = [bias + sum(map(weight, set(WORD.findall(s)))) for s in _STOP.split(text.translate(LOWER))]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum()))


def is_held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learnt from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, fit: Fit, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, toxic) of at most fit.documents labelled documents of each class, picked by a hash of their id, none held out, the least text of each id; and the size of each class."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_hash = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(fit.documents)
    picked = F.broadcast(by_hash(0).unionByName(by_hash(1)))  # at most 2 * fit.documents rows
    text = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where(F.octet_length("text") <= fit.text_bytes)
    # one text for each id, however many rows share it
    return text.join(picked, F.col("_doc") == F.col("id")).groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic"), sizes


def train(texts: list[bytes], toxic: np.ndarray, sizes: dict[int, int], fit: Fit = Fit()) -> Model:
    """Weights that fit the documents' labels through the noisy-or, by full-batch Adam.

    Sentences are held as numbers of features alone, so the space is a small multiple of the texts'.
    """
    if not 0 < toxic.sum() < len(toxic):
        return Model()
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic.tolist(), strict=True):
        seen[y].update({f for w in set(WORD.findall(text.translate(LOWER))) for f in features(w)})
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())

    def tells(f: bytes) -> float:
        """How far a feature's share of the documents differs between the classes, in standard errors."""
        a, b = seen[1][f] / n1, seen[0][f] / n0
        both = (seen[1][f] + seen[0][f]) / (n1 + n0)
        return abs(a - b) / math.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-9)

    often = (f for some in seen for f in some if seen[0][f] + seen[1][f] >= fit.feature_documents)
    chosen = heapq.nsmallest(fit.features, set(often), key=lambda f: (-tells(f), f))
    del seen
    place = {f: i for i, f in enumerate(chosen)}
    owners, sentences, found, n = array("i"), array("i"), array("i"), 0
    for doc, text in enumerate(texts):
        for s in _STOP.split(text.translate(LOWER)):
            owners.append(doc)
            for w in set(WORD.findall(s)):
                for f in features(w):
                    if f in place:
                        sentences.append(n)
                        found.append(place[f])
            n += 1
    owner, sentence, feature = (np.frombuffer(x, dtype=np.int32) if x else np.zeros(0, dtype=np.int32) for x in (owners, sentences, found))
    # documents weigh as much as those of their class that the sample leaves out
    weigh = np.array([max(sizes.get(0, n0), n0) / n0, max(sizes.get(1, n1), n1) / n1 * fit.toxic_cost])[toxic]
    weigh /= weigh.sum()

    theta, bias = np.zeros(len(chosen)), -6.0
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, fit.steps + 1):
        z = bias + np.bincount(sentence, theta[feature], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        doc = np.maximum(-np.expm1(none), 1e-12)
        pull = np.where(toxic == 1, -np.exp(none) / doc, 1.0) * weigh
        at = pull[owner] * p
        slope = np.append(np.bincount(feature, at[sentence], minlength=len(chosen)) + fit.shrink * theta, at.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        move = fit.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(t) for f, t in zip(chosen, theta, strict=True) if abs(t) > 1e-3})


def fitted(sample: DataFrame, sizes: dict[int, int], fit: Fit) -> Model:
    """The model of a sample, trained in one task: the sample is bounded by fit, in rows and in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += texts_of(batch.column(1))
            toxic += batch.column(2).to_pylist()
        model = train(texts, np.array(toxic, dtype=np.int64), sizes, fit)
        names, weights = [None, *model.weights], [model.bias, *model.weights.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(weights, pa.float64())], ["feature", "weight"])

    rows = sample.repartition(1).sortWithinPartitions("id", "text").mapInArrow(run, "feature binary, weight double").collect()
    weights = {None if r["feature"] is None else bytes(r["feature"]): r["weight"] for r in rows}
    return Model(weights.pop(None), weights) if weights else Model()


_SPANS = "array<struct<sentence:int,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def offending(text: bytes, scores: np.ndarray, least: float) -> list[dict]:
    """The sentences whose score is least or more, with their places in code points."""
    chosen = np.flatnonzero(scores >= least)
    if not len(chosen):
        return []
    stops = list(_STOP.finditer(text))
    starts, ends = np.array([0, *(m.end() for m in stops)]), np.array([*(m.start() for m in stops), len(text)])
    # code points before each byte: bytes that go on with one don't count
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [{"sentence": i, "start": a, "end": b, "score": s} for i, a, b, s in zip(chosen.tolist(), before[starts[chosen]].tolist(), before[ends[chosen]].tolist(), scores[chosen].tolist(), strict=True)]


#: The worker's scorer for the job at hand.
_scorers: dict[str, Scorer] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit: Fit = Fit(), least: float = 0.5) -> DataFrame:
    """The toxicity of every whole text, and the sentences that cause it.

    Returns doc_id, held_out, score, predicted (1 if score >= 0.5), n_sentences and offending (sentences
    that score ``least`` or more: number, place in code points, score). Only texts enter a score. Null
    and empty texts score as one sentence without words. A null id is scored and isn't held out.
    Repeated rows are scored each; repeated labels count once, as toxic if one is; labels other than 0
    and 1 are left out. Without labels of both classes every score is nearly 0. Other columns are not
    read; an empty table gives an empty result.
    """
    sample, sizes = training_sample(docs, labels, fit, id_col=id_col, text_col=text_col, label_col=label_col)
    model = fitted(sample, sizes, fit)
    sent, job = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # fit.features weights at most

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        if job not in _scorers:
            _scorers.clear()
            _scorers[job] = Scorer(sent.value)
        scorer, scores, counts, spans = _scorers[job], [], [], []
        for text in texts_of(batch.column(2)):
            p = scorer.sentences(text)
            scores.append(noisy_or(p))
            counts.append(len(p))
            spans.append(offending(text, p, least))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int32()), pa.array(spans, _SPAN_TYPE)], ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    slim = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(slim, rows, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_sentences int, offending {_SPANS}")
