"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, broadcast to every
task. Tier two is a bounded cache in each worker, filled by encoding what the table lacks. No
pre-token is ever shuffled: the table comes from a bounded sample of texts, read by one task. It
decides speed alone; every count is exact, over whole texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .word_bpe import byte_level, pretokenizer

#: Entries of the broadcast table and of a worker's cache.
TABLE_ENTRIES, CACHE_ENTRIES = 32_768, 400_000
#: The sample that the table is chosen from: texts, about, and the longest of them in bytes.
SAMPLE_TEXTS, SAMPLE_BYTES = 2_000, 20_000
#: Longer pre-tokens stay out of the table, which bounds its bytes.
LONGEST = 64


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", entries: int = TABLE_ENTRIES) -> list[str]:
    """About the most frequent pre-tokens, at most ``entries``, by a sample of SAMPLE_TEXTS texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, counts = pretokenizer(tokenizer_path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in pre.parts(text or "")[::2]:
                    counts.update(w for w in pre.words(part) if len(w) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts.most_common(entries)], pa.string())], ["word"])

    text = docs.select(F.col(text_col).alias("text"))
    drawn = text.sample(min(1.0, SAMPLE_TEXTS / max(1, docs.count())), seed=7).where(F.octet_length("text") <= SAMPLE_BYTES)
    # each row is drawn by itself, so copies do not enlarge the sample
    return [r["word"] for r in drawn.repartition(1).mapInArrow(count, "word string").collect()]


class _Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, and beside it what this worker has encoded."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.table, self.encode = table, pretokenizer(path).library.model.tokenize

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.table)
        n = self[word] = len(self.encode(byte_level(word)))
        return n


#: The worker's lookup for the job at hand.
_lookup: dict[str, _Lengths] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """The number of tokens of every whole text, as the tokenizers library gives it without added special tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens). A null text
    counts as empty: no bytes, no tokens. A null id stays null. Repeated rows are counted each, further
    columns of the input are not read, and an empty table gives an empty result. Special tokens that
    stand in a text count as one token each, the library's default.
    """
    tokenize = pretokenizer(tokenizer_path).library.model.tokenize
    table = docs.sparkSession.sparkContext.broadcast({w: len(tokenize(byte_level(w))) for w in frequent_pretokens(docs, tokenizer_path, text_col=text_col)})
    job = uuid.uuid4().hex

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        pre = pretokenizer(tokenizer_path)
        if job not in _lookup:
            _lookup.clear()
            _lookup[job] = _Lengths(tokenizer_path, table.value)
        length = _lookup[job].__getitem__
        sizes, counts = [], []
        for text in batch.column(1).to_pylist():
            parts = pre.parts(text := text or "")
            sizes.append(len(text) if text.isascii() else len(text.encode()))
            counts.append(len(parts) // 2 + sum(sum(map(length, pre.words(part))) for part in parts[::2]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
