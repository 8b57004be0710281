"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of benchmark items. Windows of one length form a set: a table of two-word
blocks says how far the search may skip, and where it may not, the hash of the last words picks the
windows to compare word by word. Documents are only mapped over; the benchmark is broadcast in
blocks of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, map_batches, texts_of

#: Words on bytes: digits, lower-case letters and everything beyond ASCII, after A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a window, and bytes of benchmark text that are broadcast at a time: their windows take about 150 MB in a worker.
WINDOW, BLOCK_BYTES = 10, 2_000_000
#: Words of a run that a long item is cut into.
PIECE_WORDS = 5_000
_SUFFIX = 4


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


@dataclass
class WindowSet:
    """The windows of one length in words, ready for the search."""

    length: int
    owners: dict[tuple[bytes, ...], set[str]] = field(default_factory=lambda: defaultdict(set))
    shift: dict = field(default_factory=dict)
    buckets: dict[int, list[tuple[bytes, ...]]] = field(default_factory=dict)

    def prepare(self) -> None:
        block = min(2, self.length)
        for window in self.owners:
            for end in range(block, self.length + 1):
                key = window[end - block : end]
                self.shift[key] = min(self.length - end, self.shift.get(key, self.length))
            self.buckets.setdefault(hash_words(window[-_SUFFIX:]), []).append(window)

    def search(self, words: list[bytes], hit: bytearray, items: set[str]) -> None:
        """Marks in hit the words inside an occurrence and adds the owners of what occurs."""
        m, shift, default = self.length, self.shift, max(1, self.length - 1)
        block = min(2, m)
        at, n = m, len(words)
        while at <= n:
            step = shift.get(tuple(words[at - block : at]), default)
            if step:
                at += step
                continue
            for window in self.buckets.get(hash_words(words[max(at - _SUFFIX, at - m) : at]), ()):
                if tuple(words[at - m : at]) == window:
                    hit[at - m : at] = b"\1" * m
                    items |= self.owners[window]
            at += 1


def hash_words(words: Iterable[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def window_sets(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[WindowSet]:
    """Sets of windows by length: ``window`` words, or a whole item that has fewer (but not none)."""
    sets: dict[int, WindowSet] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            sets.setdefault(length, WindowSet(length)).owners[tuple(words[i : i + length])].add(item)
    for s in sets.values():
        s.owners = dict(s.owners)
        s.prepare()
    return list(sets.values())


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """item, text in parts of about block_bytes; items without id or text are left out.

    Long items are cut into runs of words that overlap by one less than a window, so that each window
    stands whole in some run and no block depends on the length of an item. Equal runs of an item count once.
    """
    least = max(PIECE_WORDS, 2 * window)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, out = [], []
        for i, text in enumerate(texts_of(batch.column(1))):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1), least - window + 1):
                owner.append(i)
                out.append(b" ".join(words[at : at + least]).decode())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(out, pa.string())], ["item", "text"])

    named = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    items = cut(map_batches(named, pieces, "item string, text string").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


#: The worker's search tables for the job at hand.
_tables: dict[str, list[WindowSet]] = {}


def _searcher(block: DataFrame, window: int):
    """A function that finds in a text its number of words, its hit words and its items; and the broadcast that it uses."""
    rows = [(r["item"], r["text"].encode()) for r in block.toLocalIterator()]
    sent, job = block.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def find(text: bytes) -> tuple[int, bytearray, set[str]]:
        if job not in _tables:
            _tables.clear()
            _tables[job] = window_sets(sent.value, window)
        words = words_of(text)
        hit, items = bytearray(len(words)), set()
        for s in _tables[job]:
            s.search(words, hit, items)
        return len(words), hit, items

    return find, sent


def _runs(hit: bytearray) -> list[dict[str, int]]:
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(b"\1+", hit)]


_SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The benchmark passages in every whole text.

    Returns doc_id, n_words, n_hit (words inside an occurring window), n_items, items (ids as strings,
    sorted), hit_spans (runs of hit words, end exclusive) and contaminated. A null text has no words;
    null ids stay null; repeated rows are searched each; items that share an id count as one; an empty
    benchmark hits nothing; other columns are not read; empty documents give an empty result.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        find, _ = _searcher(blocks[0], window)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [find(text) for text in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())), pa.array([_runs(h) for _, h, _ in found], _SPAN_TYPE)], ["doc_id", "n_words", "items", "hit_spans"])

        found = map_batches(slim, rows, f"doc_id {kind}, n_words long, items array<string>, hit_spans {_SPANS}")
    else:
        found = _found_by_blocks(slim, blocks, window, kind)
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_spans", (F.size("hit_spans") > 0).alias("contaminated"))


def _found_by_blocks(slim: DataFrame, blocks: list[DataFrame], window: int, kind: str) -> DataFrame:
    """doc_id, n_words, items, hit_spans over several blocks, searched one after another, each block's broadcast gone before the next.

    What a text contains depends on the text alone, so it is gathered by the text's digest.
    """

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())], ["doc_id", "text_key", "n_words"])

    every = None
    for block in blocks:
        find, sent = _searcher(block, window)

        def rows(batch: pa.RecordBatch, find=find) -> pa.RecordBatch | None:
            keys, items, spans = [], [], []
            for text in texts_of(batch.column(1)):
                _, hit, found = find(text)
                if found:
                    keys.append(xxhash.xxh3_128_digest(text))
                    items.append(sorted(found))
                    spans.append(_runs(hit))
            if not keys:
                return None
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)], ["text_key", "items", "hit_spans"])

        part = cut(map_batches(slim, rows, f"text_key binary, items array<string>, hit_spans {_SPANS}").dropDuplicates(["text_key"]))
        sent.destroy()
        every = part if every is None else every.unionByName(part)

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The items of all blocks, each once, and their spans as runs."""
        items = [sorted({i for own in lists for i in own}) for lists in batch.column(1).to_pylist()]
        runs = []
        for lists in batch.column(2).to_pylist():
            out: list[dict[str, int]] = []
            for start, end in sorted((s["start"], s["end"]) for own in lists for s in own):
                if out and start <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], end)
                else:
                    out.append({"start": start, "end": end})
            runs.append(out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.string())), pa.array(runs, _SPAN_TYPE)], ["text_key", "items", "hit_spans"])

    gathered = map_batches(every.groupBy("text_key").agg(F.collect_list("items").alias("items"), F.collect_list("hit_spans").alias("hit_spans")), merged, f"text_key binary, items array<string>, hit_spans {_SPANS}")
    out = map_batches(slim, counted, f"doc_id {kind}, text_key binary, n_words long").join(gathered, "text_key", "left")
    return out.select("doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hit_spans", F.array().cast(_SPANS)).alias("hit_spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns stay as they are. A null text stays."""
    at = docs.columns.index(text_col)
    for k, block in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)):
        find, _ = _searcher(block, window)

        def rows(batch: pa.RecordBatch, find=find) -> pa.RecordBatch:
            return batch.filter(pa.array([not any(find(text)[1]) for text in texts_of(batch.column(at))], pa.bool_()))

        docs = map_batches(cut(docs) if k else docs, rows, docs.schema)
    return docs
