"""Spelling variants: words that one inserted, deleted or replaced code point apart, by range reporting.

For words of one length m and those one code point shorter, an edit at place i leaves the i code points
before it and the m - 1 - i after it as they are. Words sorted forwards put the first part into an
interval, words sorted backwards the second; the words of length m are points of the grid of both
orders, held in a wavelet tree, and each word asks for the points in the rectangle of its two intervals.

The dictionary is split into shards by what an edit leaves alone. A word goes to two cells: by its first
half, for edits behind that, and by its second half, for edits in the first. A cell that holds too much
is cut into two by places, each keyed by all that edits there leave alone; at one place, a cell holds as
many words as there are letters, so cells stay bounded however words are distributed. Words meet only
inside cells, and what leaves a shard is one row a word: how many near words it has there and the best.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, slices, texts_of

#: Words and what they need.
MIN_LENGTH, MIN_COUNT, ONE_IN = 5, 3, 97
RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")  # shorter runs give no words
#: A form is used at least this many times as often as the word.
TIMES = 2
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Code points of a shard, about, and of a cell of more than so many words where it can be cut.
SHARD, CELL, FEW = 500_000, 1_000_000, 1_000
#: Rectangles that are looked up at a time.
RECTANGLES = 200_000
#: Lengths from here on share their shards.
LONG = 64


# --- words and counts ---------------------------------------------------------------------------


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n: occurrences in all texts, after one in so many has lost a code point by its document's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for key, text in zip(texts_of(part.column(0)), texts_of(part.column(1)), strict=True):
                start = zlib.crc32(key + b":")
                for word, n in Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= MIN_LENGTH:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield batch()
                    total.clear()
        yield batch()

    slim = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- the wavelet tree ---------------------------------------------------------------------------


class WaveletTree:
    """Points (x, y) with all x = 0, 1, ... and all y different, for reporting by rectangles."""

    def __init__(self, y: np.ndarray):
        self.bits = max(1, int(len(y) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # by level, how many of the first k have a 0 there
        for level in range(self.bits - 1, -1, -1):
            one = (y >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            y = np.concatenate([y[~one], y[one]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, y) for each point with left <= x < right and low <= y < high."""
        query = np.flatnonzero((left < right) & (low < high))
        a, b, value = left[query], right[query], np.zeros(len(query), dtype=np.int64)
        for zeros, level in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a0, b0, size = zeros[a], zeros[b], 1 << level
            a1, b1 = zeros[-1] + a - a0, zeros[-1] + b - b0
            stay = (a0 < b0) & (value + size > low[query]) & (value < high[query])
            turn = (a1 < b1) & (value + 2 * size > low[query]) & (value + size < high[query])
            a, b = np.concatenate([a0[stay], a1[turn]]), np.concatenate([b0[stay], b1[turn]])
            value = np.concatenate([value[stay], value[turn] + size])
            query = np.concatenate([query[stay], query[turn]])
        return query, value


# --- one cell's search --------------------------------------------------------------------------


def _sorted(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of code points, and how many each row in that order shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(chars).view(f"<U{chars.shape[1]}").ravel(), kind="stable")
    rows = chars[order]
    differ = rows[1:] != rows[:-1]
    return order, np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1])])


def _intervals(shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row in order, from where to where rows agree with it in their first n code points."""
    starts = np.flatnonzero(shared < n)
    which = np.searchsorted(starts, np.arange(len(shared)), side="right") - 1
    return starts[which], np.append(starts, len(shared))[which + 1]


def near_pairs(words: list[str], m: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v): places in words of two that are near by an edit at place first to last - 1, both ways; and the words' ranks in code-point order.

    words: all different, of m code points or m - 1. A place belongs to the longer word. Where an insertion
    fits several places, the last of them counts, so a pair comes from one place.
    """
    size = len(words)
    chars = np.array(words, dtype=f"<U{m}").view("<u4").reshape(size, m)
    longer = chars[:, m - 1] > 0
    turned = np.where(longer[:, None], chars[:, ::-1], np.roll(chars[:, ::-1], -1, axis=1))
    (forward, ahead), (backward, behind) = _sorted(chars), _sorted(turned)
    rank, back = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
    rank[forward], back[backward] = np.arange(size), np.arange(size)
    u_out, v_out = [], []
    if longer.any():
        points, rows = (np.concatenate([[0], np.cumsum(longer[order])]) for order in (forward, backward))  # words of length m among the first k
        in_x, in_y = forward[longer[forward]], backward[longer[backward]]
        tree = WaveletTree(rows[back[in_x]])
        # beyond what a word shares with its neighbours in either order, it is alone
        most = np.maximum(ahead, np.append(ahead[1:], -1))[rank]
        most_back = np.maximum(behind, np.append(behind[1:], -1))[back]
        pending: list[tuple[np.ndarray, ...]] = []

        def look_up() -> None:
            who, place, left, right, low, high = (np.concatenate(x) for x in zip(*pending, strict=True))
            pending.clear()
            query, y = tree.report(left, right, low, high)
            u, v, i = who[query], in_y[y], place[query]
            again = ~longer[u] & (i < m - 1) & (chars[u, i] == chars[v, i])  # an insertion that also fits one place later
            found = (u != v) & ~again
            u, v = u[found], v[found]
            short = ~longer[u]  # replacements are found from both sides, insertions from the shorter word
            u_out.extend((u, v[short]))
            v_out.extend((v, u[short]))

        waiting = 0
        for i in range(max(first, int((m - 1 - most_back).min())), min(last, int(most.max()) + 1)):
            who = np.flatnonzero((most >= i) & (most_back >= m - 1 - i))
            if not len(who):
                continue
            (left, right), (low, high) = _intervals(ahead, i), _intervals(behind, m - 1 - i)
            x, y = rank[who], back[who]
            pending.append((who, np.full(len(who), i), points[left[x]], points[right[x]], rows[low[y]], rows[high[y]]))
            waiting += len(who)
            if waiting >= RECTANGLES:
                look_up()
                waiting = 0
        if pending:
            look_up()
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *u_out]), np.concatenate([none, *v_out]), rank


# --- cells and shards ---------------------------------------------------------------------------


def _key(m: int, first: int, last: int, word: str) -> int:
    """The digest of a cell, as a signed number: the length, the places, and what edits there leave alone."""
    kept = f"{m}:{first}:{last}:{word[:first]}:{word[last - m + len(word) :]}"
    return xxhash.xxh64_intdigest(kept.encode()) - (1 << 63)


def cells_of(word: str, crowded: frozenset[int]) -> Iterator[tuple[int, int, int, int]]:
    """(m, first, last, key) of the cells of a word: as one of length m, and as one that is a code point short of it."""
    for m in (len(word), len(word) + 1):
        half = (m - 1) // 2
        open_ = [(0, half), (half, m)]
        while open_:
            first, last = open_.pop()
            key = _key(m, first, last, word)
            if last - first > 1 and key in crowded:
                middle = (first + last) // 2
                open_ += [(first, middle), (middle, last)]
            else:
                yield m, first, last, key


def routed(words: DataFrame, crowded, pieces: dict[int, int]) -> DataFrame:
    """shard, m, first, last, key, word, n: a row for each cell of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for m, first, last, key in cells_of(word, crowded.value):
                    band = min(m, LONG)
                    out.append(((band << 40) + key % pieces.get(band, 1), m, first, last, key, word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["shard", "m", "first", "last", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "shard long, m long, first long, last long, key long, word string, n long")


def search_shard(table: pa.Table) -> pa.Table:
    """word, n_near, form_n, form: of each word with near words in this shard, how many and the best of them."""
    out: list[tuple[list, ...]] = []
    cells = [table[c].to_numpy() for c in ("m", "first", "last")]
    order = np.lexsort(cells[::-1])
    edges = np.flatnonzero(np.append(True, np.any([c[order][1:] != c[order][:-1] for c in cells], axis=0))) if len(order) else []
    for part in np.split(order, edges[1:]) if len(order) else []:
        m, first, last = (int(c[part[0]]) for c in cells)
        if len(part) < 2:
            continue
        chosen = table.take(pa.array(part))
        words, n = chosen["word"].to_pylist(), chosen["n"].to_numpy()
        u, v, rank = near_pairs(words, m, first, last)
        if not len(u):
            continue
        best = np.lexsort((rank[v], -n[v], u))
        u, v = u[best], v[best]
        heads = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        out.append(([words[i] for i in u[heads]], np.diff(np.append(heads, len(u))), n[v[heads]], [words[i] for i in v[heads]]))
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    flat = lambda parts, kind: pa.chunked_array([pa.array(x, kind) for x in parts], kind)
    return pa.table({"word": flat(columns[0], pa.string()), "n_near": flat(columns[1], pa.int64()), "form_n": flat(columns[2], pa.int64()), "form": flat(columns[3], pa.string())})


def near_words(words: DataFrame, *, shard: int = SHARD, cell: int = CELL, few: int = FEW) -> DataFrame:
    """word, n_near, form_n, form: a row for each shard in which a word has near words."""
    sc = words.sparkSession.sparkContext
    size = F.length("word")
    lengths = words.groupBy(F.least(size, F.lit(LONG)).alias("m")).agg(F.sum(size).alias("chars")).collect()  # a row for each length
    chars = Counter()
    for r in lengths:
        for m in (r["m"], min(r["m"] + 1, LONG)):
            chars[m] += 2 * r["chars"]
    pieces = {m: max(1, -(-n // shard)) for m, n in chars.items()}
    crowded: frozenset[int] = frozenset()
    while True:
        known = sc.broadcast(crowded)
        cells = routed(words, known, pieces)
        full = cells.where("last - first > 1").groupBy("key").agg(F.sum(size).alias("chars"), F.count("*").alias("words")).where((F.col("chars") > cell) & (F.col("words") > few))
        new = frozenset(r["key"] for r in full.select("key").collect()) - crowded  # at most one for each so many code points of the vocabulary
        if not new:
            break
        crowded |= new
    return cells.groupBy("shard").applyInArrow(search_shard, "word string, n_near long, form_n long, form string")


def roots(edges: DataFrame) -> DataFrame:
    """word, root: where following forms ends, for each word of edges (word, form). Each round doubles the way that is known."""
    known = cut(edges.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of all texts that is long and frequent enough.

    A null text has no words; a null id reads as the empty string in the digests. Rows that repeat count
    each. The form is the near word used most, of several the least in code-point order, if it is used at
    least twice as often as the word; a word without form is its own root. Other columns are not read; an
    empty table gives an empty result.
    """
    words = cut(count_words(docs, id_col, text_col))
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("less"), "form").alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, form: string>").alias("best"))
    merged = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has_form = F.col("n") * TIMES <= -F.col("best.less")
    formed = cut(merged.select("word", "n", "n_near", F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
