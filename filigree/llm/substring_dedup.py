"""Removal of long strings that occur more than once, by hash-compared suffix sorting.

A string of 280 bytes that starts at two places selects the same anchor in both: the least of the
hashes of its 160-byte parts. A string of 400 bytes goes by the anchor of its first 280. So places are
compared only with places of equal anchor:

1. Every text gives its anchors, each with the run of starts that select it (its owned starts), found
   by prefix polynomial hashes and sliding minima. Anchors met once in the corpus are dropped.
2. Where the content around an anchor (all bytes of its owned strings) occurs twice as a whole, every
   owned start repeats. Contents are compared by 128 bits of BLAKE2b, apart from the anchors' hashes.
3. Different contents of an anchor meet in a shard, one copy each. Their suffixes from the anchor on are
   merge-sorted; two suffixes compare by the length of their common extension, found by binary search
   over prefix hashes. Extensions of neighbours to the right and hashes to the left tell which starts
   repeat; the bytes of every pair that decides are then compared outright. One sort serves both lengths.
4. Contents of an anchor that has too many for a shard are dealt to cells by their next bytes: strings
   with so many to so many bytes before the anchor share what lies behind and before it as far as all of
   them reach. A cell that is still too large is halved, down to one number of bytes before the anchor.
   Each cell is a group of the same sort. What a cell of one place holds are copies of one string, which
   need no sort: they are counted with combiners before the shuffle.

Strings of 400 bytes are removed. Those of 280, about 50 words, are counted as well: passages that
documents share although they are too short to be removed.

Equal texts go as a whole, by 128 bits of SHA-256. All stages spread over hashes; none gathers more than
a shard of bounded size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts_of

#: Bytes of a string that is removed, of a passage that is counted, and of the parts that select an anchor.
LENGTH, PASSAGE, PART = 400, 280, 160
#: Contents in a shard, about, and contents of an anchor or a cell from which it is divided.
SHARD, CROWD = 4_000, 8_000
#: Numbers of bytes that a string may have before its anchor.
_PLACES = PASSAGE - PART + 1
#: Starts that are hashed at a time.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + LENGTH), _powers(pow(_BASE, -1, 1 << 64), CHUNK + LENGTH)


def _sums(data: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes weighed by falling powers: differences, brought back to exponent 0, are polynomial hashes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * exponent, out=out[1:])
    return out


def anchors(text: bytes, length: int = PASSAGE, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first, last): anchors with the first and last start of a string of ``length`` bytes that selects them.

    Which anchor a string selects depends on its bytes alone: the leftmost of its least hashes.
    """
    window = length - part + 1
    for start in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, dtype=np.uint8)[start : start + CHUNK + length - 1]
        sums = _sums(data, _DOWN[: len(data)])
        n = len(data) - part + 1
        hashes = (sums[part:] - sums[:-part]) * _UP[:n]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        least, width = (hashes & _HIGH) | np.arange(n, dtype=np.uint64), 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        starts = n - window + 1
        at = (np.minimum(least[:starts], least[window - width : window - width + starts]) & _LOW).astype(np.int64)
        change = np.flatnonzero(at[1:] != at[:-1])
        first, last = np.append(0, change + 1), np.append(change, starts - 1)
        yield hashes[at[first]], at[first] + start, first + start, last + start


def _text_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _pairs(digests: list[bytes]) -> list[pa.Array]:
    words = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(words[:, 0]), pa.array(words[:, 1])]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


# --- which keys may be wanted ----------------------------------------------------------------------

#: Bits of a filter for each key, and at most: 16 MB.
KEY_BITS, MOST_BITS = 16, 1 << 27


def filter_of(keys: DataFrame):
    """A broadcast bitmap of the numbers in the one column of keys, for leaving out rows before a shuffle.

    It lets through every key and few others; beyond some millions of keys, more and more others. What
    passes is joined with the keys themselves afterwards, so the result does not depend on it.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    bits = min(MOST_BITS, 1 << max(10, int(keys.count() * KEY_BITS).bit_length()))
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(1L, CAST({name} & 63 AS INT))")
    words = keys.select(F.shiftright(at, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap lets these numbers through."""
    at = keys.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- passes over the texts -------------------------------------------------------------------------


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """(digest, text) of the texts of a batch, equal texts once in a partition."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        out = []
        for text in texts_of(batch.column(0)):
            if len(text) >= PASSAGE and (key := _text_digest(text)) not in seen:
                seen.add(key)
                out.append((key, text))
        yield out


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _once(batches):
        if found := [a[0] for _, text in texts for a in anchors(text)]:
            yield _batch({"g": np.concatenate(found).view(np.int64)})


def _anchor_rows(known):
    """The anchors of each text that pass the filter; at holds the first start, and how far behind it the place and the last start lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _once(batches):
            owners, contents, found = [], [], []
            for key, text in texts:
                for each in anchors(text):
                    chosen = _passes(known.value, each[0].view(np.int64))
                    hashes, place, first, last = (x[chosen] for x in each)
                    found.append((hashes.view(np.int64), (first << 16) | ((place - first) << 8) | (last - first)))
                    owners += [key] * len(place)
                    contents += [_digest(text[a : b + LENGTH] + (p - a).to_bytes(1) + (b - a).to_bytes(1)) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)]
            if owners:
                g, at = (np.concatenate(x) for x in zip(*found, strict=True))
                c1, c2 = _pairs(contents)
                t1, t2 = _pairs(owners)
                yield _batch({"g": g, "c1": c1, "c2": c2, "t1": t1, "t2": t2, "at": at})

    return run


def _text_rows(wanted):
    """The texts whose digests pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _once(batches):
            if texts:
                t1, t2 = _pairs([key for key, _ in texts])
                chosen = pa.array(_passes(wanted.value, t1.to_numpy()))
                if chosen.true_count:
                    yield _batch({"t1": t1, "t2": t2, "bytes": pa.array([text for _, text in texts], pa.binary())}).filter(chosen)

    return run


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = texts_of(batch.column(1))
        whole = [hashlib.sha256(t) for t in texts]
        t1, t2 = _pairs([w.digest()[:16] for w in whole])
        yield _batch({"doc_id": batch.column(0), "t1": t1, "t2": t2, "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "sha256": pa.array([w.hexdigest() for w in whole])})


# --- a shard: suffix sort ---------------------------------------------------------------------------


class Suffixes:
    """Suffixes of contents from their anchors on, with prefix hashes over all contents of a shard."""

    def __init__(self, contents: list[bytes], offsets: np.ndarray, groups: np.ndarray):
        self.data = b"".join(contents)
        sizes = np.array([len(c) for c in contents])
        self.begin = np.cumsum(sizes) - sizes
        self.offset, self.group = offsets, groups
        self.anchor, self.right = self.begin + offsets, sizes - offsets
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        self.sums = _sums(self.bytes, _DOWN[np.arange(len(self.data)) - np.repeat(self.begin, sizes)])

    def hashes(self, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Polynomial hashes of size bytes from start on, a place within content which."""
        return (self.sums[start + size] - self.sums[start]) * _UP[start - self.begin[which]]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the common extension of suffixes x and y, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.right[x], self.right[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes(x, self.anchor[x], mid) == self.hashes(y, self.anchor[y], mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; a suffix that the other extends sorts first."""
        size = self.common(x, y)
        ends_x, ends_y = size == self.right[x], size == self.right[y]
        last = len(self.bytes) - 1
        next_x, next_y = self.bytes[np.minimum(self.anchor[x] + size, last)], self.bytes[np.minimum(self.anchor[y] + size, last)]
        return np.where(ends_x | ends_y, ends_x & ~ends_y, next_x < next_y)

    def sorted(self) -> np.ndarray:
        """The suffixes by group and, in a group, in order: a merge sort whose merges run side by side, each place of a run found in its sister run by binary search."""
        order = np.argsort(self.group, kind="stable")
        group = self.group[order]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        start = np.repeat(new, np.diff(np.append(new, len(order))))
        size = np.repeat(np.diff(np.append(new, len(order))), np.diff(np.append(new, len(order))))
        local, width = np.arange(len(order)) - start, 1
        while (size > width).any():
            block = local // (2 * width) * (2 * width)
            second = local - block >= width
            at = np.where(second, block, block + width)  # the sister run
            end = np.minimum(at + width, size)
            moving = np.flatnonzero(end > at)
            low, high = at[moving], end[moving]
            x, base, later = order[moving], start[moving], second[moving]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                y = order[base[open_] + mid]
                # of equal suffixes the first run's come first
                ahead = np.where(later[open_], ~self.before(x[open_], y), self.before(y, x[open_]))
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
            to = start + local
            to[moving] = base + block[moving] + (local[moving] - block[moving] - width * later) + (low - at[moving])
            order = order[np.argsort(to, kind="stable")]
            width *= 2
        return order


def repeated_starts(contents: list[bytes], offsets: np.ndarray, groups: np.ndarray, lengths: tuple[int, ...] = (LENGTH,), low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """For each length, for each content, the starts (from its begin) of strings of that length that another content of its group holds at the same anchor.

    offsets: where the anchor lies in each content. A string's anchor lies within its first PASSAGE bytes.
    low, high: of a content only strings with low to high - 1 bytes before the anchor are asked for; all by default.
    """
    low = np.zeros(len(contents), dtype=np.int64) if low is None else low
    high = np.full(len(contents), _PLACES) if high is None else high
    suffixes = Suffixes(contents, offsets, groups)
    order = suffixes.sorted()
    begin_new = np.append(True, suffixes.group[order][1:] != suffixes.group[order][:-1])
    extension = np.append(0, suffixes.common(order[:-1], order[1:])) if len(order) > 1 else np.zeros(1, dtype=np.int64)
    extension[begin_new] = -1
    return [_repeated(suffixes, order, extension, contents, length, low, high) for length in lengths]


def _repeated(suffixes: Suffixes, order: np.ndarray, extension: np.ndarray, contents: list[bytes], length: int, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    offsets, groups = suffixes.offset, suffixes.group
    offset, right, anchor = offsets[order], suffixes.right[order], suffixes.anchor[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for left in range(_PLACES):  # bytes of a string before its anchor
        fits = np.flatnonzero((offset >= left) & (right >= length - left) & (low[order] <= left) & (left < high[order]))
        if len(fits) < 2:
            continue
        block = np.cumsum(extension < length - left)[fits]  # suffixes that agree as far as the string goes
        hashes = suffixes.hashes(order[fits], anchor[fits] - left, np.full(len(fits), left))
        by = np.lexsort((hashes, block))
        same = np.flatnonzero((block[by][1:] == block[by][:-1]) & (hashes[by][1:] == hashes[by][:-1]))
        if len(same):
            found.append((order[fits[by[same]]], order[fits[by[same + 1]]], np.full(len(same), left)))
    out: list[set[int]] = [set() for _ in contents]
    if not found:
        return [np.zeros(0, dtype=np.int64)] * len(contents)
    x, y, left = (np.concatenate(z) for z in zip(*found, strict=True))
    # every pair's bytes are compared once, as far as its strings go
    by = np.lexsort((left, y, x))
    x, y, left = x[by], y[by], left[by]
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    data, anchor, wrong = suffixes.data, suffixes.anchor, set()
    for a, b in zip(new.tolist(), np.append(new[1:], len(x)).tolist(), strict=True):
        i, j, least, most = int(x[a]), int(y[a]), int(left[a]), int(left[b - 1])
        p, q = int(anchor[i]), int(anchor[j])
        if data[p - most : p + length - least] == data[q - most : q + length - least]:
            own = left[a:b].tolist()
            out[i].update(own)
            out[j].update(own)
        else:
            wrong.add(int(groups[i]))
    for g in wrong:  # a collision of hashes: this group's strings themselves are counted
        own = np.flatnonzero(groups == g)
        seen: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i in own.tolist():
            for s in range(len(contents[i]) - length + 1):
                if low[i] <= offsets[i] - s < high[i]:
                    seen[contents[i][s : s + length]].append((i, int(offsets[i]) - s))
            out[i] = set()
        for places in seen.values():
            if len(places) > 1:
                for i, left_of in places:
                    out[i].add(left_of)
    return [np.sort(offsets[i] - np.array(sorted(o), dtype=np.int64)) if o else np.zeros(0, dtype=np.int64) for i, o in enumerate(out)]


def _ranges(starts: np.ndarray) -> list[dict[str, int]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)], strict=True)]


_RANGES = "array<struct<first:int,last:int>>"
#: What a range of starts has: strings of 400 bytes, passages, or both.
LONG, SHORT, BOTH = 0, 1, 2


#: From at of an anchor: where its owned starts begin and end, and where it lies.
_FIRST, _LAST, _PLACE = "shiftright(at, 16)", "shiftright(at, 16) + (at & 255)", "shiftright(at, 16) + (shiftright(at, 8) & 255)"


def _search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """The repeated starts of each content, of both lengths; an owned start behind whose strings the text ends has none."""
    at = [pdf[c].to_numpy(dtype=np.int64) for c in ("offset", "cell", "low", "high")]
    long, short = repeated_starts(pdf["content"].tolist(), at[0], at[1], (LENGTH, PASSAGE), at[2], at[3])
    long, short = ([s[s <= n] for s, n in zip(found, pdf["starts"].to_numpy(), strict=True)] for found in (long, short))
    return pd.DataFrame({"g": pdf["g"], "c1": pdf["c1"], "c2": pdf["c2"], "ranges": [_ranges(s) for s in long], "passages": [_ranges(s) for s in short]})


def _content_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contents wanted of each text; starts is the last owned start."""
    for batch in slices(batches):
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in wanted:
                first, starts = w["at"] >> 16, w["at"] & 255
                rows.append((w["g"], w["c1"], w["c2"], w["at"] >> 8 & 255, starts, text[first : first + starts + LENGTH], w["crowd"]))
        if rows:
            g, c1, c2, offset, starts, content, crowd = zip(*rows, strict=True)
            yield _batch({"g": pa.array(g, pa.int64()), "c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()), "offset": pa.array(offset, pa.int32()), "starts": pa.array(starts, pa.int32()), "content": pa.array(content, pa.binary()), "crowd": pa.array(crowd, pa.bool_())})


_CONTENT = "g long, c1 long, c2 long, offset int, starts int, content binary"


def _cells_of(g: int, offset: int, starts: int, content: bytes, divided: frozenset[int]) -> Iterator[tuple[int, int, int]]:
    """(low, high, cell) of the cells of a content: strings with low to high - 1 bytes before the anchor, by the digest of what all of them share."""
    open_ = [(0, _PLACES)]
    while open_:
        low, high = open_.pop()
        end = offset + PASSAGE - (high - 1)
        if low > offset or high <= offset - starts or end > len(content):
            continue  # no string of this content has its anchor there
        cell = int.from_bytes(hashlib.blake2b(b"%d %d %d " % (g, low, high) + content[offset - low : end], digest_size=8).digest(), "little", signed=True)
        if high - low > 1 and cell in divided:
            middle = (low + high) // 2
            open_ += [(low, middle), (middle, high)]
        else:
            yield low, high, cell


def _cell_rows(divided, whole: bool):
    """Rows of contents to rows of their cells; without the contents themselves unless ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, found = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5)), strict=True)):
                own = list(_cells_of(*row, divided.value))
                owner += [i] * len(own)
                found += own
            if found:
                low, high, cell = zip(*found, strict=True)
                columns = {"low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()), "cell": pa.array(cell, pa.int64())}
                if whole:
                    columns |= {name: batch.column(i).take(pa.array(owner)) for i, name in enumerate(batch.schema.names)}
                yield _batch(columns)

    return run


def cells(contents: DataFrame) -> DataFrame:
    """low, high, cell, full and the columns of contents: a row for each cell of each content; full cells are those of one place that hold more than CROWD.

    A cell is divided while it holds more; there is at most one such cell for so many contents, so their
    digests may be sent to all tasks.
    """
    sc, divided = contents.sparkSession.sparkContext, frozenset()
    while True:
        sent = sc.broadcast(divided)
        counted = cut(contents.mapInArrow(_cell_rows(sent, False), "low int, high int, cell long").groupBy("cell").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("places")).where(F.col("n") > CROWD))
        new = frozenset(r["cell"] for r in counted.where("places > 1").select("cell").collect()) - divided
        if not new:
            break
        divided |= new
    rows = contents.mapInArrow(_cell_rows(sent, True), f"low int, high int, cell long, {_CONTENT}")
    full = counted.where("places = 1").select("cell", F.lit(True).alias("full"))
    return rows.join(F.broadcast(full), "cell", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one start of each content that a cell of one place asks for, with the digests of its strings of both lengths. batch: g, c1, c2, offset, starts, content, low."""
    for batch in slices(batches):
        owner, starts, digests, kinds = [], [], [], []
        for i, (offset, last, content, left) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True)):
            s = offset - left
            for length, kind in ((LENGTH, LONG), (PASSAGE, SHORT)):
                if 0 <= s <= last and s + length <= len(content):
                    owner.append(i)
                    starts.append(s)
                    kinds.append(kind)
                    digests.append(_digest(content[s : s + length]))
        if digests:
            s1, s2 = _pairs(digests)
            yield _batch({**{k: batch.column(i).take(pa.array(owner)) for i, k in enumerate(("g", "c1", "c2"))}, "s1": s1, "s2": s2, "kind": pa.array(kinds, pa.int32()), "start": pa.array(starts, pa.int32())})


def _runs(ranges: list[tuple[int, int]], length: int, size: int) -> list[list[int]]:
    """The bytes that strings of a length from these ranges of starts cover in a text, as runs; starts too near its end have no string."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        end = min(last, size - length) + length
        if first + length > end:
            continue
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without what their repeated starts cover (null: nothing is removed), and what passages cover."""
    for batch in slices(batches):
        sizes, spans, repeated, texts = [], [], [], []
        for text, lists in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = _runs([(r["first"], r["last"]) for r in lists if r["kind"] != SHORT], LENGTH, len(text))
            passages = _runs([(r["first"], r["last"]) for r in lists if r["kind"] != LONG], PASSAGE, len(text))
            edges = [0, *(e for run in runs for e in run), len(text)]
            texts.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else None)
            sizes.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            repeated.append(sum(b - a for a, b in passages))
        if batch.num_rows:
            yield _batch({"t1": batch.column(0), "t2": batch.column(1), "n_removed": pa.array(sizes, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "n_repeated": pa.array(repeated, pa.int64()), "kept": pa.array(texts, pa.binary())})


# --- the job ------------------------------------------------------------------------------------------


def repeated_ranges(text: DataFrame) -> DataFrame:
    """t1, t2, kind, first, last: the starts of repeated strings in each text of one column, by the text's digest. Texts that are equal as a whole may lack theirs; a range may reach beyond the text's last string."""
    hashes = text.mapInArrow(_anchor_hashes, "g long")
    known = cut(hashes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    rows = text.mapInArrow(_anchor_rows(filter_of(known)), "g long, c1 long, c2 long, t1 long, t2 long, at long")
    held = cut(rows.join(known, "g"))
    # one copy of each content, with whether it occurs again as a whole
    contents = cut(held.groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "at")).alias("of")))
    several = contents.groupBy("g").agg(F.count("*").alias("contents")).where("contents > 1")
    wanted = contents.join(several, "g").select("g", "c1", "c2", "of.*", (F.col("contents") > CROWD).alias("crowd"))
    wanted = cut(wanted)
    n = wanted.count()
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("g", "c1", "c2", "at", "crowd")).alias("wanted"))
    texts = text.mapInArrow(_text_rows(filter_of(wanted.select("t1").distinct())), "t1 long, t2 long, bytes binary")
    # several tasks may have met an equal text: then its contents come as often, and count once
    fetched = texts.join(lists, ["t1", "t2"]).select("bytes", "wanted").mapInArrow(_content_rows, "g long, c1 long, c2 long, offset int, starts int, content binary, crowd boolean")
    every = [F.col("g").alias("cell"), F.lit(0).alias("low"), F.lit(_PLACES).alias("high")]
    names = ["g", "c1", "c2", "offset", "starts", "content"]
    sorted_ = fetched.where("NOT crowd").select(*every, *names)
    starts = None
    if not wanted.where("crowd").isEmpty():
        dealt = cut(cells(cut(fetched.where("crowd").select(*names).dropDuplicates(["g", "c1", "c2"]))))
        sorted_ = sorted_.unionByName(dealt.where("NOT full").select("cell", "low", "high", *names))
        n += dealt.count()
        starts = cut(dealt.where("full").select(*names, "low").mapInArrow(_start_rows, "g long, c1 long, c2 long, s1 long, s2 long, kind int, start int"))
    shards = max(1, -(-n // SHARD))
    sharded = sorted_.withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)).cast("int")).dropDuplicates(["shard", "cell", "g", "c1", "c2"])
    both = sharded.groupBy("shard").applyInPandas(_search_shard, f"g long, c1 long, c2 long, ranges {_RANGES}, passages {_RANGES}").where(F.size("ranges") + F.size("passages") > 0)
    tagged = lambda name, kind: F.transform(name, lambda r: F.struct(F.lit(kind).alias("kind"), r["first"].alias("from"), r["last"].alias("to")))
    ranges = both.select("g", "c1", "c2", F.inline(F.concat(tagged("ranges", LONG), tagged("passages", SHORT))))
    if starts is not None:
        again = cut(starts.groupBy("s1", "s2", "kind").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        ranges = ranges.unionByName(starts.join(again, ["s1", "s2", "kind"]).select("g", "c1", "c2", "kind", F.col("start").alias("from"), F.col("start").alias("to")))
    first = F.expr(_FIRST)
    partly = held.join(ranges, ["g", "c1", "c2"]).select("t1", "t2", "kind", (first + F.col("from")).alias("first"), (first + F.col("to")).alias("last"))
    whole = held.join(contents.where("n > 1").select("g", "c1", "c2"), ["g", "c1", "c2"]).select("t1", "t2", F.lit(BOTH).alias("kind"), first.alias("first"), F.expr(_LAST).alias("last"))
    return whole.unionByName(partly)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text without the bytes of strings of 400 bytes that start at another place too, in the same document or another.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_repeated (bytes
    that strings of 280 bytes cover which start at another place too; nothing is removed for their sake)
    and kept (the bytes that remain, null where all do). All strings are judged on the input. A null text
    counts as empty; texts of less than 400 bytes stay. Null ids stay null; every row is a document, so a
    repeated row repeats its text; other columns are not read; an empty table gives an empty result.
    """
    text = docs.select(F.col(text_col).alias("text"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = cut(slim.mapInArrow(_document_rows, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n_bytes long, sha256 string"))
    counted = cut(base.where(F.col("n_bytes") >= PASSAGE).groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("size")))
    found = repeated_ranges(text).join(counted.where("copies = 1").select("t1", "t2"), ["t1", "t2"], "left_semi")
    lists = cut(found.groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "first", "last")).alias("ranges")))
    texts = text.mapInArrow(_text_rows(filter_of(lists.select("t1").distinct())), "t1 long, t2 long, bytes binary")
    changed = texts.join(lists, ["t1", "t2"]).select("t1", "t2", "bytes", "ranges").mapInArrow(_removed, "t1 long, t2 long, n_removed long, n_spans long, n_repeated long, kept binary")
    long = F.col("size") >= LENGTH
    whole = counted.where("copies > 1").select("t1", "t2", F.when(long, F.col("size")).otherwise(0).alias("n_removed"), long.cast("long").alias("n_spans"), F.col("size").alias("n_repeated"), F.when(long, F.lit("").cast("binary")).alias("kept"))
    out = base.join(changed.unionByName(whole), ["t1", "t2"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"), F.coalesce("n_repeated", none).alias("n_repeated"), "kept")
