"""Line deduplication that can be undone: cuckoo filters in front of exact reference counts.

The exact table lists which document holds which long line (by a 128-bit hash of its key), as files
in the shared folder. Documents are inserted by adding rows, and deleted by rows that take theirs
back, so counts and the last holder of a line are always exact. Lines that are frequent enough to
drop stand also in cuckoo filters, sharded by hash and stored beside the table. An insertion or
deletion counts anew only the lines it touches, and inserts those that have become frequent into
their shards' filters and deletes those that no longer are. A document is first held against the
filters, without any shuffle; only documents with a possible hit meet the exact table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, cut, ensure_checkpoint_dir, map_batches, texts_of

#: Least code points of a key that counts, and least documents that make a line superfluous.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a filter shard at first; bytes of filters that are broadcast, while beyond them lines go to the filters' shards; lines that one task holds against a shard.
SHARD_KEYS, FILTER_BYTES, PROBED_KEYS = 40_000, 64_000_000, 1_000_000


def split_lines(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text; the places of those whose key is long enough; the 16-byte hashes of these keys."""
    places, hashes = [], []
    for i, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars):
            places.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return text.split(b"\n"), places, hashes


def as_words(hashes: list[bytes]) -> np.ndarray:
    """Hashes as two signed numbers each."""
    return np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint lies in one of two buckets, each known from the other."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def of(cls, words: np.ndarray) -> CuckooFilter:
        """A filter of all these hashes; larger if they do not fit at first."""
        buckets = 1 << max(1, int(np.ceil(len(words) / cls.SLOTS / 0.85)) - 1).bit_length()
        while True:
            out = cls(buckets)
            if all(out.insert(int(a), int(b)) for a, b in words):
                return out
            buckets *= 2

    @staticmethod
    def _marks(second: np.ndarray) -> np.ndarray:
        return (second.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _places(self, first: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        one = (first.astype(np.uint64) >> np.uint64(20)) & mask
        return one, (one ^ (marks.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask

    def _of_one(self, first: int, second: int) -> tuple[int, int, int]:
        marks = self._marks(np.array([second], dtype=np.int64))
        one, two = self._places(np.array([first], dtype=np.int64), marks)
        return int(marks[0]), int(one[0]), int(two[0])

    def insert(self, first: int, second: int) -> bool:
        """Whether there was room; without, the filter is as before."""
        mark, one, two = self._of_one(first, second)
        for place in (one, two):
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = mark
                return True
        place, mask, moves = one, self.buckets - 1, []
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            moves.append((place, slot, int(self.table[place, slot])))
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = (place ^ mark * 0x5BD1E995) & mask
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = mark
                return True
        for place, slot, old in reversed(moves):
            self.table[place, slot] = old
        return False

    def delete(self, first: int, second: int) -> bool:
        mark, one, two = self._of_one(first, second)
        for place in (one, two):
            if (own := np.flatnonzero(self.table[place] == mark)).size:
                self.table[place, own[0]] = 0
                return True
        return False

    def contains(self, words: np.ndarray) -> np.ndarray:
        marks = self._marks(words[:, 1])
        one, two = self._places(words[:, 0], marks)
        return ((self.table[one] == marks[:, None]) | (self.table[two] == marks[:, None])).any(axis=1)


def _built(words: np.ndarray, shard: int) -> pd.DataFrame:
    own = CuckooFilter.of(words)
    return pd.DataFrame({"shard": [shard], "buckets": [own.buckets], "table": [own.table.tobytes()]})


def _loaded(buckets: int, table: bytes) -> CuckooFilter:
    return CuckooFilter(buckets, np.frombuffer(table, dtype=np.uint16).reshape(buckets, -1).copy())


_FILTERS = "shard int, buckets int, table binary"


@dataclass
class LineIndex:
    """The exact table of which document holds which line, and the filters of the frequent lines, in files under path.

    rows/batch=K: the rows of the K-th change. frequent/K and filters/K: the frequent lines with their last
    holder, and the filters, after it. shards is settled by the first change; a shard whose filter is full is
    built anew, larger, from the exact table.
    """

    spark: SparkSession
    path: str
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    batch: int = 0
    shards: int = 1

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        """An empty index; without a path, in the shared folder."""
        return cls(spark, path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}", min_chars, min_docs)

    def _lines(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """h1, h2, doc: a row for each long line of a document, equal lines once."""
        least = self.min_chars

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            owner, hashes = [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                own = set(split_lines(text, least)[2])
                hashes += own
                owner += [i] * len(own)
            if not hashes:
                return None
            words = as_words(hashes)
            return pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), batch.column(0).take(pa.array(owner, pa.int32()))], ["h1", "h2", "doc"])

        slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        return map_batches(slim, rows, f"h1 long, h2 long, doc {slim.schema['doc'].dataType.simpleString()}")

    def _change(self, docs: DataFrame, change: int, id_col: str, text_col: str) -> None:
        at = self.batch + 1
        lines = self._lines(docs, id_col, text_col)
        lines.withColumn("change", F.lit(change).cast("byte")).write.parquet(f"{self.path}/rows/batch={at}")
        if not self.batch:
            self.counts().where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc").write.parquet(f"{self.path}/frequent/{at}")
            self.batch = at
            self.shards = max(1, -(-self.frequent().count() // SHARD_KEYS))
            self._build(self.frequent()).write.parquet(f"{self.path}/filters/{at}")
            return
        touched = self.rows(at).where(F.col("batch") == at).select("h1", "h2").distinct()
        before = self.frequent()
        now = self.counts(self.rows(at).join(touched, ["h1", "h2"], "left_semi")).where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")
        before.join(touched, ["h1", "h2"], "left_anti").unionByName(now).write.parquet(f"{self.path}/frequent/{at}")
        after = self.spark.read.parquet(f"{self.path}/frequent/{at}")
        keys, gone = ["h1", "h2"], F.lit(-1).alias("sign")
        changes = after.join(before, keys, "left_anti").select(*keys, F.lit(1).alias("sign")).unionByName(before.join(after, keys, "left_anti").select(*keys, gone))
        self._updated(changes, after).write.parquet(f"{self.path}/filters/{at}")
        self.batch = at

    def _shard(self) -> Column:
        return F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")

    def _build(self, frequent: DataFrame) -> DataFrame:
        """The filters of these lines, built anew."""
        build = lambda pdf: _built(pdf[["h1", "h2"]].to_numpy(), int(pdf["shard"].iloc[0]))
        return frequent.select("h1", "h2", self._shard()).groupBy("shard").applyInPandas(build, _FILTERS)

    def _updated(self, changes: DataFrame, frequent: DataFrame) -> DataFrame:
        """The present filters after insertions (sign 1) and deletions (sign -1) of lines; full ones are built anew from the frequent lines."""

        def update(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
            if not len(lines):
                return own
            if not len(own):
                return _built(lines[["h1", "h2"]].to_numpy(), int(key[0]))
            out = _loaded(int(own["buckets"].iloc[0]), own["table"].iloc[0])
            for a, b, sign in lines.sort_values("sign")[["h1", "h2", "sign"]].itertuples(index=False):
                if not (out.insert(int(a), int(b)) if sign > 0 else out.delete(int(a), int(b))):
                    return pd.DataFrame({"shard": [int(key[0])], "buckets": [0], "table": [b""]})
            return pd.DataFrame({"shard": [int(key[0])], "buckets": [out.buckets], "table": [out.table.tobytes()]})

        done = cut(self.filters().groupBy("shard").cogroup(changes.select("h1", "h2", "sign", self._shard()).groupBy("shard")).applyInPandas(update, _FILTERS))
        full = done.where("buckets = 0").select("shard")
        anew = self._build(frequent.select("h1", "h2", self._shard()).join(full, "shard", "left_semi"))
        return done.where("buckets > 0").unionByName(anew)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._change(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Takes back documents as they were inserted; counts and filters are then as if they had never been."""
        self._change(docs, -1, id_col, text_col)

    def rows(self, upto: int | None = None) -> DataFrame:
        """h1, h2, doc, change, batch of all changes."""
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/batch={k}" for k in range(1, (upto or self.batch or 1) + 1)))

    def holders(self, rows: DataFrame | None = None) -> DataFrame:
        """h1, h2, doc of all lines that are held."""
        rows = self.rows() if rows is None else rows
        return rows.groupBy("h1", "h2", "doc").agg(F.sum("change").alias("held")).where("held > 0").drop("held")

    def counts(self, rows: DataFrame | None = None) -> DataFrame:
        """The reference counts: h1, h2, n_docs, last_doc."""
        return self.holders(rows).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))

    def frequent(self) -> DataFrame:
        """h1, h2, last_doc of the lines that stand in min_docs documents or more."""
        return self.spark.read.parquet(f"{self.path}/frequent/{self.batch}")

    def filters(self) -> DataFrame:
        """shard, buckets, table: the stored cuckoo filter of each shard that has had lines."""
        return self.spark.read.parquet(f"{self.path}/filters/{self.batch}")


#: The worker's filters for the job at hand.
_filters: dict[str, dict[int, CuckooFilter]] = {}


def rewrite(docs: DataFrame, index: LineIndex, *, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs, their texts without the superfluous lines of the index; with ``counts`` also n_lines and n_dropped.

    A frequent line loses all its places except those in the largest id that holds it.
    """
    spark, least, shards, job = docs.sparkSession, index.min_chars, index.shards, uuid.uuid4().hex
    frequent, filters = index.frequent(), index.filters()
    size = filters.agg(F.coalesce(F.sum(F.octet_length("table")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast([(r["shard"], r["buckets"], bytes(r["table"])) for r in filters.toLocalIterator()]) if size <= FILTER_BYTES else None

    def passing(words: np.ndarray) -> np.ndarray:
        """Whether the broadcast filters may hold these lines."""
        if job not in _filters:
            _filters.clear()
            _filters[job] = {s: _loaded(b, t) for s, b, t in sent.value}
        out, shard = np.zeros(len(words), dtype=bool), words[:, 0] % shards
        for s, f in _filters[job].items():
            at = np.flatnonzero(shard == s)
            out[at] = f.contains(words[at])
        return out

    def possible(texts: list[bytes]) -> np.ndarray:
        """Whether a text may hold a frequent line; any may where filters are not broadcast."""
        if sent is None:
            return np.ones(len(texts), dtype=bool)
        own, hashes, out = [], [], np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            found = split_lines(text, least)[2]
            hashes += found
            own += [i] * len(found)
        if hashes:
            out[np.array(own)[passing(as_words(hashes))]] = True
        return out

    def passing_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(passing(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))))

    def probe(key: tuple, keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(own):
            return keys[["h1", "h2"]].iloc[:0]
        return keys[["h1", "h2"]][_loaded(int(own["buckets"].iloc[0]), own["table"].iloc[0]).contains(keys[["h1", "h2"]].to_numpy())]

    def candidates() -> DataFrame:
        """The rows of the exact table whose lines pass the filters."""
        rows = index.rows().select("h1", "h2", "doc", "change")
        if sent is not None:
            return map_batches(rows, passing_rows, rows.schema)
        keys = rows.select("h1", "h2").distinct()
        parts = max(1, -(-keys.count() // (PROBED_KEYS * shards)))  # of each shard's lines
        dealt = keys.select("h1", "h2", index._shard(), F.pmod("h2", F.lit(parts)).cast("int").alias("part"))
        copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        kept = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe, "h1 long, h2 long")
        return rows.join(kept, ["h1", "h2"], "left_semi")

    names = docs.columns
    if counts and (clash := {"n_lines", "n_dropped"} & set(names)):
        raise ValueError(f"the input has columns that counts=True would add: {', '.join(sorted(clash))}")
    at = names.index(text_col)
    extra = ", n_lines long, n_dropped long" if counts else ""
    schema = _ddl(docs) + extra

    def with_counts(batch: pa.RecordBatch, lines: list[int], dropped: list[int]) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        if counts:
            columns += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"][: len(columns)])

    def untouched(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~possible(texts_of(batch.column(at)))))
        return with_counts(batch, [t.count(b"\n") + 1 for t in texts_of(batch.column(at))], [0] * batch.num_rows)

    def touched(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(possible(texts_of(batch.column(at)))))

    def dropped(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, gone = [], [], []
        for text, drops in zip(texts_of(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
            every, places, hashes = split_lines(text, least)
            lines.append(len(every))
            drops = set(drops or ())
            out = {i for i, h in zip(places, hashes, strict=True) if h in drops}
            gone.append(len(out))
            texts.append(b"\n".join(x for i, x in enumerate(every) if i not in out).decode() if out else None)
        old = batch.column(at).to_pylist()
        new = pa.array([o if t is None else t for o, t in zip(old, texts, strict=True)], batch.column(at).type)
        batch = batch.set_column(at, batch.schema.field(at), new)
        return with_counts(batch, lines, gone)

    superfluous = index.holders(candidates()).join(frequent, ["h1", "h2"]).where(F.col("doc") < F.col("last_doc"))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        return pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in words], pa.binary()), batch.column(2)], ["hash", "_holder"])

    kind = docs.schema[id_col].dataType.simpleString()
    drops = map_batches(superfluous.select("h1", "h2", "doc"), digests, f"hash binary, _holder {kind}").groupBy("_holder").agg(F.collect_list("hash").alias("_drops"))
    hit = map_batches(docs, touched, docs.schema)
    hit = hit.join(drops, F.col(f"`{id_col}`") == F.col("_holder"), "left").select(*(F.col(f"`{c}`") for c in names), "_drops")
    return map_batches(docs, untouched, schema).unionByName(map_batches(hit, dropped, schema))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with all their columns, without the lines that stand in ``min_docs`` documents or more, except in the largest id that holds them.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys shorter than
    ``min_chars`` code points never count. With ``counts``, n_lines (before) and n_dropped follow. A null
    text is one empty line and stays null; empty texts stay. Documents without an id neither count nor
    change. Rows that share an id count as one document. Input columns may bear any names but n_lines
    and n_dropped when these are asked for. An empty table gives an empty result.
    """
    index = LineIndex.create(docs.sparkSession, min_chars=min_chars, min_docs=min_docs)
    index.insert(docs, id_col, text_col)
    return rewrite(docs, index, id_col=id_col, text_col=text_col, counts=counts)
