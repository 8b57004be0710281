"""Near-duplicates by SimHash fingerprints, found exactly with vantage-point trees.

Two fingerprints within four bits differ by at most one bit on one of four bands of 16 bits. For each
band a vantage-point tree splits the fingerprints by their distance from a vantage point on that band;
its leaves are the shards. A fingerprint lives in one shard of each tree and is also sent, as a query,
to every shard that the ball of radius one around it may reach by the triangle inequality. Inside a
shard the tree goes on: branches that the bounds rule out are pruned, and what is left is compared on
all 64 bits. The trees are built on the driver from counts of band values, 65,536 a band at most, which
do not grow with the corpus. Shards of a crowded place are cut into pieces of bounded size that are
compared piece by piece, and links leave a shard as a spanning forest, never as all pairs.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, cut, map_batches, texts_of
from .components import connected

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints that live in a shard, about, and at most in a piece of one; queries at most in a piece.
SHARD, PIECE, QUERY_PIECE = 4_096, 50_000, 400_000
#: Pairs that are compared outright, and that are held at a time.
FEW, PAIRS = 4_096, 4_000_000
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """The majority bits of the XXH64 hashes of all four-word shingles; 0 for no words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[WORDS - 1 :], strict=False)]
    n = len(hashes)
    rows = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    rows[:n] = hashes
    rows = rows.reshape(-1, 255)  # a byte counts up to 255
    counts = np.empty((8, 8), dtype=np.int64)  # byte, bit
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).reshape(-1), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (as a signed number)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, rows, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


# --- trees over bands ---------------------------------------------------------------------------


def masks(n: int) -> list[tuple[int, int]]:
    """(mask, band) for n fingerprints: two within four bits differ by at most one bit on one of the masks.

    Of b parts of the 64 bits, four flips leave some b - 3 with at most one flip between them. More
    parts make masks longer and shards thinner, so a part is added when the corpus outgrows the masks.
    The band is the 16 bits of a mask by which its shards are told apart.
    """
    parts = 4 if n <= 1 << 25 else 5 if n <= 1 << 34 else 6
    cuts = [64 * i // parts for i in range(parts + 1)]
    bits = [sum(1 << k for k in range(a, b)) for a, b in itertools.pairwise(cuts)]
    out = []
    for chosen in itertools.combinations(bits, parts - 3):
        mask = sum(chosen)
        own = [k for k in range(64) if mask >> k & 1]
        spread = own if len(own) <= 16 else [own[i * len(own) // 16] for i in range(16)]
        out.append((mask, sum(1 << k for k in spread)))
    return out


def band_values(fps: np.ndarray, band: int) -> np.ndarray:
    """The bits of a band next to each other, 0 to 65535."""
    out = np.zeros(len(fps), dtype=np.uint16)
    for at, bit in enumerate(k for k in range(64) if band >> k & 1):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.uint16) << np.uint16(at)
    return out


@dataclass
class Tree:
    """home: the leaf of each band value. reach[first[v]:first[v + 1]]: the leaves that the ball around v may reach. pieces: into how many pieces each leaf is cut, for what lives there and for queries."""

    home: np.ndarray
    first: np.ndarray
    reach: np.ndarray
    pieces: np.ndarray


def vantage_tree(counts: np.ndarray, size: int = SHARD, reach: int = 1) -> Tree:
    """A vantage-point tree over the 65,536 band values, with leaves of about size fingerprints by counts."""
    values = np.arange(1 << 16, dtype=np.uint16)
    home, owners, leaves, sizes = np.zeros(1 << 16, dtype=np.int32), [], [], []
    draw = np.random.default_rng(SEED)
    stack = [(values, values)]
    while stack:
        own, queries = stack.pop()
        inside = outer = None
        if counts[own].sum() > size and len(own) > 1:
            point = own[draw.choice(len(own))]
            far, far_queries = np.bitwise_count(own ^ point), np.bitwise_count(queries ^ point)
            order = np.argsort(far, kind="stable")
            total = np.cumsum(counts[own[order]])
            bound = far[order][np.searchsorted(total, total[-1] / 2)]
            if bound == far.max():
                bound -= 1
            inside, outer = far <= bound, far > bound
        if inside is None:
            home[own] = len(leaves)
            owners.append(queries)
            leaves.append(np.full(len(queries), len(leaves), dtype=np.int32))
            sizes.append((-(-int(counts[own].sum()) // PIECE) or 1, -(-int(counts[queries].sum()) // QUERY_PIECE) or 1))
            continue
        stack.append((own[inside], queries[far_queries <= bound + reach]))
        stack.append((own[outer], queries[far_queries + reach > bound]))
    owner, leaf = np.concatenate(owners), np.concatenate(leaves)
    order = np.argsort(owner, kind="stable")
    return Tree(home, np.searchsorted(owner[order], np.arange((1 << 16) + 1)), leaf[order], np.array(sizes, dtype=np.int64))


def routed(fps: DataFrame, chosen: list[tuple[int, int]], trees) -> DataFrame:
    """shard, lives, fp: each fingerprint in its shards and in those that its ball may reach, by piece."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        spread = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, ((_, band), tree) in enumerate(zip(chosen, trees.value, strict=True)):
            value = band_values(fp, band)
            n = tree.first[value.astype(np.int64) + 1] - tree.first[value]
            at = np.repeat(np.arange(len(fp)), n)
            leaf = tree.reach[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tree.first[value], n)]
            # an own copy for each piece of queries, a query copy for each piece of what lives there
            for lives, who, where in ((True, np.arange(len(fp)), tree.home[value]), (False, at, leaf)):
                own_pieces, query_pieces = tree.pieces[where, 0], tree.pieces[where, 1]
                times = query_pieces if lives else own_pieces
                row = np.repeat(np.arange(len(who)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = (spread[who[row]] % (own_pieces if lives else query_pieces)[row].astype(np.uint64)).astype(np.int64)
                piece = mine * query_pieces[row] + other if lives else other * query_pieces[row] + mine
                out.append(((np.int64(k) << 56) | (where[row].astype(np.int64) << 32) | piece, np.full(len(row), lives), fp[who[row]]))
        shard, lives, own = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(lives), pa.array(own.view(np.int64))], ["shard", "lives", "fp"])

    return map_batches(fps, rows, "shard long, lives boolean, fp long")


# --- search inside a shard ------------------------------------------------------------------------


class Forest:
    """Classes of linked fingerprints, by place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        out = self.parent[places]
        while (up := self.parent[out]).tobytes() != out.tobytes():
            out = up
        self.parent[places] = out
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]: the larger roots hang themselves on the smaller until all agree."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def search_shard(own: np.ndarray, queries: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all of own and queries whose pairs (one of own, one query) lie within RADIUS and differ by at most one bit on the mask; a spanning forest."""
    fps, place = np.unique(np.concatenate([own, queries]), return_inverse=True)
    own, queries = np.unique(place[: len(own)]), np.unique(place[len(own) :])
    forest, on_mask = Forest(len(fps)), fps & np.uint64(mask)

    def compare(own: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(queries)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            roots = forest.roots(part)
            rest = queries
            if len(part) > 1 and (roots == roots[0]).all():  # queries that already belong to the only class need no test
                rest = queries[forest.roots(queries) != roots[0]]
            near = np.bitwise_count(fps[part][:, None] ^ fps[rest][None, :]) <= RADIUS
            i, j = np.nonzero(near)
            forest.link(part[i], rest[j])

    stack = [(own, queries, True)]
    while stack:
        own, queries, banded = stack.pop()
        if not len(own) or not len(queries):
            continue
        if len(own) * len(queries) <= FEW or len(own) <= 8:
            compare(own, queries)
            continue
        keys, reach = (on_mask, 1) if banded else (fps, RADIUS)
        point = keys[own[len(own) // 2]]
        far, far_queries = np.bitwise_count(keys[own] ^ point), np.bitwise_count(keys[queries] ^ point)
        if not banded:
            # whatever lies within half the radius of one fingerprint is linked, without a look at its pairs
            ball = own[far <= RADIUS // 2]
            forest.link(ball, np.full(len(ball), own[len(own) // 2]))
        low, high = far.min(), far.max()
        bound = min(np.partition(far, len(far) // 2)[len(far) // 2], high - 1) if low < high else None
        if bound is None or not banded and (far <= bound).sum() * 8 > 7 * len(own):
            if banded:
                stack.append((own, queries, False))
            else:
                compare(own, queries)
            continue
        stack.append((own[far <= bound], queries[far_queries <= bound + reach], banded))
        stack.append((own[far > bound], queries[far_queries + reach > bound], banded))
    every = np.arange(len(fps))
    roots = forest.roots(every)
    moved = roots != every
    return fps[every[moved]], fps[roots[moved]]


def links(fps: DataFrame) -> DataFrame:
    """u, v: links that connect exactly the fingerprints that chains of steps within RADIUS bits connect. fps: fp, all different."""
    spark, n = fps.sparkSession, fps.count()
    chosen = masks(n)

    def values(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        each = [np.unique(band_values(fp, band), return_counts=True) for _, band in chosen]
        tree = np.repeat(np.arange(len(each)), [len(v) for v, _ in each])
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(np.concatenate([v for v, _ in each]), pa.int32()), pa.array(np.concatenate([c for _, c in each]), pa.int64())], ["tree", "value", "n"])

    counts = np.zeros((len(chosen), 1 << 16), dtype=np.int64)
    counted = map_batches(fps, values, "tree int, value int, n long").groupBy("tree", "value").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most 65,536 rows for each mask
    counts[table["tree"].to_numpy(), table["value"].to_numpy()] = table["n"].to_numpy()
    trees = spark.sparkContext.broadcast([vantage_tree(c) for c in counts])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, lives = pdf["fp"].to_numpy().view(np.uint64), pdf["lives"].to_numpy()
        a, b = search_shard(fp[lives], fp[~lives], chosen[int(pdf["shard"].iloc[0]) >> 56][0])
        return pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    return routed(fps, chosen, trees).groupBy("shard").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every whole text and its class under links of at most four differing bits.

    Returns doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id: the least doc_id
    reachable over links, its own included. Null and empty texts and texts of white space have
    fingerprint zero and link as any other. A null id never names a class; a class of null ids only has
    a null component_id. Repeated rows are kept; other columns are not read; an empty table gives an
    empty result.
    """
    marked = cut(with_fingerprints(docs, id_col, text_col))
    classes = fingerprint_classes(marked)
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_classes(marked: DataFrame) -> DataFrame:
    """fp, root, component_id for each fingerprint of marked (doc_id, fp); root tells the classes apart."""
    each = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(each.select("fp")))
    rooted = each.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


#: Bytes of ids to remove that are broadcast, with 32 a row for their table; more are joined by shuffle.
BROADCAST_BYTES = 32_000_000


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, the one with the least id; columns stay as they are.

    Rows without an id stay. Of rows that share an id, one stays for each class that the id leads; rows
    whose id has texts of several classes are told apart by their fingerprints.
    """
    marked = cut(with_fingerprints(docs, id_col, text_col))
    found = cut(marked.join(fingerprint_classes(marked), "fp").where("doc_id IS NOT NULL").select("doc_id", "fp", "root", "component_id"))
    again = cut(found.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("several")).where("n > 1"))
    several = again.where("several").select(F.col("doc_id").alias("_several"))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).unionByName(several.withColumnRenamed("_several", "_gone")).distinct()
    size = gone.agg(F.coalesce(F.sum(F.octet_length(F.col("_gone").cast("string")) + 32), F.lit(0))).first()[0]
    key = F.col(f"`{id_col}`")
    kept = docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, key == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return kept
    copies = again.where("NOT several").select(F.col("doc_id").alias("_again"))
    once = kept.join(copies, key == F.col("_again"), "left_semi").dropDuplicates([id_col])
    kept = kept.join(copies, key == F.col("_again"), "left_anti").unionByName(once)
    if several.isEmpty():
        return kept
    at = docs.columns.index(text_col)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts_of(batch.column(at))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, "_fp"])

    told = map_batches(docs.join(several, key == F.col("_several"), "left_semi"), rows, StructType([*docs.schema.fields, StructField("_fp", LongType())]))
    leads = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_lead"), F.col("fp").alias("_of"), F.col("root").alias("_root")).distinct()
    first = told.join(leads, (key == F.col("_lead")) & (F.col("_fp") == F.col("_of"))).dropDuplicates([id_col, "_root"])
    return kept.unionByName(first.select(*(F.col(f"`{c}`") for c in docs.columns)))
