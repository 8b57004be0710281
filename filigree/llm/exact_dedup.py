"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so: after some code points a chunk ends behind the next place
where a certain kind of word ends and another begins, so an edit moves the cuts near it alone. Every
chunk gets an identifier of 64-bit digests, and the identifiers are verified: each distinct chunk is
shuffled once, and no two chunks of different content may share an identifier. Should two do so, all
identifiers get a further digest and are verified anew. A text then is its recipe, the ordered list of
its chunks' identifiers, and texts are equal exactly if their recipes are. Only recipes are grouped and
joined; long texts don't move again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir

#: Code points of a chunk: at least, where the text goes on, and at most.
LEAST, MOST = 256, 8_192
#: What a cut follows: two letters of certain kinds, white space, and a third kind ahead.
TRIGGER = r"[d-h][r-z]\s(?=[a-d])"
#: Digests of an identifier to begin with.
DIGESTS = 2
#: Salts of a group at least, and rows for which there is one more.
SALTS, SALT_ROWS = 64, 1_000_000
#: Rows to drop that are broadcast, 8 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{LEAST},{MOST}}}?(?:{TRIGGER})|.{{1,{MOST}}}"), F.lit(0))


def digest(chunk: Column, k: int) -> Column:
    """The k-th digest of a chunk. The number comes first, as it seeds the hash of what follows."""
    return F.xxhash64(F.lit(k), chunk)


def verified_digests(texts: DataFrame, at_least: int = DIGESTS, digest_of=digest) -> int:
    """How many digests tell all chunks of ``texts`` (text) apart."""
    n = at_least
    while True:
        names = [f"h{k}" for k in range(n)]
        pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        distinct = pieces.select(*(digest_of(F.col("chunk"), k).alias(name) for k, name in enumerate(names)), "chunk").distinct()
        if distinct.groupBy(*names).count().where("count > 1").isEmpty():
            return n
        n += 1


def recipe(text: Column, n: int, digest_of=digest) -> Column:
    """The identifiers of a text's chunks in order, n numbers each."""
    return F.flatten(F.transform(chunks(text), lambda c: F.array(*(digest_of(c, k) for k in range(n)))))


def judged(docs: DataFrame, id_col: str, text_col: str, *, digest_of=digest, row: Column | None = None) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 of every row of docs; row is a number of its own.

    Rows are counted by recipe and salt first, so a text that a third of all rows hold is many groups,
    and the rows meet their totals by recipe and salt again.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    n = verified_digests(slim, digest_of=digest_of)
    marked = cut(slim.select("row", "doc_id", recipe(F.col("text"), n, digest_of).alias("recipe"), F.sha2("text", 256).alias("text_sha256")))
    salts = max(SALTS, -(-marked.count() // SALT_ROWS))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    part = salted.groupBy("recipe", "salt").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
    whole = part.groupBy("recipe").agg(F.sum("n").alias("group_size"), F.max("last").alias("last"))
    named = part.select("recipe", "salt").join(whole, "recipe")
    return salted.join(named, ["recipe", "salt"]).select("row", "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")


def find_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_of=digest) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical; null is the empty text, whose recipe is empty and which is a
    text as any other. Of equal texts the row with the largest doc_id stays; of several rows with that
    id, one. A null id is less than any other, so keep_id is null only if all rows of a group have none.
    Other columns are not read; an empty table gives an empty result.
    """
    return judged(docs, id_col, text_col, digest_of=digest_of).drop("row")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, the one that ``find_copies`` keeps; columns stay as they are.

    Rows are numbered and written once; the numbers to drop are broadcast if they are few.
    """
    number = "_row_" + uuid.uuid4().hex
    store = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/numbered-{number}"
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(store)
    rows = docs.sparkSession.read.parquet(store)
    gone = cut(judged(rows, id_col, text_col, row=F.col(number)).where(~F.col("kept")).select(F.col("row").alias(number)))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
