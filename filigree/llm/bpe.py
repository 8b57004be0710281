"""BPE encoding and decoding with the prefix dynamic programme of ``word_bpe.PrefixEncoder``.

Everything is map-only: ids and decoded text of a document depend on its text alone. Each worker
keeps the encoded pre-tokens it has met in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .word_bpe import byte_level, prefix_encoder, pretokenizer

#: Encoded pre-tokens that a worker keeps, of some 350 bytes each.
CACHE_ENTRIES = 400_000


class _Cache(dict):
    """Pre-token to its ids in decimal, joined by a space, and to the tokens that they decode to, likewise.

    In two generations: once the younger is full it becomes the older, whose pre-tokens come back as they are
    met again; so frequent ones stay and rare ones go.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encoder = prefix_encoder(path)
        self.decimal = {i: str(i) for i in self.encoder.names}
        self.older: dict[str, tuple[str, str]] = {}

    def __missing__(self, word: str) -> tuple[str, str]:
        out = self.older.get(word)
        if out is None:
            ids, decimal, names = self.encoder.encode(byte_level(word)), self.decimal, self.encoder.names
            out = (" ".join([decimal[i] for i in ids]), " ".join([names[i] for i in ids]))
        if len(self) >= CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


@functools.lru_cache(maxsize=4)
def _cache(path: str) -> _Cache:
    return _Cache(path)


def encode_text(text: str, tokenizer_path: str) -> tuple[str, str]:
    """The ids of a whole text in decimal, joined by a space, and the text that they decode to.

    Decoding joins the tokens by a space, as the library does for a file without a decoder.
    """
    pre, cached, decimal, names = pretokenizer(tokenizer_path), _cache(tokenizer_path), [], []
    for k, part in enumerate(pre.parts(text)):
        if k % 2:
            decimal.append(str(pre.special[part]))
            names.append(part)
        elif part:
            found = [cached[word] for word in pre.words(part)]
            decimal.extend([own for own, _ in found])
            names.extend([own for _, own in found])
    return " ".join(decimal), " ".join(names)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns doc_id, n_tokens, ids (array<int>) and decoded (string); with ``digests`` instead of the
    last two ids_sha256 (of the decimal ids joined by a space) and decoded_sha256. A null text counts
    as empty and gives no ids and an empty string. Null ids stay null, repeated rows are encoded each,
    further columns are not read, and an empty table gives an empty result.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = [encode_text(text or "", tokenizer_path) for text in batch.column(1).to_pylist()]
        counts = np.array([ids.count(" ") + 1 if ids else 0 for ids, _ in encoded], dtype=np.int64)
        if digests:
            ids, decoded = (pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in encoded], pa.string()) for k in (0, 1))
        else:
            values = np.fromstring(" ".join([ids for ids, _ in encoded if ids]), dtype=np.int32, sep=" ")
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))
            decoded = pa.array([x for _, x in encoded], pa.string())
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), ids, decoded], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, f"doc_id {kind}, n_tokens long, {rest}")
