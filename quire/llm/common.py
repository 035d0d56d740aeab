"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* a null text counts as the empty text;
* working columns are chosen by the operator, so extra columns of the input,
  whatever their names, are never read and never clash; an output column whose
  name the input has already takes the next free one (:func:`free_name`);
* repeated rows are treated one by one, as rows of their own;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table

#: Rows per Arrow batch: texts reach 100 kB and more, and a Python worker holds a few
#: copies of a batch, so memory is bounded by rows per batch times the longest texts.
BATCH_ROWS = 256

MASK64 = (1 << 64) - 1


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` when it is above."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``documents`` with the wanted columns, read in bounded Arrow batches."""
    bounded_batches(spark)
    return read_table(spark, sf_dir, "documents", list(columns) or None)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes for ``docs`` not to have it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def read_local(path: str, limit: int = 64 << 20) -> bytes:
    """A model or vocabulary file of bounded size, read once on the driver."""
    size = os.path.getsize(path)
    if size > limit:
        raise ValueError(f"{path} has {size} bytes; at most {limit} are broadcast")
    with open(path, "rb") as f:
        return f.read()


_KEPT: dict[tuple, object] = {}


def per_worker(key: tuple, build):
    """What ``build()`` makes, kept for the next tasks of this Python worker; a new key takes the old one's place."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes, nulls as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


class WordCodes:
    """Dense codes and 64-bit hashes for words, kept over the batches of a task.

    ``codes`` maps words to small integers; ``hashes`` gives the 64-bit hash of
    each code.  The table starts anew once it holds ``limit`` words, so a task
    over any amount of text keeps bounded memory (hashes do not depend on it).
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.known = np.empty(1 << 12, np.uint64)

    def hash_words(self, words: list[bytes]) -> np.ndarray:
        """uint64 hash of each word."""
        if not words:
            return np.empty(0, np.uint64)
        if len(self.table) > self.limit:
            self._clear()
        table = self.table
        for w in set(words).difference(table):
            n = len(table)
            if n == len(self.known):
                self.known = np.resize(self.known, 2 * n)
            self.known[n] = xxhash.xxh3_64_intdigest(w)
            table[w] = n
        return self.known[np.fromiter(map(table.__getitem__, words), np.int64, len(words))]


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible bit mixing, so that close sums give unrelated hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive words (empty with fewer words)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out = out * base + word_hashes[i:i + n]
    return mix64(out)


def sequence_hash(word_hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence; its length is part of the hash."""
    h = window_hashes(word_hashes, len(word_hashes))
    return mix64(h + np.uint64(len(word_hashes)))
