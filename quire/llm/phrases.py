"""Operator 12: phrase collocation mining by SON partitioning, per language.

Frequent phrases (1 to ``longest`` words, at least ``support`` occurrences in
their language) are found in two passes over the texts:

1. *mine*: every partition of the documents belongs to one of ``SHARDS``
   shards.  Tasks count all their phrases and hand the counts to the shard's
   merge, dealt out by phrase hash.  A phrase with ``support`` occurrences has
   ``support / SHARDS`` of them in some shard, so each shard is mined whole at
   that local support, and no frequent phrase is missed.
2. *count*: the union of the shards' phrases is a bitmap of their hashes, of
   fixed size (``FILTER_BITS``).  The texts are read again, every phrase in the
   bitmap is counted as itself, and those short of the support go.  A clash of
   hashes only lets a phrase be counted in vain.

The shards' number is fixed, so the local support stays above 1 at any size;
what grows with the input is spread over hash buckets.  Collocations are then
joins and aggregates of the frequent phrases: :func:`score`, :func:`covered`.

Defined results: a null text has no words, a null language is ``und``;
repeated rows count as often as they stand there; an empty table gives no
phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, mix64
from quire.session import materialize

SUPPORT = 30
LONGEST = 4
SHARDS = 6
FILTER_BITS = 27            # the bitmap has 2**27 bits: 16 MB
BLOCK_WORDS = 1 << 20       # words of a language that are counted together in a task
KEPT_COUNTS = 1 << 20       # counts that a task holds before it hands them on
NO_LANGUAGE = "und"

# Capitals that are lowered, and the characters that end a piece.
_LOWER = bytes(range(0x41, 0x5B))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = 0xFF               # never a byte of UTF-8
_TABLE = bytes(b + 32 if b in _LOWER else _BREAK if b in _ENDS else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Small codes of words, from 1; 0 is the end of a piece."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {bytes([_BREAK]): 0}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1 << 12, np.uint64)

    def encode(self, text: bytes) -> np.ndarray:
        """Codes of the words of a text, with 0 between pieces and after the last."""
        words = (text.translate(_TABLE).replace(b"\xff", b" \xff ") + b" \xff").split()
        codes = self.codes
        for w in set(words).difference(codes):
            n = codes[w] = len(self.words)
            self.words.append(w)
            if n == len(self.hashes):
                self.hashes = np.resize(self.hashes, 2 * n)
            self.hashes[n] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def counted(codes: np.ndarray, longest: int, keep=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, a position, occurrences) of the distinct phrases of every length.

    Phrases are told apart by exact numbers, a prefix's number times the
    number of codes plus the next code.  With ``keep(n, positions)`` only the
    phrases it marks are returned and made longer.
    """
    n_codes = int(codes.max(initial=0)) + 1
    at = np.flatnonzero(codes)
    prefix = np.zeros(len(codes) + longest, np.int64)
    padded = np.concatenate((codes, np.zeros(longest, codes.dtype)))
    for n in range(1, longest + 1):
        if not len(at):
            return
        keys = prefix[at] * n_codes + padded[at + n - 1]
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1]))
        starts = np.flatnonzero(fresh)
        counts = np.diff(np.append(starts, len(order)))
        first = at[order[starts]]
        kept = np.ones(len(starts), bool) if keep is None else keep(n, first)
        if n < longest:
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(fresh) - 1
            on = kept[number] & (padded[at + n] > 0)
            prefix[at] = number
            at = at[on]
        yield n, first[kept], counts[kept]


def phrase_hashes(word_hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, n: int, language: int) -> np.ndarray:
    """64-bit hashes of the phrases of ``n`` words at the positions."""
    out = np.full(len(at), np.uint64(language) + np.uint64(n))
    for k in range(n):
        out = out * _BASE + word_hashes[codes[at + k]]
    return mix64(out)


class _Blocks:
    """The words of a task, by language, in blocks of bounded size."""

    def __init__(self):
        self.table = Words()
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, language: str, texts: list[bytes]) -> None:
        codes = self.table.encode(b"\n".join(texts))
        self.parts.setdefault(language, []).append(codes)
        self.size += len(codes)

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_WORDS

    def drain(self) -> Iterator[tuple[str, np.ndarray]]:
        for language, parts in self.parts.items():
            yield language, np.concatenate(parts)
        self.parts, self.size = {}, 0
        if len(self.table.words) > self.table.limit:
            self.table.clear()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, str, np.ndarray]]:
    """(word table, language, codes) of the documents of a task, rows (language, text)."""
    held = _Blocks()
    for batch in batches:
        by_language: dict[str, list[bytes]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            held.add(language, texts)
            if held.full:
                for found, codes in held.drain():
                    yield held.table, found, codes
    for found, codes in held.drain():
        yield held.table, found, codes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _language_hash(language: str) -> int:
    return xxhash.xxh3_64_intdigest(language.encode()) >> 1


@dataclass
class Mined:
    """The union of the shards' phrases: a bitmap over the top bits of their hashes."""

    bits: int
    slices: list[tuple[int, bytes]] = field(default_factory=list)
    buckets: int = 1

    def bitmap(self) -> np.ndarray:
        out = np.zeros((1 << self.bits) // 8, np.uint8)
        size = len(out) // self.buckets
        for bucket, packed in self.slices:
            out[bucket * size:(bucket + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return out


def _holds(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def mine(texts: DataFrame, support: int, longest: int, shards: int, bits: int) -> Mined:
    """First pass over (language, text): what is frequent in some shard at its share of the support."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = min(bits - 3, max(8, (8 * parts - 1).bit_length()))
    local = -(-support // shards)
    kind = np.min_scalar_type(support)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            """A row for every bucket: the top bits of a hash are its bucket, the next 32 are sent."""
            keys, sums = np.concatenate(hashes), np.concatenate(counts)
            hashes.clear()
            counts.clear()
            order = np.argsort(keys)
            keys, sums = keys[order], sums[order]
            edges = np.searchsorted(keys, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits))
            edges = np.append(edges, len(keys)).tolist()
            keys = ((keys << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
            filled = [b for b in range(1 << bucket_bits) if edges[b] < edges[b + 1]]
            for k in range(0, len(filled), 256):
                some = filled[k:k + 256]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()),
                    "hashes": pa.array([keys[edges[b]:edges[b + 1]].tobytes() for b in some], pa.binary()),
                    "counts": pa.array([sums[edges[b]:edges[b + 1]].tobytes() for b in some], pa.binary())})

        for table, language, codes in _blocks(batches):
            seed = _language_hash(language)
            for n, at, found in counted(codes, longest):
                hashes.append(phrase_hashes(table.hashes, codes, at, n, seed))
                counts.append(np.minimum(found, support).astype(kind))      # the support itself is all a count has to show
                size += len(at)
            if size >= KEPT_COUNTS:
                yield from out()
                size = 0
        if size:
            yield from out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition come bucket after bucket; a bucket is held at a time."""
        now, held = None, {}
        width = 1 << (bits - bucket_bits)

        def out() -> Iterator[pa.RecordBatch]:
            marks = np.zeros(width, bool)
            for rows in held.values():
                keys, sums = _summed(np.concatenate([k for k, _ in rows]), np.concatenate([c for _, c in rows]))
                marks[keys[sums >= local] >> np.uint32(32 - bits + bucket_bits)] = True
            if marks.any():
                packed = zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()),
                                                  "marks": pa.array([packed], pa.binary())})

        for batch in batches:
            for bucket, shard, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if held:
                        yield from out()
                    now, held = bucket, {}
                held.setdefault(shard, []).append((np.frombuffer(hashes, np.uint32),
                                                   np.frombuffer(counts, kind).astype(np.int64)))
        if held:
            yield from out()

    slices = (texts.mapInArrow(partial, "bucket int, shard int, hashes binary, counts binary")
              .repartition(parts, "bucket").sortWithinPartitions("bucket")
              .mapInArrow(merged, "bucket int, marks binary"))
    return Mined(bits, [(r.bucket, bytes(r.marks)) for r in slices.collect()], 1 << bucket_bits)


def count(texts: DataFrame, mined: Mined, longest: int) -> DataFrame:
    """Second pass: exact occurrences of every phrase in the bitmap, rows (lang, phrase, size, f).

    A row of size 0 holds the number of the language's words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(mined.bitmap().tobytes(), 1))
    bits = mined.bits

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for table, language, codes in _blocks(batches):
            seed = _language_hash(language)

            def keep(n: int, at: np.ndarray, seed=seed, codes=codes, table=table) -> np.ndarray:
                return _holds(bitmap, bits, phrase_hashes(table.hashes, codes, at, n, seed))

            yield _rows(language, [b""], 0, np.array([np.count_nonzero(codes)]))
            words = table.words
            for n, first, found in counted(codes, longest, keep):
                for k in range(0, len(first), 1 << 16):
                    at, some = first[k:k + (1 << 16)], found[k:k + (1 << 16)]
                    columns = [[words[c] for c in codes[at + i].tolist()] for i in range(n)]
                    yield _rows(language, list(map(b" ".join, zip(*columns))) if n > 1 else columns[0], n, some)

    return (texts.mapInArrow(partial, "lang string, phrase string, size int, f long")
            .groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")))


def _rows(language: str, phrases: list[bytes], n: int, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([language] * len(phrases), pa.string()),
        "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
        "size": pa.array([n] * len(phrases), pa.int32()), "f": pa.array(found, pa.int64())})


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS,
                     filter_bits: int = FILTER_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All phrases of 1 to ``longest`` words with ``support`` occurrences: (lang, phrase, size, f), written once.

    The rows of size 0 give each language's number of words.
    """
    if not 1 <= shards <= support:
        raise ValueError("shards must lie between 1 and the support")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    found = count(texts, mine(texts, support, longest, shards, filter_bits), longest)
    return materialize(found.where((F.col("size") == 0) | (F.col("f") >= support)), "phrases")


def _part(words: str, start, size) -> F.Column:
    return F.array_join(F.slice(words, start, size), " ")


def score(frequent: DataFrame) -> DataFrame:
    """Candidates (2 words and more) with the counts of their lowest-scoring cut: lang, phrase, a, l, r, score.

    ``score = floor(2000000 a / (l + r))`` in exact decimals; ties go to the
    shortest first part.  Both parts of a frequent phrase are frequent, so the
    joins find them.
    """
    cuts = (frequent.where("size >= 2")
            .select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("first"),
                    _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")))
    part = frequent.where("size >= 1")
    left = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    value = F.expr("cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))"
                   " div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", value)
    return (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
            .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))


def covered(frequent: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases (lang, phrase) inside a longer candidate that has at least ``percent`` of their occurrences."""
    long = frequent.where("size >= 3").select("lang", "size", "f", F.split("phrase", " ").alias("w"))
    inner = (long.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
             .groupBy("lang", _part("w", F.col("i"), F.col("n")).alias("phrase")).agg(F.max("f").alias("most")))
    enough = F.expr(f"cast(100 as decimal(3, 0)) * cast(most as decimal(19, 0))"
                    f" >= cast({int(percent)} as decimal(3, 0)) * cast(f as decimal(19, 0))")
    return (frequent.where("size >= 2").join(inner, ["lang", "phrase"]).where(enough).select("lang", "phrase"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = 2000,
                 shards: int = SHARDS, filter_bits: int = FILTER_BITS, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score."""
    frequent = frequent_phrases(docs, support, longest, shards, filter_bits, text_col, lang_col)
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (score(frequent).join(covered(frequent), ["lang", "phrase"], "left_anti")
              .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
