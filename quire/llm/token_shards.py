"""Operator 3: token ids in binary shards, one wavelet matrix per shard.

Documents are range-partitioned and sorted by id, so shard order is document
order.  Each task encodes its documents and packs whole documents into shards
of about ``SHARD_TOKENS`` ids.  A shard is one compressed binary file image:
for every bit of the ids, from the highest, a plane of bits with rank counts
per block.  It answers access, count, rank and select without being expanded.

The images are written as rows of a Parquet table in the shared folder (any
store Spark can write, with Spark's commit protocol, so a lost executor costs
a task and not a file), and read back from there.

Null and empty texts are documents with the end id alone.  Repeated ids follow
each other in order of their text; a null id comes first.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, read_local
from quire.llm.pretokens import WHITE, Splitter
from quire.session import scratch_path

END_ID = 0
SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits between two stored rank counts
_MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of ids below 2**bits as ``bits`` planes of n bits.

    Plane k holds bit ``bits - 1 - k`` of every id; after each plane the ids
    are stably reordered, zeros first.
    """

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur = np.ascontiguousarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
        if len(cur) and int(cur.max()) >> bits:
            raise ValueError("an id needs more bits")
        zeros, planes, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (cur & cur.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            ranks.append(cls._block_ranks(plane))
            low = np.flatnonzero(~ones)      # positions: indexing by them is faster than by a mask of mixed bits
            zeros.append(len(low))
            cur = np.concatenate((cur[low], cur[np.flatnonzero(ones)]))
        return cls(len(ids), bits, zeros, planes, ranks)

    @staticmethod
    def _block_ranks(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        per = BLOCK // 8
        padded = np.zeros(-(-max(len(plane), 1) // per) * per, np.uint8)
        padded[:len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, per).sum(axis=1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    def _ones_before(self, k: int, i: int) -> int:
        block = i // BLOCK
        first = block * (BLOCK // 8)
        total = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][first:i >> 3]).sum())
        if i & 7:
            total += (int(self.planes[k][i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return total

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            one = (int(self.planes[k][i >> 3]) >> (i & 7)) & 1
            before = self._ones_before(k, i)
            i = self.zeros[k] + before if one else i - before
            value = value << 1 | one
        return value

    def _narrow(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` before ``end`` lie below the last plane."""
        lo, hi = 0, end
        for k in range(self.bits):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of ``symbol`` before position ``end``."""
        if symbol >> self.bits:
            return 0
        lo, hi = self._narrow(symbol, min(max(end, 0), self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, j: int) -> int:
        """Position of the j-th occurrence of ``symbol``, from 0; IndexError beyond the last."""
        if symbol >> self.bits:
            raise IndexError(j)
        lo, hi = self._narrow(symbol, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - k) & 1
            i = self._place(k, one, i - self.zeros[k] if one else i)
        return i

    def _place(self, k: int, one: int, j: int) -> int:
        """Position of the j-th bit ``one`` of plane k."""
        starts = np.arange(len(self.ranks[k]), dtype=np.int64) * BLOCK
        before = self.ranks[k].astype(np.int64) if one else starts - self.ranks[k]
        block = int(np.searchsorted(before, j, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[k][first:first + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(before[block])])

    def positions(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """The whole sequence, undoing the reordering from the last plane up."""
        cur = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            prev = np.empty_like(cur)
            prev[np.flatnonzero(~ones)] = cur[:self.zeros[k]]
            prev[np.flatnonzero(ones)] = cur[self.zeros[k]:] | cur.dtype.type(1 << (self.bits - 1 - k))
            cur = prev
        return cur

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [_MAGIC, struct.pack("<QB", self.n, self.bits)]
        for zeros, plane, ranks in zip(self.zeros, self.planes, self.ranks, strict=True):
            a, b = pack(plane.tobytes()), pack(ranks.tobytes())
            out += [struct.pack("<QQQ", zeros, len(a), len(b)), a, b]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        if image[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        unpack = zstandard.ZstdDecompressor().decompress
        n, bits = struct.unpack_from("<QB", image, 4)
        at, zeros, planes, ranks = 13, [], [], []
        for _ in range(bits):
            z, a, b = struct.unpack_from("<QQQ", image, at)
            at += 24
            zeros.append(z)
            planes.append(np.frombuffer(unpack(image[at:at + a]), np.uint8) if n else np.empty(0, np.uint8))
            ranks.append(np.frombuffer(unpack(image[at + a:at + a + b]), np.uint32))
            at += a + b
        return cls(n, bits, zeros, planes, ranks)


class Encoder:
    """A byte-level ``tokenizers`` model applied to each distinct pre-token once per memo.

    Merges never cross pre-tokens, so a text's ids are those of its pre-tokens
    in turn.  New pre-tokens are handed to the library many at a time, those
    that start with a space one after another and the others a line each; the
    bytes that each id stands for tell where one ends.  Texts outside Latin-1,
    and those that hold an added token's content (such as ``<|endoftext|>``, which
    gives its one id), go to the library whole.
    """

    def __init__(self, model: str, memo_limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.added = [t["content"] for t in json.loads(model)["added_tokens"]]
        self.splitter = Splitter()
        self.memo: dict[str, bytes] = {}
        self.memo_limit = memo_limit
        vocabulary = self.model.get_vocab()
        self.bits = max(1, max(vocabulary.values(), default=0).bit_length())
        self.id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():         # a byte-level token has one character for every byte
            self.id_bytes[i] = len(token)

    def _coded(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: set[str]) -> None:
        blank = [p for p in pieces if p[-1] in WHITE]
        self.memo.update((p, self._coded(p).tobytes()) for p in blank)
        words = pieces.difference(blank)
        spaced = [p for p in words if p[0] == " "]
        for group, between in ((spaced, ""), (list(words.difference(spaced)), "\n")):
            for at in range(0, len(group), 2048):
                self._learn_joined(group[at:at + 2048], between)

    def _holds_added(self, text: str) -> bool:
        return any(c in text for c in self.added)

    def _learn_joined(self, group: list[str], between: str) -> None:
        joined = between.join(group)
        if self._holds_added(joined):                # made by joining; no piece holds one
            self.memo.update((p, self._coded(p).tobytes()) for p in group)
            return
        ids = self._coded(joined)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.id_bytes[ids])))
        size = np.array([len(p.encode()) for p in group])
        last = np.cumsum(size + len(between)) - len(between)
        starts, ends = np.searchsorted(at, last - size), np.searchsorted(at, last)
        if at[-1] != last[-1] or (at[starts] != last - size).any() or (at[ends] != last).any():
            raise RuntimeError("the model splits text otherwise than its pre-tokens")
        packed = ids.tobytes()
        self.memo.update(zip(group, [packed[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)],
                             strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.memo) > self.memo_limit:
            self.memo.clear()
        split = [self.splitter.split(t) if t and self.splitter.is_latin(t) and not self._holds_added(t) else None
                 for t in texts]
        new = set().union(*(p for p in split if p)).difference(self.memo)
        if new:
            self._learn(new)
        look = self.memo.__getitem__
        return [b"".join(map(look, p)) if p is not None
                else self._coded(t).tobytes() if t
                else b""
                for t, p in zip(texts, split, strict=True)]


_LOADED: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """The worker's encoder: a Python worker that runs several tasks keeps it, memo included."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(model.decode())
    return _LOADED[key]


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("image", pa.binary())])


def write_shards(docs: DataFrame, model_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text and write the shards to ``path`` in ascending id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(read_local(model_path))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        end = np.array([END_ID], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        coded: list[bytes] = []
        size = 0

        def image() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(coded), "<u4")
            row = {"part": part, "seq": seq, "doc_ids": ids, "lengths": [len(c) // 4 for c in coded],
                   "n_tokens": len(tokens), "image": WaveletMatrix.build(tokens, encoder.bits).to_bytes()}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, packed in zip(keys, encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(key)
                coded.append(packed + end)
                size += len(packed) // 4 + 1
                if size >= shard_tokens:
                    yield image()
                    ids, coded, size, seq = [], [], 0, seq + 1
        if ids:
            yield image()

    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange("id").sortWithinPartitions("id", "text")
     .mapInArrow(shards, "part int, seq long, doc_ids array<long>, lengths array<long>, n_tokens long, image binary")
     .write.parquet(path))


def read_shards(spark, path: str) -> DataFrame:
    """Shards with the position of their first id among all ids.

    Positions are summed in two steps, within a partition's shards and over
    the partitions, so no window holds more than one partition's shards or one
    row per partition.
    """
    shards = spark.read.parquet(path)
    ends = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq"))
    within = shards.select("part", "seq", (ends - F.col("n_tokens")).alias("before"))
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"))
    return shards.join(starts, ["part", "seq"])


def documents_of(shards: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids) read from the shards' images; ids are packed 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = WaveletMatrix.from_bytes(row["image"]).ids().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(tokens).cast("B")
                for at in range(0, len(lengths), 512):
                    a, b = ends[at:at + 512] - lengths[at:at + 512], ends[at:at + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][at:at + 512], pa.int64()), pa.array(a + row["start"], pa.int64()),
                         pa.array([bytes(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                                  pa.binary())], ["doc_id", "start", "ids"])

    return (shards.select("doc_ids", "lengths", "image", "start")
            .mapInArrow(rows, "doc_id long, start long, ids binary"))


def shard_path(spark) -> str:
    """A fresh folder for shards in the shared folder."""
    return scratch_path(spark, "token-shards")


def ids_crc32(packed: str) -> F.Column:
    """Unsigned crc32 of packed ids."""
    return F.crc32(F.col(packed))
