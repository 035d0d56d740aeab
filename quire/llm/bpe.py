"""Operator 4: byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a pre-token
that is itself a token.  Second tier: every other pre-token is merged by rank
with a heap of candidate pairs over a linked list of its bytes.  Results of
both tiers are kept in a bounded per-task memo, as pre-tokens repeat.

Vocabulary and ranks are read on the driver (bounded file) and broadcast.
Null and empty texts give no ids; nothing is truncated.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import MASK64, bounded_batches, read_local
from quire.llm.pretokens import GPT_PATTERN, Splitter

_SALT, _MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class MinimalPerfectHash:
    """Hash and displace over n byte strings: each gets its own slot in 0..n-1.

    Keys fall into small buckets; each bucket stores a displacement under which
    its keys hit free slots.  Buckets of one key store the slot itself (as
    ``-slot - 1``).  A lookup of a foreign key gives some slot, so callers
    compare the key kept there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = np.zeros(self.buckets, np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        own = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken = np.zeros(n, bool)
        free: Iterator[int] | None = None
        for b in np.argsort(-sizes, kind="stable"):
            members = hashes[order[starts[b]:starts[b + 1]]]
            if len(members) == 0:
                break
            if len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken))
                slot = next(free)
                taken[slot] = True
                self.shift[b] = -int(slot) - 1
                continue
            first = 0
            while True:
                tries = np.arange(first, first + 64, dtype=np.uint64)
                slots = self._slots(members[None, :], tries[:, None])
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(ordered, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    taken[slots[k]] = True
                    self.shift[b] = first + k
                    break
                first += 64
        self.shifts = self.shift.tolist()

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (hashes ^ (shift * np.uint64(_SALT))) * np.uint64(_MULT)
        return ((x >> np.uint64(33)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shifts[h % self.buckets]
        if d < 0:
            return -d - 1
        return ((((h ^ (d * _SALT & MASK64)) * _MULT) & MASK64) >> 33) % self.n


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class Codec:
    """Encoder and decoder for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = GPT_PATTERN, memo_limit: int = 400_000):
        self.ranks = ranks
        self.splitter = Splitter(pattern)
        self.memo_limit = memo_limit
        tokens = list(ranks)
        self.hash = MinimalPerfectHash(tokens)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_rank = [0] * len(tokens)
        for t in tokens:
            s = self.hash.slot(t)
            self.slot_token[s], self.slot_rank[s] = t, ranks[t]
        self.token_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token_of[r] = t
        self._memo: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int | None:
        """Rank of a pre-token that is a token, by the perfect hash."""
        if not self.slot_token:
            return None
        s = self.hash.slot(piece)
        return self.slot_rank[s] if self.slot_token[s] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is not a token: lowest rank first, leftmost on ties."""
        n, rank = len(piece), self.ranks.get
        after = list(range(1, n + 1))       # start of the next part; also the end of this one
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(piece[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if mid >= n or mid < 0 or after[mid] != end:
                continue                    # one of its parts was merged meanwhile
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                r = rank(piece[i:after[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            j = before[i]
            if j >= 0:
                r = rank(piece[j:end])
                if r is not None:
                    heapq.heappush(heap, (r, j, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def _packed(self, piece: str) -> bytes:
        raw = piece.encode()
        r = self.whole(raw)
        return np.array([r] if r is not None else self.merge(raw), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        memo = self._memo
        if len(memo) > self.memo_limit:
            memo.clear()
        pieces = self.splitter.split(text)
        for p in set(pieces).difference(memo):
            memo[p] = self._packed(p)
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_LOADED: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The task's codec; a Python worker that runs several tasks builds it once."""
    key = hash((shared.value, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(parse_ranks(shared.value), pattern)
    return _LOADED[key]


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", out_col: str = "ids",
           pattern: str = GPT_PATTERN) -> DataFrame:
    """``df`` with ``out_col``: the text's ids, packed as little-endian unsigned 32-bit integers."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_local(ranks_path))

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared, pattern)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts], dtype=object)

    return df.withColumn(out_col, encoded(F.col(text_col)))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded",
           pattern: str = GPT_PATTERN) -> DataFrame:
    """``df`` with ``out_col``: the bytes that the packed ids decode to."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_local(ranks_path))

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared, pattern)
        for ids in batches:
            yield pd.Series([codec.decode(x) for x in ids], dtype=object)

    return df.withColumn(out_col, decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
               pattern: str = GPT_PATTERN) -> DataFrame:
    """Rows (id, ids, decoded) for every document."""
    coded = encode(docs.select(id_col, text_col), ranks_path, text_col, "ids", pattern).select(id_col, "ids")
    return decode(coded, ranks_path, "ids", "decoded", pattern)
