"""Operator 11: documents packed into token windows, best fit decreasing.

Every document is its ids and an end id.  A task takes its documents in blocks
of about ``BLOCK_TOKENS`` ids and packs each block by itself, where the ids
were made: nothing is shuffled, and memory is bounded by a block and the
longest text.  In a block

1. overlong documents are cut into full windows, each a sequence of its own;
2. the rests and the short documents are placed in decreasing length, each in
   the open window of least remaining capacity that holds it (a segment tree
   over capacities finds it), else in a new window;
3. windows still short of more than ``tolerance`` ids are topped up with ids
   cut from the emptiest of them; what is left of the last one is written as
   sequences of power-of-two lengths, which take no padding.

So no sequence has more than ``tolerance`` ids of padding, whatever the
lengths, and only windows that best fit leaves loose cost further cuts.

Defined results: a null or empty text is a document of the end id alone;
repeated rows and null ids are documents like any other; an empty table gives
no pieces.  Sequence numbers are unique, not gapless: partition number times
2**33 plus a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, per_worker, read_local
from quire.llm.token_shards import Encoder

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 22
TOLERANCE = 16
_OUT_PIECES = 1024      # pieces in an Arrow batch that leaves a task


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that tells where any are."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)            # node k covers what nodes 2k and 2k + 1 cover
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        node = self.size + capacity
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window that holds ``need``; None if there is none."""
        some, node = self.some, self.size + need
        if not some[node]:
            while node & 1 or not some[node + 1]:       # up, until something lies to the right
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.at[capacity].pop()
        if not self.at[capacity]:
            some[node] = 0
            while node > 1 and not some[node ^ 1]:
                node >>= 1
                some[node] = 0
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Members of each window, for pieces of at most ``window`` ids."""
    windows: list[list[int]] = []
    tree = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = (window, len(windows))
            windows.append([])
        capacity, w = found
        windows[w].append(i)
        if capacity > n:
            tree.add(capacity - n, w)
    return windows


@dataclass
class Piece:
    doc: int
    start: int
    length: int

    def cut(self, n: int) -> Piece:
        """Take the first ``n`` ids off."""
        head = Piece(self.doc, self.start, n)
        self.start += n
        self.length -= n
        return head


def _top_up(windows: list[list[Piece]], window: int, tolerance: int) -> list[list[Piece]]:
    """Fill windows short of more than ``tolerance`` ids from the emptiest of them."""
    fills = [sum(p.length for p in w) for w in windows]
    loose = sorted((w for w in range(len(windows)) if window - fills[w] > tolerance), key=lambda w: fills[w])
    done = [w for w, n in zip(windows, fills, strict=True) if window - n <= tolerance]
    low, high = 0, len(loose) - 1
    while low < high:
        giver, taker = loose[low], loose[high]
        piece = windows[giver][-1]
        gap = window - fills[taker]
        moved = piece.cut(gap) if piece.length > gap else windows[giver].pop()
        windows[taker].append(moved)
        fills[giver] -= moved.length
        fills[taker] += moved.length
        if fills[taker] == window:
            done.append(windows[taker])
            high -= 1
        if not windows[giver]:
            low += 1
    if low == high:
        rest, left = windows[loose[low]][::-1], fills[loose[low]]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            done.append([])
            while size:
                piece = rest[-1].cut(size) if rest[-1].length > size else rest.pop()
                done[-1].append(piece)
                size -= piece.length
    return done


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, tolerance: int = TOLERANCE) -> list[list[Piece]]:
    """Sequences of pieces for documents of the given numbers of ids."""
    lengths = np.asarray(lengths, np.int64)
    out = [[Piece(d, k * window, window)]
           for d in np.flatnonzero(lengths >= window).tolist() for k in range(int(lengths[d]) // window)]
    rests = np.flatnonzero(lengths % window)
    sizes = lengths[rests] % window
    starts = lengths[rests] - sizes
    placed = [[Piece(int(rests[i]), int(starts[i]), int(sizes[i])) for i in w]
              for w in best_fit_decreasing(sizes, window)]
    return out + _top_up(placed, window, tolerance)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
         window: int = WINDOW, tolerance: int = TOLERANCE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are packed 32-bit integers.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.
    """
    if window < 1 or tolerance < 0:
        raise ValueError("window must be positive and tolerance not negative")
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_local(model_path))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("byte-level", hash(model.value)), lambda: Encoder(model.value.decode()))
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        coded: list[bytes] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            lengths = np.array([len(c) // 4 for c in coded], np.int64)
            for pieces in pack_lengths(lengths, window, tolerance):
                offset = 0
                for p in pieces:
                    rows.append((ids[p.doc], p.start, p.length, coded[p.doc][4 * p.start:4 * (p.start + p.length)],
                                 int(lengths[p.doc]), sequence, offset))
                    offset += p.length
                sequence += 1
                if len(rows) >= _OUT_PIECES:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES, strict=True)],
                                              schema=_PIECES)

        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(key)
                coded.append(tokens + end)
                size += len(tokens) // 4 + 1
                if size >= block_tokens:
                    yield from block()
                    ids, coded, size = [], [], 0
        yield from block()

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Training rows (sequence_id, n_tokens, ids): a sequence's pieces joined and padded to ``window``.

    A sequence whose length is a power of two stays as long as it is.  A group holds one
    sequence, at most ``window`` ids.
    """
    pad = np.array([pad_id], "<u4").tobytes()
    joined = (pieces.groupBy("sequence_id")
              .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
              .withColumn("ids", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padding = F.unhex(F.repeat(F.lit(pad.hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.when(whole, F.col("ids")).otherwise(F.concat("ids", padding)).alias("ids"))
