"""Operator 13: alignment of the tokens of a byte-level and a sentence-piece vocabulary.

A text's tokens A and B spell the same bytes.  Offsets where a token of A and
one of B both end cut them into groups, and tokens that share a group are
linked.  Everything is products of sparse incidence matrices (:class:`Csr`,
row products after Gustavson):

* token x byte matrices A and B: ``A . Bt`` holds a link for every two tokens
  that overlap, with the bytes they share.  Bytes that no token's end separates
  have equal columns; those are kept once, weighted by their number.  Both
  token lists run in byte order, so a group begins with the first link of a new
  token on both sides;
* (document, id) x group matrices with occurrences: their product holds, for
  every two ids of a document, the number of occurrence pairs that share a
  group.  Ids instead of occurrences keep a long group of repeated tokens small.

The corpus-wide count of an id pair is the number of documents that hold it
linked.  Each document's id pairs are written once with its digest; counts are
summed over them, and the documents then look their pairs up:

* the most frequent pairs, at most ``COMMON_PAIRS`` of them, are broadcast;
* pairs beyond that are joined on the pair, one row per document and pair;
  being the rarer ones, none of them is a hot key.

Defined results: a null or empty text, and a text whose tokens do not spell a
space and the text, has no tokens (all numbers 0, an empty digest); repeated
rows count as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, per_worker, read_local
from quire.llm.token_shards import Encoder
from quire.session import materialize

COMMON_PAIRS = 1 << 20      # id pairs that are broadcast: 17 bytes each
BLOCK_BYTES = 1 << 19       # bytes of text whose matrices are built together
PRODUCTS = 1 << 22          # scalar products that a row product expands at a time
KEPT_PAIRS = 1 << 21        # counted pairs that a task holds before it hands them on
SPACE = "▁"            # how pieces spell a space


class Csr:
    """A sparse matrix by rows: row i has ``values[starts[i]:starts[i + 1]]`` in the columns of the same places."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int):
        self.starts, self.columns, self.values, self.n_columns = starts, columns, values, n_columns

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int) -> Csr:
        """From entries in any order; those of one place are added up."""
        keys = rows.astype(np.int64) * max(n_columns, 1) + columns
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, rows, columns, values = keys[order], rows[order], columns[order], values[order]
        fresh = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        if not fresh.all():
            first = np.flatnonzero(fresh)
            rows, columns, values = rows[first], columns[first], np.add.reduceat(values, first)
        starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(rows, minlength=n_rows))))
        return cls(starts, columns, values, n_columns)

    @property
    def n_rows(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.n_rows), np.diff(self.starts))

    def transposed(self) -> Csr:
        return Csr.of(self.columns, self.rows(), self.values, self.n_columns, self.n_rows)

    def dot(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (rows, columns, values) of the product, some rows at a time.

        Row i of the product is the sum of the rows of ``other`` that the
        entries of row i name, each times its entry.
        """
        sizes = np.diff(other.starts)[self.columns]
        done = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[self.starts]    # products before each row
        low = 0
        while low < self.n_rows:
            high = max(low + 1, int(np.searchsorted(done, done[low] + PRODUCTS, side="right")) - 1)
            a, b = self.starts[low], self.starts[high]
            size = sizes[a:b]
            total = int(size.sum())
            if total:
                ends = np.cumsum(size)
                at = np.arange(total) + np.repeat(other.starts[self.columns[a:b]] - (ends - size), size)
                entry_rows = np.repeat(np.arange(low, high), np.diff(self.starts[low:high + 1]))
                part = Csr.of(np.repeat(entry_rows, size) - low, other.columns[at],
                              np.repeat(self.values[a:b], size) * other.values[at], high - low, other.n_columns)
                yield part.rows() + low, part.columns, part.values
            low = high


class PlainEncoder(Encoder):
    """The byte-level model, for which the strings of added tokens are ordinary text."""

    def __init__(self, model: str):
        super().__init__(model, memo_limit=200_000)
        self.model.encode_special_tokens = True
        self.added = []
        self.bytes = _byte_level_tokens(self)
        self.faithful = True                    # every pre-token learned so far is spelled by its ids

    def _learn(self, pieces: set[str]) -> None:
        super()._learn(pieces)
        order = list(pieces)
        self.faithful &= _all_spelled([self.memo[p] for p in order], self.bytes, order)

    def trusted(self, text: str) -> bool:
        """Whether the text's ids are put together from faithful pre-tokens, so that they spell it."""
        return self.faithful and self.splitter.is_latin(text)


class PieceEncoder:
    """A sentence-piece model applied to each distinct unit of text once per memo.

    A unit is a run of spaces with the characters after it, or a line break.
    No piece reaches over the border of a unit (checked against the vocabulary),
    so merges do not either and a text's ids are those of its units in turn.
    A text that holds the sign for a space goes to the library whole.
    """

    def __init__(self, model: bytes, memo_limit: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [_piece_bytes(p) for p in pieces]
        self.units = not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.DOTALL) for p in pieces)
        self.split = re.compile("\n| *[^ \n]+| +").findall
        self.memo: dict[str, bytes] = {}
        self.memo_limit = memo_limit
        self.lead = len(self.model.encode("\n"))
        self.faithful = True                    # every unit learned so far is spelled by its ids

    def _learn(self, units: list[str]) -> None:
        """A word after a space goes without it, as the library adds one; other units follow a line break."""
        words = [u for u in units if u[0] == " " and len(u) > 1]
        others = [u for u in units if u[0] != " " or len(u) == 1]
        coded = self.model.encode([u[1:] for u in words], num_threads=1)
        coded += [ids[self.lead:] for ids in self.model.encode(["\n" + u for u in others], num_threads=1)]
        ends = (4 * np.cumsum(list(map(len, coded)))).tolist()
        flat = np.fromiter(chain.from_iterable(coded), "<u4").tobytes()
        packed = [flat[a:b] for a, b in zip([0, *ends], ends)]
        self.memo.update(zip(words + others, packed, strict=True))
        self.faithful &= _all_spelled(packed, self.bytes, words + others)

    def trusted(self, text: str) -> bool:
        """Whether the text's ids are put together from faithful units, so that they spell it."""
        return self.faithful and self.units and SPACE not in text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, each given with the space that the library adds."""
        if len(self.memo) > self.memo_limit:
            self.memo.clear()
        split = [self.split(t) if self.units and SPACE not in t else None for t in texts]
        new = set().union(*(u for u in split if u)).difference(self.memo)
        if new:
            self._learn(list(new))
        look = self.memo.__getitem__
        return [b"".join(map(look, units)) if units is not None
                else np.array(self.model.encode(t[1:], num_threads=1), "<u4").tobytes()
                for t, units in zip(texts, split, strict=True)]


def _spells(ids: bytes, table: list[bytes], raw: bytes) -> bool:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())) == raw


def _all_spelled(packed: list[bytes], table: list[bytes], texts: list[str]) -> bool:
    """Whether each text is spelled by its ids: all of them one after another, and each to its length."""
    tokens = list(map(table.__getitem__, np.frombuffer(b"".join(packed), "<u4").tolist()))
    raw = [t.encode() for t in texts]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(list(map(len, tokens)), dtype=np.int64)))
    last = np.cumsum(list(map(len, packed)), dtype=np.int64) // 4
    return b"".join(tokens) == b"".join(raw) and bool((ends[last] == np.cumsum(list(map(len, raw)))).all())


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()


def _byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters stand for themselves, the other bytes in turn for those from 256 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level_tokens(encoder: Encoder) -> list[bytes]:
    """The bytes of every id; an added token that is no byte-level string has none."""
    alphabet = _byte_level_alphabet()
    vocabulary = encoder.model.get_vocab()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        if all(c in alphabet for c in token):
            out[i] = bytes(alphabet[c] for c in token)
    return out


class Aligner:
    """Groups and linked id pairs of texts under two vocabularies."""

    def __init__(self, byte_model: str, piece_model: bytes):
        self.a, self.b = PlainEncoder(byte_model), PieceEncoder(piece_model)
        self.bytes_a, self.bytes_b = self.a.bytes, self.b.bytes
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        # an id before another of its side, as the last of its side in a group, and (B) as the last of a document
        self.texts = [f"{i}{end}" for end in ",|" for i in range(n_a)] + [f"{i}{end}" for end in ",;\n" for i in range(n_b)]

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids A of a space and each text and how many it has, and the same of B; none where either does not spell that."""
        spaced = [" " + t if t else "" for t in texts]
        packed_a, packed_b = self.a.encode(spaced), self.b.encode(spaced)
        for i, text in enumerate(spaced):
            if not ((self.a.trusted(text) or _spells(packed_a[i], self.bytes_a, text.encode()))
                    and (self.b.trusted(text) or _spells(packed_b[i], self.bytes_b, text.encode()))):
                packed_a[i] = packed_b[i] = b""
        a, b = (np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in (packed_a, packed_b))
        return a, np.array(list(map(len, packed_a)), np.int64) // 4, b, np.array(list(map(len, packed_b)), np.int64) // 4

    def documents(self, texts: list[str | None]) -> list[dict]:
        """Numbers, groups, id pairs and links of every text; null and empty texts have no tokens."""
        table, written, pairs, links, edges = self.align(*self.tokens(texts))
        return [_found(table[d], written[d], pairs[edges[d]:edges[d + 1]], links[edges[d]:edges[d + 1]])
                for d in range(len(texts))]

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple:
        """Of texts with ``n_a`` ids of A and ``n_b`` of B: numbers, written groups, id pairs with their links, and where each text's start.

        The numbers are n_a, n_b, n_groups and n_links.
        """
        n_docs = len(n_a)
        group_a, group_b = _groups(self.sizes_a[a], self.sizes_b[b])
        doc_a, doc_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        doc_of_group = np.zeros(n_groups, np.int64)
        doc_of_group[group_a] = doc_a

        # occurrences of ids of A in groups, a row for every (document, id); and of ids of B, by group
        own = doc_a * len(self.bytes_a) + a
        order = np.argsort(own, kind="stable")          # groups stay in order within a row
        fresh = np.concatenate((np.ones(min(1, len(own)), bool), own[order][1:] != own[order][:-1]))
        keys, row_a = own[order][fresh], np.cumsum(fresh) - 1
        left = Csr.of(row_a, group_a[order], np.ones(len(a), np.int64), len(keys), n_groups)
        right = Csr.of(group_b, b, np.ones(len(b), np.int64), n_groups, len(self.bytes_b))
        found = list(left.dot(right))
        rows, columns, links = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        pairs = (keys[rows] % len(self.bytes_a)) << 32 | columns
        doc = keys[rows] // len(self.bytes_a)
        edges = np.searchsorted(doc, np.arange(n_docs + 1))
        n_links = np.bincount(doc, weights=links, minlength=n_docs).astype(np.int64)
        table = np.stack((n_a, n_b, np.bincount(doc_of_group, minlength=n_docs), n_links), axis=1)
        return table, self._written(a, doc_a, group_a, b, doc_b, group_b, n_a > 0), pairs, links, edges

    def _written(self, a, doc_a, group_a, b, doc_b, group_b, filled: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for the groups of every document."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)[:len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        final = np.append(doc_b[1:] != doc_b[:-1], True)[:len(b)]
        # a token stands after its own side's earlier ones and the other side's in the groups before (B: and in its own)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[at_a] = a + last_a * len(self.bytes_a)
        codes[at_b] = b + (last_b.astype(np.int64) + final) * len(self.bytes_b) + 2 * len(self.bytes_a)
        texts = iter("".join(map(self.texts.__getitem__, codes.tolist())).split("\n"))
        return [next(texts) if f else "" for f in filled.tolist()]


def _found(numbers: np.ndarray, written: str, pairs: np.ndarray, links: np.ndarray) -> dict:
    n_a, n_b, n_groups, n_links = numbers.tolist()
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": written, "pairs": pairs, "links": links}


def _groups(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token, for two token lists over the same bytes, from the links of their overlap product."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")         # a merge of two runs
    ends = ends[np.concatenate((np.ones(min(1, len(ends)), bool), ends[1:] != ends[:-1]))]
    width = np.diff(ends, prepend=0)
    a, b = (Csr(np.concatenate((np.zeros(1, np.int64), np.searchsorted(ends, e) + 1)), np.arange(len(ends)), values, len(ends))
            for e, values in ((ends_a, width), (ends_b, np.ones_like(width))))
    found = list(a.dot(b.transposed()))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    begins = np.concatenate((np.ones(1, bool), (i[1:] != i[:-1]) & (j[1:] != j[:-1])))
    group = np.cumsum(begins) - 1
    group_a, group_b = np.empty(len(sizes_a), np.int64), np.empty(len(sizes_b), np.int64)
    group_a[i], group_b[j] = group, group
    return group_a, group_b


_DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                   ("pairs", pa.binary()), ("links", pa.binary())])


def align(docs: DataFrame, byte_model_path: str, piece_model_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), written once.

    ``pairs`` are the document's linked id pairs (A's id times 2**32 plus B's, packed 64-bit
    integers) and ``links`` the number of links of each; ``row`` is a key of the row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((read_local(byte_model_path), read_local(piece_model_path)))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_model, piece_model = shared.value
        aligner = per_worker(("aligner", hash(byte_model), hash(piece_model)),
                             lambda: Aligner(byte_model.decode(), piece_model))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            low = 0
            while low < len(ids):
                high, size = low, 0
                while high < len(ids) and size < BLOCK_BYTES:
                    size += len(texts[high] or "")
                    high += 1
                found = aligner.documents(texts[low:high])
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + high - low), pa.int64()), pa.array(ids[low:high], pa.int64()),
                    *[pa.array([f[c] for f in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array([hashlib.sha256(f["groups"].encode()).hexdigest() if f["groups"] else "" for f in found]),
                    pa.array([f["pairs"].astype("<u8").tobytes() for f in found], pa.binary()),
                    pa.array([f["links"].astype("<u8").tobytes() for f in found], pa.binary())], schema=_DOCS)
                row += high - low
                low = high

    found = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .mapInArrow(aligned, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                  "groups_sha256 string, pairs binary, links binary"))
    return materialize(found, "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best): documents that hold each id pair linked; whether no pair of A's id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate(held), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            keys, sums = summed()
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_pydict({"pair": pa.array(keys[k:k + (1 << 16)].astype(np.int64)),
                                                  "n": pa.array(sums[k:k + (1 << 16)])})

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                if packed:
                    held.append(np.frombuffer(packed, "<u8"))
                    counts.append(np.ones(len(held[-1]), np.int64))
                    size += len(held[-1])
            if size > KEPT_PAIRS:
                keys, sums = summed()
                held, counts, size = [keys], [sums], len(keys)
                if size > KEPT_PAIRS // 2:
                    yield from out()
                    held, counts, size = [], [], 0
        if size:
            yield from out()

    counted = materialize(aligned.select("pairs").mapInArrow(partial, "pair long, n long")
                          .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    most = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))      # a row for every id of A at most
    return (counted.withColumn("a", first).join(most, "a")
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _common(counts: DataFrame, limit: int) -> DataFrame:
    """The pairs of at least such a count that no more than ``limit`` have it.

    Counts are graded by powers of two, so the histogram has 64 rows at most.
    """
    grades = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("grade")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = 63, 0
    for r in sorted(grades, key=lambda r: -r.grade):
        total += r["rows"]
        if total > limit:
            break
        least = r.grade
    return counts.where(F.col("n") >= F.lit(1 << least) if least < 63 else F.lit(False))


def link_counts(docs: DataFrame, byte_model_path: str, piece_model_path: str, id_col: str = "doc_id",
                text_col: str = "text", common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document.

    ``count_sum`` adds the corpus-wide counts of all links' id pairs; ``n_best``
    counts the links whose pair is the most frequent of its id of A.
    """
    spark = docs.sparkSession
    aligned = align(docs, byte_model_path, piece_model_path, id_col, text_col)
    counts = materialize(pair_counts(aligned), "pairs")
    common = _common(counts, common_pairs).sort("pair").toArrow()
    keys = common.column("pair").to_numpy()
    shared = spark.sparkContext.broadcast((keys, common.column("n").to_numpy(), common.column("best").to_numpy()))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            out = {"row": batch.column(0), "count_sum": [], "n_best": [], "others": [], "other_links": []}
            for packed, packed_links in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs, links = np.frombuffer(packed, "<i8"), np.frombuffer(packed_links, "<i8")
                at = np.searchsorted(keys, pairs)
                known = np.zeros(len(pairs), bool)
                inside = at < len(keys)
                known[inside] = keys[at[inside]] == pairs[inside]
                at = at[known]
                out["count_sum"].append(int((n[at] * links[known]).sum()))
                out["n_best"].append(int(links[known][best[at]].sum()))
                out["others"].append(pairs[~known])
                out["other_links"].append(links[~known])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    first = materialize(aligned.select("row", "pairs", "links").mapInArrow(
        looked_up, "row long, count_sum long, n_best long, others array<long>, other_links array<long>"), "looked-up")
    rare = (first.where(F.size("others") > 0)
            .select("row", F.explode(F.arrays_zip("others", "other_links")).alias("o"))
            .select("row", F.col("o.others").alias("pair"), F.col("o.other_links").alias("k"))
            .join(counts, "pair")
            .select("row", (F.col("n") * F.col("k")).alias("count_sum"),
                    F.when(F.col("best"), F.col("k")).otherwise(F.lit(0)).alias("n_best")))
    sums = (first.select("row", "count_sum", "n_best").unionByName(rare)
            .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    return (aligned.drop("pairs", "links").join(sums, "row")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
