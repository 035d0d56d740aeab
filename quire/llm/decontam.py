"""Operator 6: benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items (long ones in equal pieces of up to ``ITEM_WORDS`` words) are indexed:
postings per term with BM25 impacts, in blocks that know their greatest impact.
Impacts are divided by the item's score of itself, so a threshold is a share
of that.  Every passage of every document is a query: windows of twice the
longest item, half overlapping, so that any copy of an item lies whole in one.
All items that score ``RETRIEVE`` or more are retrieved.  Passages that cannot
reach that for any item are dismissed first, many at a time, by upper bounds
summed from the same postings, which loses nothing; the others go through WAND.

A retrieved item is verified on exact five-word shingles: the passage must hold
``OVERLAP`` of the item's, and ``PART_OVERLAP`` of those of its question and of
its answer (the last sentence; without one, the second half).  Of an item in
pieces the whole item is verified, on all passages that retrieved a piece of it
together, each widened by the item's length, so that a copy lies whole in them;
its score is the mean of its pieces' best, by their lengths.

The index is cut into shards of about ``SHARD_ITEMS`` pieces of bounded length,
the pieces of an item in one (equal rows of an item count once), broadcast one at a
time: what a shard gives is written, and its index released, before the next one
comes.  The documents are read once per shard and never shuffled.

Defined results: words split at ASCII white space, A-Z lower-cased, with signs
at their ends removed.  Items that are null, or without a word, match nothing;
items below five words are one shingle; repeated items are found each by its
own id; a null doc_id is reported as null.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordCodes, bounded_batches, bytes_of, mix64, sequence_hash, window_hashes
from quire.session import materialize

K1, B = 1.2, 0.75
RETRIEVE = 0.5
OVERLAP, PART_OVERLAP = 0.75, 0.5
ITEM_WORDS = 256
SHARD_ITEMS = 20_000
BLOCK = 64
LONG_LIST = 1024          # longer postings may be bounded instead of summed
CELLS = 1 << 22           # half passages x items that are bounded at a time
SHINGLE = 5

_SIGNS = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(raw: bytes) -> list[bytes]:
    return [w for w in (w.strip(_SIGNS) for w in raw.lower().split()) if w]


def question_and_answer(text: str) -> tuple[str, str]:
    """The text before its last sentence, and that; of a single sentence, its two halves."""
    parts = [p for p in _SENTENCE_END.split(text) if words_of(p.encode())]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def shingles(words: list[bytes], codes: WordCodes) -> np.ndarray:
    return _shingles_of(codes.hash_words(words))


def _shingles_of(h: np.ndarray) -> np.ndarray:
    if len(h) == 0:
        return h
    return sequence_hash(h) if len(h) < SHINGLE else np.unique(window_hashes(h, SHINGLE))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items in equal pieces of bounded length, with the words that are indexed; the first has the item's text."""
    for rows in batches:
        out = []
        for item, row, text in zip(rows["item"], rows["row"], rows["text"], strict=True):
            own = [w.decode() for w in words_of((text or "").encode())]
            n = -(-len(own) // ITEM_WORDS)
            cuts = [len(own) * k // n for k in range(n + 1)] if n else []
            out += [(item, row, k, None if k else text, own[a:b])
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        yield pd.DataFrame(out, columns=["item", "row", "piece", "text", "words"])


@dataclass
class Index:
    """One shard: items with their texts (None for further pieces of the item before), and postings with relative impacts."""

    items: list[int]
    texts: list[str | None]
    lengths: list[int]
    terms: dict[bytes, int]
    docs: list[list[int]]            # per term: rising item numbers
    impacts: list[list[float]]
    block_max: list[list[float]]
    block_last: list[list[int]]      # last item number of each block
    summed: np.ndarray               # per term: whether bounds sum its impacts
    common: np.ndarray               # per item: all that the other terms can add

    def __post_init__(self) -> None:
        self.lens = np.array([len(d) for d in self.docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)))[:-1]
        self.flat_docs = np.array([d for ds in self.docs for d in ds], np.int64)
        self.flat_impacts = np.array([x for xs in self.impacts for x in xs])
        self.term_max = [max(xs) for xs in self.impacts]
        self.first: list[int] = []                   # per piece: the first one of its item
        self.words: dict[int, int] = defaultdict(int)    # per first piece: words of the whole item
        for n, (text, length) in enumerate(zip(self.texts, self.lengths, strict=True)):
            self.first.append(n if text is not None else self.first[-1])
            self.words[self.first[n]] += length

    @property
    def window(self) -> int:
        return 2 * max(self.lengths)


def build_index(rows: list[tuple[int, str | None, list[bytes]]], df: dict[bytes, int], n_all: int, mean_length: float,
                threshold: float = RETRIEVE) -> Index:
    """Index of (item, text, words) pieces under corpus-wide statistics of the test items."""
    postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
    for n, (_, _, words) in enumerate(rows):
        tf: dict[bytes, int] = defaultdict(int)
        for w in words:
            tf[w] += 1
        norm = K1 * (1 - B + B * len(words) / mean_length)
        own = {w: math.log1p((n_all - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
        total = sum(own.values())
        for w, x in own.items():
            postings[w].append((n, x / total))
    terms = {w: i for i, w in enumerate(sorted(postings))}
    docs = [np.array([d for d, _ in postings[w]], np.int64) for w in terms]
    impacts = [np.array([x for _, x in postings[w]]) for w in terms]
    cuts = [np.arange(0, len(d), BLOCK) for d in docs]
    block_max = [np.maximum.reduceat(x, c) for x, c in zip(impacts, cuts, strict=True)]
    block_last = [d[np.minimum(c + BLOCK, len(d)) - 1] for d, c in zip(docs, cuts, strict=True)]
    # terms of very long lists, while they reach less than half the threshold in any item, are bounded and not summed
    summed = np.ones(len(terms), bool)
    common = np.zeros(len(rows))
    for t in sorted(range(len(docs)), key=lambda t: -len(docs[t])):
        if len(docs[t]) <= LONG_LIST or (common[docs[t]] + impacts[t]).max() > threshold / 2:
            break
        common[docs[t]] += impacts[t]
        summed[t] = False
    plain = [[x.tolist() for x in part] for part in (docs, impacts, block_max, block_last)]
    return Index([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], terms, *plain, summed, common)


def wand(index: Index, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Items that score ``threshold`` or more for the distinct terms of a passage, by block-max WAND."""
    cursors = [[index.docs[t][0], t, 0] for t in query.tolist()]   # current item, term, position
    upper, block_last, block_max = index.term_max, index.block_last, index.block_max
    out = []

    def advance(c: list[int], target: int) -> bool:
        """Move to the first posting at or after ``target``; False at the end."""
        d = index.docs[c[1]]
        c[2] = bisect_left(d, target, c[2])
        if c[2] == len(d):
            return False
        c[0] = d[c[2]]
        return True

    eps = 1e-9
    while cursors:
        cursors.sort(key=itemgetter(0))
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += upper[c[1]]
            if total >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # bound by the blocks that would hold the pivot item
        bound, until = 0.0, math.inf
        for c in cursors[:pivot + 1]:
            last = block_last[c[1]]
            b = bisect_left(last, item)
            if b < len(last):
                bound += block_max[c[1]][b]
                until = min(until, last[b])
        if bound >= threshold - eps:
            if cursors[0][0] == item:
                s = sum(index.impacts[c[1]][c[2]] for c in cursors if c[0] == item)
                if s >= threshold - eps:
                    out.append((item, s))
                cursors = [c for c in cursors if c[0] != item or advance(c, item + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= item or advance(c, item)]
        else:
            target = until + 1 if until < math.inf else item + 1
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][0])
            target = max(target, item + 1)
            cursors = [c for c in cursors if c[0] >= target or advance(c, target)]
    return out


class Matcher:
    """Finds the items of one index in texts."""

    def __init__(self, index: Index, threshold: float = RETRIEVE):
        self.index, self.threshold = index, threshold
        self.codes = WordCodes()
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.memo: dict[bytes, int] = {}

    def _term(self, token: bytes) -> int:
        word = token.strip(_SIGNS)
        return self.index.terms.get(word, -1) if word else -2

    def _item(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if n not in self.parts:
            q, a = question_and_answer(self.index.texts[n])
            self.parts[n] = tuple(shingles(words_of(x.encode()), self.codes)
                                  for x in (self.index.texts[n], q, a))
        return self.parts[n]

    def _codes(self, raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Tokens, the places of those that are words, and their term numbers (-1 for others)."""
        memo, tokens = self.memo, raw.lower().split()
        if len(memo) > 250_000:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self._term(t)
        codes = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        places = np.flatnonzero(codes != -2)        # tokens of signs alone are no words
        return tokens, places, codes[places]

    def find(self, raws: list[bytes]) -> list[dict[int, tuple[float, float, float, float]]]:
        """Per text and item number: score, and overlap of the item, its question and its answer."""
        step = self.index.window // 2
        coded = [self._codes(raw) for raw in raws]
        halves = [-(-len(c) // step) for _, _, c in coded]
        firsts = np.concatenate(([0], np.cumsum(halves)))
        all_codes = np.concatenate([c for _, _, c in coded])
        half_of = np.concatenate([f + np.arange(len(c)) // step for f, (_, _, c) in zip(firsts, coded)])
        use = (all_codes >= 0) & self.index.summed[np.maximum(all_codes, 0)]
        last = self._reachable(all_codes[use], half_of[use], int(firsts[-1]))
        return [self._search(tokens, places, codes, last[f:f + n])
                for (tokens, places, codes), f, n in zip(coded, firsts[:-1].tolist(), halves, strict=True)]

    def _reachable(self, codes: np.ndarray, half_of: np.ndarray, n: int) -> np.ndarray:
        """Per half passage, whether it and the next may reach the threshold for some item.

        The impacts of a half's distinct terms are summed per item; a passage is
        two halves, so the sum of theirs, and of what common terms can add, bounds it.
        """
        ix, items = self.index, len(self.index.items)
        vocabulary = len(ix.docs)
        pairs = np.unique(half_of * vocabulary + codes)
        half, term = pairs // vocabulary, pairs % vocabulary
        out = np.zeros(n, bool)
        per = max(2, CELLS // items)
        for lo in range(0, n, per - 1):             # a half is in the bounds of two passages
            hi = min(lo + per, n)
            a, b = np.searchsorted(half, [lo, hi])
            lens = ix.lens[term[a:b]]
            ends = np.cumsum(lens)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(ix.starts[term[a:b]] - (ends - lens), lens)
            cell = np.repeat(half[a:b] - lo, lens) * items + ix.flat_docs[at]
            sums = np.bincount(cell, weights=ix.flat_impacts[at], minlength=(hi - lo) * items).reshape(hi - lo, items)
            sums[:-1] += sums[1:]
            out[lo:hi] |= ((sums + ix.common).max(axis=1) >= self.threshold - 1e-9)
        return out

    def _search(self, tokens: list[bytes], places: np.ndarray, codes: np.ndarray,
                reachable: np.ndarray) -> dict[int, tuple[float, float, float, float]]:
        """Query the index with the passages of a text that may reach the threshold, and verify what is retrieved."""
        ix, step = self.index, self.index.window // 2
        found: dict[int, tuple[float, float, float, float]] = {}
        scores: dict[int, dict[int, float]] = defaultdict(dict)            # of items in pieces: best score of each
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)        # and where to look for the whole item
        for w in np.flatnonzero(reachable).tolist():
            a, b = w * step, min((w + 2) * step, len(codes))
            query = np.unique(codes[a:b])
            hits = wand(ix, query[query >= 0], self.threshold)
            held = None
            for n, score in hits:
                first = ix.first[n]
                if ix.words[first] != ix.lengths[first]:
                    scores[first][n] = max(score, scores[first].get(n, 0.0))
                    lo, hi = max(0, a - ix.words[first]), min(b + ix.words[first], len(codes))
                    if spans[first] and lo <= spans[first][-1][1]:
                        lo = spans[first].pop()[0]
                    spans[first].append((lo, hi))
                    continue
                held = held or self._held(tokens, places, [(a, b)])
                whole, question, answer = (self._share(part, *held) for part in self._item(n))
                old = found.get(n)
                if old is None or (whole, score) > (old[1], old[0]):
                    found[n] = (score, whole, question, answer)
        for n, best in scores.items():
            held = self._held(tokens, places, spans[n])
            score = sum(s * ix.lengths[piece] for piece, s in best.items()) / ix.words[n]
            found[n] = (score, *(self._share(part, *held) for part in self._item(n)))
        return {n: v for n, v in found.items()
                if v[1] >= OVERLAP and v[2] >= PART_OVERLAP and v[3] >= PART_OVERLAP}

    def _held(self, tokens: list[bytes], places: np.ndarray,
              spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Shingles of all spans of a text's words, and the word hashes of each span."""
        hashes = [self.codes.hash_words([tokens[p].strip(_SIGNS) for p in places[a:b].tolist()]) for a, b in spans]
        return np.concatenate([_shingles_of(h) for h in hashes]), hashes

    @staticmethod
    def _share(part: np.ndarray, held: np.ndarray, hashes: list[np.ndarray]) -> float:
        """Share of the part's shingles that the passages hold; an empty part is held."""
        if not len(part):
            return 1.0
        share = float(np.isin(part, held).mean())
        if share == 0 and len(part) == 1:            # perhaps fewer words than a shingle: look for the sequence
            for h in hashes:
                for k in range(1, SHINGLE):
                    if len(h) >= k and (sequence_windows(h, k) == part[0]).any():
                        return 1.0
        return share


def sequence_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """``sequence_hash`` of every run of k words."""
    return mix64(window_hashes(hashes, k) + np.uint64(k))


def index_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 threshold: float = RETRIEVE) -> Iterator[Index]:
    """The index in shards, one at a time: each is a bounded number of pieces of bounded length."""
    pieces = materialize(
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropDuplicates()
        .select("item", F.monotonically_increasing_id().alias("row"), "text")
        .mapInPandas(_pieces, "item long, row long, piece int, text string, words array<string>"), "benchmark-pieces")
    total = pieces.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not total.n:
        return
    n_shards = -(-total.n // SHARD_ITEMS)
    df = materialize(pieces.select(F.explode(F.array_distinct("words")).alias("word"))
                     .groupBy("word").agg(F.count("*").alias("df")), "benchmark-df")
    numbered = pieces.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(n_shards)))
    for s in range(n_shards):
        rows = numbered.where(F.col("shard") == s)
        own = rows.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
        freq = {r.word.encode(): r.df for r in df.join(own, "word").collect()}
        got = sorted(rows.collect(), key=lambda r: (r.item, r.row, r.piece))
        if got:
            yield build_index([(r.item, r.text, [w.encode() for w in r.words]) for r in got], freq, total.n,
                              float(total.mean), threshold)


_FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = RETRIEVE) -> DataFrame:
    """Rows (doc_id, item_id, score, overlap, question_overlap, answer_overlap) of verified matches.

    An item counts once per document, of rows with one id the one of greatest overlap.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out: DataFrame | None = None
    part, shared = None, None
    for index in index_shards(items, threshold=threshold):
        if part is not None:
            part, out = None, _joined(out, _written(part, shared))
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, threshold)
            for batch in batches:
                rows = [(doc, shared.value.items[n], *v)
                        for doc, found in zip(batch.column(0).to_pylist(), matcher.find(bytes_of(batch.column(1))),
                                              strict=True)
                        for n, v in _best(found, shared.value.items).items()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                types = [pa.int64()] * 2 + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                                 ["doc_id", "item_id", "score", "overlap", "question_overlap",
                                                  "answer_overlap"])

        part = texts.mapInArrow(search, _FOUND)
    return spark.createDataFrame([], _FOUND) if part is None else _joined(out, part)


def _joined(out: DataFrame | None, part: DataFrame) -> DataFrame:
    return part if out is None else out.unionByName(part)


def _written(part: DataFrame, shared) -> DataFrame:
    """What a shard gave, written, so that its index can leave the executors before the next comes."""
    done = materialize(part, "shard")
    shared.unpersist()
    return done


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                         threshold: float = RETRIEVE) -> DataFrame:
    """``docs`` without the rows whose text holds an item; no join, one filter per index shard.

    With several shards, what each but the last leaves is written before the next.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = None
    for index in index_shards(items, threshold=threshold):
        if shared is not None:
            docs = _written(docs, shared)
        shared = spark.sparkContext.broadcast(index)
        docs = docs.where(_clean(shared, threshold)(F.col(text_col)))
    return docs


def _clean(shared, threshold: float):
    """UDF: whether a text holds none of the index's items."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, threshold)
        for texts in batches:
            yield pd.Series([not f for f in matcher.find([(t or "").encode() for t in texts])], dtype=bool)

    return clean


def _best(found: dict, items: list[int]) -> dict:
    """Of an id's items in a document, the one of greatest overlap."""
    best: dict[int, int] = {}
    for n, v in found.items():
        if items[n] not in best or v[1] > found[best[items[n]]][1]:
            best[items[n]] = n
    return {n: found[n] for n in best.values()}
