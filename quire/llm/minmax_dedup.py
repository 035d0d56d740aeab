"""Operator 2: near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Each permutation of the hashes keeps both its least and its greatest value, so
one evaluation gives two unbiased samples; the values, 2 x ``PERMUTATIONS``,
are cut into ``BANDS`` bands of ``ROWS``.  Two sets of similarity 0.75 agree in
no band with probability (1 - 0.75**5)**44 < 7e-6.

Steps, none of which lists the pairs of a group:

1. documents with the same set form a class, kept by its least id;
2. classes that share a band with another are linked to the band's least class
   (a star), and the stars' components are the candidate groups;
3. a group is cut into blocks of about ``BLOCK_SHINGLES`` shingles by a hash;
   each task compares two blocks, on full sets through an inverted index, and
   returns a spanning forest of the links it confirms;
4. the components of the confirmed links are the result.

Every pair of a group meets in some task, so no link is lost to the blocks, and
a task holds two blocks however large the group is.

Defined results: ids are compared as long integers; rows with a null id are
returned with a null component and are linked with nothing; rows that repeat an
id are rows of their own and join whatever their own text links to; texts
without words are linked with nothing and are their own component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordCodes, bounded_batches, bytes_of, mix64, sequence_hash, window_hashes
from quire.llm.components import components
from quire.session import materialize

SHINGLE = 5
SIMILARITY_PCT = 75
ROWS, BANDS = 5, 44
PERMUTATIONS = ROWS * BANDS // 2
BLOCK_SHINGLES = 200_000

_ODD = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(raw: bytes, codes: WordCodes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z lower-cased, words split at ASCII white space."""
    hashes = codes.hash_words(raw.lower().split())
    if len(hashes) == 0:
        return hashes
    if len(hashes) < k:
        return sequence_hash(hashes)
    return np.unique(window_hashes(hashes, k))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x 2 * PERMUTATIONS) least and greatest values; no set may be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p, odd in enumerate(_ODD):
        moved = joined * odd
        out[:, 2 * p] = np.minimum.reduceat(moved, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(moved, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(sets x BANDS) keys; equal where all values of the band and the band are equal."""
    keys = np.zeros((len(values), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    cells = values.reshape(len(values), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return keys.view(np.int64)


def set_class(hashes: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in batches:
        sets = [shingle_set(raw, codes) for raw in bytes_of(batch.column(1))]
        sizes = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(sizes > 0).tolist()
        classes: list[int | None] = [None] * len(sets)
        bands: list[np.ndarray | None] = [None] * len(sets)
        at = 0
        while at < len(some):       # signatures of a bounded number of shingles at a time
            end, held = at, 0
            while end < len(some) and (end == at or held + sizes[some[end]] <= 1 << 18):
                held += sizes[some[end]]
                end += 1
            keys = band_keys(signatures([sets[i] for i in some[at:end]]))
            for i, own in zip(some[at:end], keys, strict=True):
                classes[i], bands[i] = set_class(sets[i]), own
            at = end
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "n_shingles", "class", "bands"])


class _Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def linked(sets: list[np.ndarray], first: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs (i, j), i < j, with i below ``first`` or j not below it.

    ``first`` = 0 or len(sets) compares all with all; otherwise the two blocks
    with each other.  Intersections are counted through an inverted index.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    posts = owner[order]                      # rising owners within a code
    starts = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    forest, out = _Forest(n), []
    within = first in (0, n)
    for i in range(n - 1 if within else first):
        own = codes[cuts[i]:cuts[i + 1]]
        lens = starts[own + 1] - starts[own]
        own, lens = own[lens > 1], lens[lens > 1]
        if len(own) == 0:
            continue
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(starts[own] - (ends - lens), lens)
        shared = np.bincount(posts[at], minlength=n)
        shared[:i + 1 if within else first] = 0
        hit = np.flatnonzero(100 * shared >= SIMILARITY_PCT * (sizes + sizes[i] - shared))
        out += [(i, j) for j in hit[shared[hit] > 0].tolist() if forest.join(i, j)]
    return out


def _verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a block (key i = j) or between two blocks of a group."""
    _, i, j = key
    codes = WordCodes()
    rows = rows.sort_values(["block", "class"], kind="stable")
    sets = [shingle_set((t or "").encode(), codes) for t in rows["text"]]
    names = rows["class"].to_numpy()
    own = [s for s in range(len(sets)) if len(sets[s]) and set_class(sets[s]) == names[s]]
    right = list({names[s]: s for s in own}.values())   # an id may repeat, with this or another text
    if len(right) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    first = 0 if i == j else int((rows["block"].to_numpy()[right] == i).sum())
    if i != j and first in (0, len(right)):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    pairs = linked([sets[s] for s in right], first)
    return pd.DataFrame({"a": [names[right[x]] for x, _ in pairs], "b": [names[right[y]] for _, y in pairs]},
                        dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = materialize(texts.mapInArrow(_features, "id long, n_shingles long, class long, bands array<long>"),
                           "minmax")
    classes = materialize(features.where("class is not null and id is not null").groupBy("class")
                          .agg(F.min(F.struct("id", "n_shingles", "bands")).alias("x"))
                          .select("class", "x.id", "x.n_shingles", "x.bands"), "classes")

    entries = classes.select("class", F.explode("bands").alias("band"))
    shared = (entries.groupBy("band").agg(F.min("class").alias("star"), F.count("*").alias("n"))
              .where("n > 1").select("band", "star"))
    # a class is linked to the least of its bands' stars, and so are these: an edge a class, and one for each two stars
    stars = (entries.join(shared, "band").groupBy("class").agg(F.collect_set("star").alias("stars"))
             .withColumn("least", F.array_min("stars")))
    edges = (stars.select("class", "least")
             .unionByName(stars.select(F.explode("stars").alias("class"), "least").distinct()))
    groups = components(edges.where("class <> least"), "class", "least")

    members = groups.join(classes.select(F.col("class").alias("node"), "id", "n_shingles"), "node")
    blocks = (members.groupBy("label").agg(F.sum("n_shingles").alias("total"))
              .select("label", F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)).cast("int").alias("n_blocks")))
    members = materialize(
        members.join(blocks, "label")
        .select("label", F.col("node").alias("class"), "id", "n_blocks",
                F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block")), "members")
    # members grow with the corpus, so they are never broadcast, however few they are estimated to be
    found = texts.where("id is not null").join(members.hint("merge"), "id")
    meetings = found.select(
        "label", "class", "block", "text",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                              lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))))
        .alias("m"))
    links = (meetings.select("label", "m.i", "m.j", "class", "block", "text").groupBy("label", "i", "j")
             .applyInPandas(_verify, "a long, b long"))
    joined = components(links)

    least = classes.select("class", "id").join(joined.withColumnRenamed("node", "class"), "class")
    least = least.groupBy("label").agg(F.min("id").alias("least"))
    own = (joined.join(least, "label").select(F.col("node").alias("class"), "least"))
    own = classes.select("class", F.col("id").alias("first")).join(own, "class", "left").select(
        "class", F.coalesce("least", "first").alias("least"))
    return (features.select("id", "n_shingles", "class").join(own, "class", "left")
            .select(F.col("id").alias("doc_id"), "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
