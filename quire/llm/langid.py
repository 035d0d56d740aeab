"""Operator 1: language identification with averaged hashed subword embeddings.

A text is a bag of letter n-grams (2 to 4, words padded with a space), hashed
into ``BUCKETS`` rows of an embedding table; the mean of its rows goes through
a linear softmax.  Table and softmax are trained together by mini-batch
stochastic gradient descent in numpy on a bounded sample: up to
``SAMPLE_PER_LANG`` documents per language (those of least hash in as many
buckets), each cut into short and long pieces.  A fifth of the sampled
documents is held back: on it a temperature is fitted (calibrated scores) and a
threshold below which at most ``REJECT`` of correct answers fall (calibrated
rejection, column ``accepted``).

For prediction the table and the softmax fold into one table of logits per
bucket, so a text costs a gather and a mean.  Whole texts are read, in blocks.

Defined results: a text that is null or without a letter is ``und`` with score
0 and not accepted; so is every text if no row can be learned from.  Null ids
and null languages are never learned from; a null id counts as not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, free_name
from quire.session import materialize

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
SAMPLE_PER_LANG = 512
MAX_LANGS = 500       # bounds the sample; more languages are an error
PIECES = ((1, 2), (3, 3), (8, 3), (40, 4))  # words in a piece, pieces of that size per document
EPOCHS, RATE, BATCH = 6, 0.5, 64
REJECT = 0.01
UNKNOWN = "und"
_CHUNK = 1 << 18

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def subwords(text: str) -> np.ndarray:
    """Bucket of every n-gram of the letters of a lower-cased text (not empty)."""
    folded = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(folded.encode("utf-32-le"), "<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h + codes[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (BUCKETS - 1).bit_length()))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))        # numerals such as "²" are word characters, but no letters


def pieces(text: str) -> list[str]:
    """Training pieces: evenly spread runs of words, and a longer one for each size."""
    words = _NOT_LETTERS.sub(" ", text).split()
    out = []
    for size, many in PIECES:
        if not words:
            break
        step = max(1, (len(words) - size) // many) if len(words) > size else len(words)
        out += [" ".join(words[a:a + size]) for a in range(0, len(words), step)][:many]
    return out


@dataclass
class Model:
    """Languages, logits per bucket, the bias, the temperature and the rejection threshold."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, text: str) -> np.ndarray:
        """Probabilities of the languages for a text with letters."""
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(text), _CHUNK):
            part = text[at:at + _CHUNK]
            if at and not has_letter(part):
                continue
            own = subwords(part)
            total += self.logits[own].sum(axis=0)
            n += len(own)
        z = (total / max(n, 1) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = self.scores(text)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def train(rows: list[tuple[str, list[str], bool]]) -> Model:
    """Fit on rows (lang, pieces, held back for calibration)."""
    langs = sorted({lang for lang, parts, held in rows if parts and not held})
    code = {lang: i for i, lang in enumerate(langs)}
    k = len(langs)
    rng = np.random.default_rng(0)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, k)), np.zeros(k)
    fit = [(subwords(p), code[lang]) for lang, parts, held in rows if not held for p in parts]
    size = np.bincount([y for _, y in fit], minlength=max(k, 1)).astype(float)
    weight = (len(fit) / (k * np.maximum(size, 1))) if k else size   # languages count alike
    for epoch in range(EPOCHS if k > 1 else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(fit))
        for at in range(0, len(order), BATCH):
            batch = [fit[i] for i in order[at:at + BATCH]]
            lens = np.array([len(x) for x, _ in batch])
            ids = np.concatenate([x for x, _ in batch])
            doc = np.repeat(np.arange(len(batch)), lens)
            means = np.add.reduceat(table[ids], np.concatenate(([0], np.cumsum(lens)[:-1]))) / lens[:, None]
            z = means @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = np.array([c for _, c in batch])
            p[np.arange(len(y)), y] -= 1
            p *= np.minimum(weight[y], 5)[:, None]
            back = (p @ out.T) / lens[:, None]
            out -= rate * (means.T @ p) / len(batch) * 4
            bias -= rate * p.sum(axis=0) / len(batch)
            np.add.at(table, ids, -rate * 4 * back[doc])
    model = Model(langs, table @ out, bias)
    _calibrate(model, [(p, code[lang]) for lang, parts, held in rows if held and lang in code for p in parts])
    return model


def _calibrate(model: Model, held: list[tuple[str, int]]) -> None:
    """Temperature by likelihood on a grid, then the threshold, on pieces not trained on."""
    if len(model.langs) < 2 or not held:
        return
    raw = np.log(np.maximum([model.scores(p) for p, _ in held], 1e-300))
    y = np.array([c for _, c in held])

    def probs(t: float) -> np.ndarray:
        z = raw / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = np.exp(np.linspace(np.log(0.25), np.log(4), 41))
    loss = [-np.log(np.maximum(probs(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probs(model.temperature)
    right = p.argmax(axis=1) == y
    if right.any():
        model.threshold = float(np.quantile(p[right].max(axis=1), REJECT))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Train on the rows of ``docs`` where ``learn`` holds.

    The sample is one document per (language, bucket of the id's hash), the one
    of least hash: a map-side minimum, whatever share of rows a language has.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    order = F.xxhash64("id")
    chosen = (rows.where(F.length("text") > 0).groupBy("lang", F.pmod(order, F.lit(SAMPLE_PER_LANG)).alias("bucket"))
              .agg(F.min(F.struct(order.alias("h"), "id")).alias("x")).select("x.id", "lang"))
    chosen = materialize(chosen, "lang-sample")
    if chosen.count() > MAX_LANGS * SAMPLE_PER_LANG:
        raise ValueError(f"more than {MAX_LANGS} languages")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t) for t in texts], dtype=object)

    sample = (rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
              .select("id", "lang", cut("text").alias("pieces"),
                      (F.pmod(F.xxhash64(F.concat("id", F.lit("/held"))), F.lit(5)) == 0).alias("held")))
    got = sorted(sample.collect(), key=lambda r: (r.lang, r.id))
    return train([(r.lang, list(r.pieces), r.held) for r in got])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` (or the next free name): lang_pred, score, accepted."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # BUCKETS x languages numbers

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.withColumn(free_name(docs, "language"), predicted(F.col(text_col)))
