"""Operator 5: quality rules with risk-controlled thresholds.

Every rule compares a ratio of a document with a cutoff.  The cutoffs come from
labelled documents, split by id into two folds.  On the first, quantiles of the
good documents give a chain of ever stricter configurations per stratum (the
document's language); a rule takes part where it rejects at least twice the
share of bad documents as of good ones.  On the second, each configuration's false rejections
among good documents are counted, and an exact binomial (Clopper-Pearson) upper
bound is compared with ``ALPHA``.  The chain is walked from the laxest and ends
at the first failure, which keeps the error level without further correction;
over the strata the level is divided (Bonferroni).  So, with probability
``1 - DELTA``, no stratum loses more than ``ALPHA`` of its good documents.
Of the certified configurations the laxest that rejects most bad documents is
used.  Strata that cannot be certified, and unlabelled ones, use the cutoffs
certified for all documents together, if any; without them no rule rejects.

All statistics are counts over all labelled rows, summed by Spark; only
histograms and counts (bounded by strata x rules x bins) reach the driver.

Defined results: null and empty texts have no words and fail the base rules; a
null language belongs to the pooled stratum; of several labels of one id the
highest counts; labels that are null are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordCodes, bounded_batches, id_remainder, window_hashes

ALPHA = 0.01          # most good documents that a stratum may lose
DELTA = 0.05          # probability that any stratum's guarantee fails
BINS = 2000           # ratios are compared in steps of 1/BINS
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004)  # share of good documents beyond a cutoff, laxest first
MIN_GOOD = 100        # labelled good documents that a stratum of its own needs
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
POOLED = "*"

# Rules: name -> numerator and denominator among the measures; a high ratio is bad.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_upper", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "stutter": ("n_stutter", "n_words"),
}

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_lines", "n_upper", "n_shouts", "n_digits", "n_stutter"]
_MEASURES_DDL = ", ".join(f"{m} long" for m in _MEASURES)


def repeated_words(hashes: np.ndarray, k: int = 8) -> int:
    """Words that lie in some window of ``k`` words found at least twice."""
    windows = window_hashes(hashes, k)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + k, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None, codes: WordCodes) -> tuple[int, ...]:
    """The measures of one text, in the order of ``_MEASURES``."""
    if not text:
        return (0,) * len(_MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    hashes = codes.hash_words(words)
    ascii_codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return (len(words),
            len(text) - int(sum(ascii_codes[ord(c)] for c in _WHITE)),
            int(sum(ascii_codes[ord(c)] for c in _SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated_words(hashes),
            len(lines),
            int(ascii_codes[65:91].sum()),
            raw.count(b"!!"),
            int(ascii_codes[48:58].sum()),
            int((hashes[1:] == hashes[:-1]).sum()))


def measures(text: str = "text") -> Column:
    """Struct of the measures of the text column."""

    @F.pandas_udf(_MEASURES_DDL)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for texts in batches:
            yield pd.DataFrame([measure(t, codes) for t in texts], columns=_MEASURES, dtype="int64")

    return measured(F.col(text))


def _ratio(rule: str, m: str) -> Column:
    """The rule's ratio in whole steps of 1/BINS, rounded down; 0 without a denominator."""
    top, bottom = (F.col(f"{m}.{x}") for x in RULES[rule])
    return F.coalesce(F.floor(F.lit(BINS) * top / F.nullif(bottom, F.lit(0))), F.lit(0)).cast("int")


def base_failed(m: str = "m") -> Column:
    return ((F.col(f"{m}.n_words") < MIN_WORDS)
            | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{m}.n_words")))


def upper_bound(failures: int, trials: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which so few failures have probability ``delta``."""
    if trials <= 0 or failures >= trials:
        return 1.0
    lo, hi = failures / trials, 1.0
    log_choose = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1)
                  for i in range(failures + 1)]
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (trials - i) * math.log1p(-p)) for i, c in enumerate(log_choose))
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


@dataclass
class Thresholds:
    """Cutoffs by stratum: a ratio (in steps) above its cutoff rejects."""

    cutoffs: dict[str, dict[str, int]] = field(default_factory=dict)
    bounds: dict[str, float] = field(default_factory=dict)

    def rejects(self, lang: Column, m: str = "m") -> Column:
        def over(cut: dict[str, int]) -> Column:
            out = F.lit(False)
            for rule, most in cut.items():
                out = out | (_ratio(rule, m) > most)
            return out

        own = F.lit(False) if POOLED not in self.cutoffs else over(self.cutoffs[POOLED])
        for stratum, cut in self.cutoffs.items():
            if stratum != POOLED:
                own = F.when(lang == stratum, over(cut)).otherwise(own)
        return own


def fit(measured: DataFrame, labels: DataFrame) -> Thresholds:
    """Choose and certify cutoffs from (id, stratum, m) rows and labels (doc_id, quality).

    Documents that fail the base rules are rejected anyway and take no part.
    """
    truth = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good")))
    rows = (measured.where(~base_failed()).join(truth, "id")
            .select(F.coalesce("stratum", F.lit(POOLED)).alias("stratum"), "good",
                    (id_remainder("id", 2) == 0).alias("choose"), *[_ratio(r, "m").alias(r) for r in RULES]))
    strata = (rows.where("choose and good = 1").groupBy("stratum").count()
              .where((F.col("count") >= MIN_GOOD) & (F.col("stratum") != POOLED)).select("stratum").collect())
    names = sorted(r.stratum for r in strata) + [POOLED]

    bins = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES]))
    histogram = (rows.where("choose").select("stratum", "good", bins.alias("x"))
                 .groupBy("stratum", "good", "x.rule", "x.bin").count())
    listed = F.col("stratum").isin(names[:-1]) if len(names) > 1 else F.lit(False)
    histogram = (histogram.withColumn("stratum", F.explode(F.when(
        listed, F.array("stratum", F.lit(POOLED))).otherwise(F.array(F.lit(POOLED)))))
        .groupBy("stratum", "good", "rule", "bin").agg(F.sum("count").alias("n")).collect())
    chains = {s: [_cutoffs(histogram, s, level) for level in LEVELS] for s in names}

    counts = []
    for s in names:
        mine = F.lit(True) if s == POOLED else F.col("stratum") == s
        for i, cut in enumerate(chains[s]):
            over = F.lit(False)
            for rule, most in cut.items():
                over = over | (F.col(rule) > most)
            for good in (0, 1):
                for choose in (True, False):
                    hit = mine & over & (F.col("good") == good) & (F.col("choose") == choose)
                    counts.append(F.count(F.when(hit, 1)).alias(f"{len(counts)}"))
        for choose in (True, False):
            counts.append(F.count(F.when(mine & (F.col("good") == 1) & (F.col("choose") == choose), 1))
                          .alias(f"{len(counts)}"))
    values = iter(rows.agg(*counts).first())

    result = Thresholds()
    for s in names:
        seen = [[[next(values), next(values)] for _ in (0, 1)] for _ in chains[s]]
        _, held = next(values), next(values)
        best, caught = None, 0
        for cut, (bad, good) in zip(chains[s], seen, strict=True):
            bound = upper_bound(good[1], held, DELTA / len(names))
            if bound > ALPHA:
                break
            if bad[0] > caught:
                best, caught = (cut, bound), bad[0]
        if best:
            result.cutoffs[s], result.bounds[s] = best
    return result


def _cutoffs(histogram, stratum: str, level: float) -> dict[str, int]:
    """Per rule the lowest cutoff that at most ``level`` of the stratum's good documents exceed."""
    out = {}
    for rule in RULES:
        good, bad = (sorted((r.bin, r.n) for r in histogram
                            if r.stratum == stratum and r.rule == rule and (r.good > 0) == wanted)
                     for wanted in (True, False))
        n_good, n_bad = sum(n for _, n in good), sum(n for _, n in bad)
        left = most = math.floor(level * n_good)
        while good and good[-1][1] <= left:
            left -= good.pop()[1]
        if good and n_bad:
            cut = good[-1][0]
            caught = sum(n for b, n in bad if b > cut)
            if caught and caught / n_bad >= 2 * (most - left) / n_good:
                out[rule] = cut
    return out


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      stratum_col: str = "lang") -> DataFrame:
    """Rows (id, stratum, m) of every document."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                       measures(text_col).alias("m"))


def judge(measured: DataFrame, thresholds: Thresholds) -> DataFrame:
    """``measured`` with base_failed and kept."""
    return (measured.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~thresholds.rejects(F.col("stratum"))))
