"""Operator 7: toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat, target, negation, report, other.  Four
transducers read a clause's classes in turn, composed into one machine:
negation and reported speech weaken what they govern, a target close by
strengthens it, and a threat counts only with a target.  A clause that matches
has a score; a document's score is a logistic function of its clauses' sum,
the number of matched clauses and its length, so isolated words weigh little.

The insult lexicon and its weights are learned from labelled documents: words
and word beginnings that are far more frequent in toxic ones (log odds, with
least support), besides short fixed lists of insult, threat, target,
negation and report words.  Both the lexicon and the logistic function are fitted on a
bounded sample: up to ``SAMPLE_PER_LABEL`` labelled documents per label, three
fifths for the lexicon, the rest for the function.

Defined results: null and empty texts get the score of a text without a match;
without labels of both kinds the score is 0 for all; of several labels of one
id the highest counts; null labels and ids are not learned from; a null id
counts as not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, free_name
from quire.llm.transducers import Transducer
from quire.session import materialize

SAMPLE_PER_LABEL = 2048
MAX_ENTRIES = 400          # learned lexicon entries
MIN_SUPPORT, MIN_LOG_ODDS = 5, 1.5
FIXED_WEIGHT = 4.0         # of a fixed insult that was not learned
STEMS = range(4, 10)       # lengths of word beginnings that are tried
CUTOFF = 0.7

# Fixed word lists, in natural order.
INSULTS = ("idiot moron imbecile stupid dumb fool loser scum trash garbage vermin pathetic worthless disgusting clown "
           "jerk creep freak coward liar dumm dummkopf blöd abschaum versager widerlich erbärmlich "
           "imbécile crétin débile ordure minable dégoûtant idiota imbécil estúpido basura escoria patético asqueroso"
           ).split()
THREATS = "beat burn crush destroy hurt kill punch shoot smash stab strangle töte tuer mataré".split()
TARGETS = ("you your yours yourself he him she her they them these those people "
           "du dich dir ihr euch er ihn sie tu te toi vous il lui elle ils elles tú ti usted él ella ellos ellas").split()
NEGATIONS = "no not never neither nor without nicht nie kein keine keinen ne pas jamais ni sin nunca jamás".split()
REPORTS = ("said says say called calls wrote writes claims claimed quoted reported "
           "sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"
_CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
NEGATION_SPAN, TARGET_SPAN = 3, 5
NEGATED, REPORTED, AIMED = 0.3, 0.5, 1.25

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_WORDS = re.compile(r"[^\W\d_]+")


def _hostile(a: str) -> bool:
    return a in (INSULT, THREAT)


def negation() -> Transducer:
    """Weakens hostile words up to NEGATION_SPAN tokens after a negation."""
    def rule(s: int, a: str):
        if a == NEGATION:
            return NEGATION_SPAN, OTHER, 1.0
        return max(0, s - 1), a, NEGATED if s and _hostile(a) else 1.0
    return Transducer.of(range(NEGATION_SPAN + 1), _CLASSES, rule)


def reported_speech() -> Transducer:
    """Weakens hostile words after a report word, to the end of the clause."""
    def rule(s: int, a: str):
        if a == REPORT:
            return 1, OTHER, 1.0
        return s, a, REPORTED if s and _hostile(a) else 1.0
    return Transducer.of(range(2), _CLASSES, rule)


def aim() -> Transducer:
    """Marks hostile words within TARGET_SPAN tokens after a target; marks targets soon after a hostile word.

    States up to TARGET_SPAN count down from a target, those above from a hostile word without one.
    """
    def rule(s: int, a: str):
        if a == TARGET:
            late = s > TARGET_SPAN
            return TARGET_SPAN, "aimed-late" if late else OTHER, 1.0
        near = 0 < s <= TARGET_SPAN
        if _hostile(a):
            return (s - 1, "aimed-" + a, 1.0) if near else (2 * TARGET_SPAN, a, 1.0)
        return (s - 1 if s and s != TARGET_SPAN + 1 else 0), OTHER, 1.0
    return Transducer.of(range(2 * TARGET_SPAN + 1), _CLASSES, rule)


def verdict() -> Transducer:
    """Turns marks into the weight of a match; a threat without a target weighs nothing."""
    weights = {OTHER: 0.0, "aimed-late": 0.0, INSULT: 1.0, "aimed-insult": AIMED, THREAT: 0.0, "aimed-threat": AIMED}
    return Transducer.of([0], weights, lambda _, a: (0, a, weights[a]))


GRAMMAR = negation().then(reported_speech()).then(aim()).then(verdict())


@dataclass
class Model:
    """Lexicon (a word ends in ``$``, a beginning does not) with weights, and the logistic function."""

    entries: dict[str, float] = field(default_factory=dict)
    coef: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    bias: float = -math.inf

    def __post_init__(self) -> None:
        self._fixed = ({w: (INSULT, FIXED_WEIGHT) for w in INSULTS} | {w: (THREAT, 3.0) for w in THREATS} | {w: (TARGET, 0.0) for w in TARGETS}
                       | {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS})
        self._memo: dict[str, tuple[str, float] | None] = {}

    def classify(self, word: str) -> tuple[str, float] | None:
        """Class and weight of a lower-cased word; None for other words."""
        if word + "$" in self.entries:
            return INSULT, self.entries[word + "$"]
        if word in self._fixed:
            return self._fixed[word]
        for n in range(min(len(word), STEMS[-1]), STEMS[0] - 1, -1):
            if word[:n] in self.entries:
                return INSULT, self.entries[word[:n]]
        return None

    def clauses(self, text: str | None) -> tuple[list[tuple[float, str]], int]:
        """(score, words) of each matched clause, and the number of words."""
        tokens = _TOKENS.findall(text.lower()) if text else []
        memo = self._memo
        if len(memo) > 400_000:
            memo.clear()
        for w in set(tokens).difference(memo):
            memo[w] = ("end", 0.0) if not w[0].isalpha() else self.classify(w)
        marks = [(i, m) for i, m in enumerate(map(memo.__getitem__, tokens)) if m is not None]
        out: list[tuple[float, str]] = []
        start, inside, ends = 0, [], 0
        for i, m in [*marks, (len(tokens), ("end", 0.0))]:
            if m[0] != "end":
                inside.append((i, m))
                continue
            if any(_hostile(c) for _, (c, _) in inside):
                score = self._clause(inside, i - start, start)
                if score > 0:
                    out.append((score, " ".join(tokens[start:i])))
            start, inside = i + 1, []
            ends += 1
        return out, len(tokens) - ends + 1

    @staticmethod
    def _clause(inside: list[tuple[int, tuple[str, float]]], length: int, start: int) -> float:
        classes, own = [OTHER] * length, [0.0] * length
        for i, (c, w) in inside:
            classes[i - start], own[i - start] = c, w
        total, last = 0.0, 0.0
        for (mark, weight), w in zip(GRAMMAR.run(classes), own, strict=True):
            if mark == "aimed-late":
                total += last * (AIMED - 1)
            elif w:
                total += weight * w
                last = weight * w
        return total

    def features(self, text: str | None) -> tuple[list[float], list[tuple[float, str]]]:
        matched, words = self.clauses(text)
        return [math.log1p(sum(s for s, _ in matched)), math.log1p(len(matched)), math.log1p(words)], matched

    def score(self, text: str | None) -> tuple[float, int, str | None]:
        """Score, number of matched clauses, and the strongest."""
        x, matched = self.features(text)
        z = self.bias + sum(a * b for a, b in zip(self.coef, x, strict=True))
        p = 0.0 if z < -700 else 1 / (1 + math.exp(-z))
        return p, len(matched), max(matched, key=lambda m: m[0])[1] if matched else None


def _candidates(text: str) -> set[str]:
    words = set(_WORDS.findall(text.lower()))
    return {w + "$" for w in words} | {w[:n] for w in words for n in STEMS if n < len(w) or n == len(w)}


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and other documents of the partition hold each candidate, of whichever label."""
    toxic, other = Counter(), Counter()
    for rows in batches:
        for text, label in zip(rows["text"], rows["label"], strict=True):
            (toxic if label else other).update(_candidates(text or ""))
    entries = list(toxic.keys() | other.keys())
    for at in range(0, len(entries), 10_000):
        part = entries[at:at + 10_000]
        yield pd.DataFrame({"entry": part, "toxic": [toxic[e] for e in part], "other": [other[e] for e in part]})


def choose_entries(rows: list[tuple[str, int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Lexicon from (entry, toxic, other) counts: longer entries only where they say more than shorter ones.

    Weights are log odds less one standard error, so that rare entries weigh little.
    """
    odds = {e: math.log((t + 0.5) / (n_toxic + 1)) - math.log((o + 0.5) / (n_other + 1))
            - math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)) for e, t, o in rows}
    seen = {e: t for e, t, _ in rows}
    ranked = sorted((e for e in odds if odds[e] >= MIN_LOG_ODDS), key=lambda e: (-seen[e] * odds[e], e))
    kept: dict[str, float] = {}
    for e in ranked:
        word = e.rstrip("$")
        longer = [x for x in odds if x != e and not e.endswith("$") and x.rstrip("$").startswith(word)
                  and len(x) > len(e) and seen[x] >= 0.95 * seen[e]]
        shorter = [word[:n] for n in STEMS if n < len(e) and word[:n] in kept]
        if longer or any(odds[e] <= odds[s] + 0.3 for s in shorter):
            continue
        kept[e] = odds[e]
        if len(kept) == MAX_ENTRIES:
            break
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[list[float], float]:
    """Newton's method; both labels carry their own frequency, as scores are probabilities."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows of ``docs`` where ``learn``, a condition on the id, holds."""
    bounded_batches(docs.sparkSession)
    truth = (labels.where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("label"))
             .select(F.col("doc_id").alias(id_col), "label").where(learn))
    order = F.xxhash64(id_col)
    chosen = materialize(truth.groupBy("label", F.pmod(order, F.lit(SAMPLE_PER_LABEL)))
                         .agg(F.min(F.struct(order, F.col(id_col))).alias("x"))
                         .select(F.col(f"x.{id_col}").alias("id"), (F.col("label") > 0).cast("int").alias("label"),
                                 (F.pmod(F.xxhash64(F.lit("fold"), F.col(f"x.{id_col}")), F.lit(5)) < 3).alias("words")),
                         "toxic-sample")     # at most SAMPLE_PER_LABEL rows a label
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "id"), "toxic-texts")
    size = {(r.words, r.label): r["count"] for r in sample.groupBy("words", "label").count().collect()}
    n_toxic, n_other = size.get((True, 1), 0), size.get((True, 0), 0)
    if not (n_toxic and n_other and size.get((False, 1)) and size.get((False, 0))):
        return Model()
    odds = (F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1)))
    counted = (sample.where("words").select("text", "label")
               .mapInPandas(_counts, "entry string, toxic long, other long")
               .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
               .where((F.col("toxic") >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS))
               .orderBy(F.desc(F.col("toxic") * odds), "entry").limit(20 * MAX_ENTRIES).collect())
    model = Model(choose_entries([(r.entry, r.toxic, r.other) for r in counted], n_toxic, n_other))
    shared = docs.sparkSession.sparkContext.broadcast(model.entries)

    @F.pandas_udf("array<double>")
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(shared.value)
        for part in batches:
            yield pd.Series([own.features(t)[0] for t in part], dtype=object)

    rows = sample.where("not words").select("id", "label", featured("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.id, r.label))
    model.coef, model.bias = fit_logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``toxicity`` (or the next free name): score, predicted, n_clauses, clause (the strongest)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.entries, model.coef, model.bias))

    @F.pandas_udf("score double, predicted int, n_clauses int, clause string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for part in batches:
            rows = [own.score(t) for t in part]
            yield pd.DataFrame({"score": [r[0] for r in rows], "predicted": [int(r[0] >= CUTOFF) for r in rows],
                                "n_clauses": [r[1] for r in rows], "clause": [r[2] for r in rows]})

    return docs.withColumn(free_name(docs, "toxicity"), scored(F.col(text_col)))
