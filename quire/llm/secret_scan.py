"""Operator 9: secrets by base patterns and by formats inferred from them.

Base kinds: an assignment to a telling name, an access key with its prefix, and
a long run of hex digits, each leftmost without overlaps of its own kind.  The
credentials that these find in the corpus are labelled by kind; from a bounded
sample of them (up to ``SAMPLE`` a kind, those of least hash in as many
buckets, values of up to ``MAX_VALUE`` characters) one probabilistic automaton
per kind is inferred by merging statistically compatible prefix-tree states
(``automata``), over classes of characters.  A further automaton is inferred
from ordinary tokens, those outside all base spans.  These include credentials
that no base pattern finds, so tokens that fit a format as its credentials do,
and better than the ordinary ones, are set aside first (``_unlabelled``).
Every candidate token is then scored by the best format's log likelihood against
the ordinary one; the threshold is ``MARGIN`` above all but ``FALSE_POSITIVES`` of
the ordinary tokens of a held-back fold.  Tokens above it become spans of kind
``format`` unless they overlap a base span.  Candidates have ``MIN_CANDIDATE``
characters or more: below that a format and an ordinary word differ by too few
characters to tell, so shorter credentials are found by the base patterns alone.

Positions are code points, ends exclusive.  Null and empty texts have no span;
without any credential in the corpus no format is learned and base spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.automata import Automaton, infer
from quire.llm.common import bounded_batches, free_name
from quire.session import materialize

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "format")
SAMPLE = 512
MAX_VALUE = 256
MIN_SAMPLE = 8            # credentials of a kind that a format needs
MIN_CANDIDATE = 16
MARGIN = 0.25             # log likelihood per character above the ordinary tokens
FALSE_POSITIVES = 0.01    # share of the held-back ordinary tokens that the threshold may leave above it
LOW = 0.05                # share of a format's own credentials that may fit it worse than a token set aside
ROUNDS = 3

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")

# Classes of characters: digits, hex letters and other letters of either case; signs stand for themselves.
_CLASS_CHARS = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF",
                "L": "GHIJKLMNOPQRSTUVWXYZ"}
_SIZES = {c: len(chars) for c, chars in _CLASS_CHARS.items()}
_TO_CLASS = str.maketrans({ch: c for c, chars in _CLASS_CHARS.items() for ch in chars})

Span = tuple[str, int, int]


def base_matches(text: str) -> list[tuple[Span, str]]:
    """Base spans by kind and start, each with the credential it holds."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(("assign", *m.span()), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(("access", *m.span()), m[0]) for m in _ACCESS.finditer(text)]
    out += [(("hex", *m.span()), m[0]) for m in _HEX.finditer(text)]
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Maximal tokens long enough to be a credential, without the dots and signs at their ends."""
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip(".=-/+_")
        lead = len(token) - len(token.lstrip(".=-/+_"))
        if len(token) - lead >= MIN_CANDIDATE:
            yield m.start() + lead, m.start() + len(token), token[lead:]


@dataclass
class Formats:
    """Automata by kind, that of ordinary tokens, and the least score per character of a secret."""

    kinds: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None
    threshold: float = math.inf

    def score(self, token: str) -> float:
        """Best log likelihood ratio per character; -inf where no format accepts the token."""
        if not self.kinds:
            return -math.inf
        symbols = token.translate(_TO_CLASS)
        best = max(a.log_likelihood(symbols, -5.0 * len(token)) for a in self.kinds.values())
        if best == -math.inf:
            return best
        plain = self.ordinary.log_likelihood(symbols) if self.ordinary else -math.inf
        return (best - max(plain, -5.0 * len(token))) / len(token)

    def is_secret(self, token: str) -> bool:
        return self.score(token) >= self.threshold


def train(credentials: dict[str, list[str]], ordinary: list[str]) -> Formats:
    """Formats from labelled credentials; of the ordinary tokens not set aside, every other is held back for the threshold."""
    ordinary = sorted(set(ordinary))
    model = Formats({k: infer([v.translate(_TO_CLASS) for v in values], _SIZES)
                     for k, values in sorted(credentials.items()) if len(values) >= MIN_SAMPLE})
    if not model.kinds:
        return model
    plain = _unigram(ordinary)
    for _ in range(ROUNDS):
        aside = _unlabelled(credentials, ordinary, plain)
        ordinary = [t for t in ordinary if t not in aside]
        fit, held = ordinary[::2], ordinary[1::2]
        if fit:
            model.ordinary = infer([v.translate(_TO_CLASS) for v in fit], _SIZES)
            plain = model.ordinary.log_likelihood
        if not aside:
            break
    scores = sorted((s for s in map(model.score, held) if s > -math.inf), reverse=True)
    above = int(FALSE_POSITIVES * len(held))
    model.threshold = MARGIN + max([0.0, *scores[above:above + 1]])
    return model


def _unigram(tokens: list[str]) -> Callable[[str], float]:
    """Log likelihood by the classes' shares alone, which a few tokens of another kind hardly change."""
    counts = Counter(a for t in tokens for a in t.translate(_TO_CLASS))
    total = sum(counts.values()) + len(_SIZES) + 1
    logs = {a: math.log((counts[a] + 1) / total / _SIZES.get(a, 1)) for a in {*counts, *_SIZES}}
    return lambda symbols: sum(logs.get(a, -math.log(total)) for a in symbols)


def _unlabelled(credentials: dict[str, list[str]], ordinary: list[str], plain: Callable[[str], float]) -> set[str]:
    """Ordinary tokens that are like a kind's credentials, by an automaton of one half of these and the scores of the other.

    A token must prefer the format to ``plain``, no less than all but ``LOW`` of
    the credentials do, and its sequence of classes must be as likely as theirs.
    """
    out: set[str] = set()
    for values in (sorted(set(v)) for v in credentials.values() if len(v) >= MIN_SAMPLE):
        half = infer([v.translate(_TO_CLASS) for v in values[::2]], _SIZES)

        def fits(token: str, half: Automaton = half) -> tuple[float, float]:
            symbols = token.translate(_TO_CLASS)
            own = half.log_likelihood(symbols, -5.0 * len(token))
            classes = own + sum(math.log(_SIZES.get(a, 1)) for a in symbols)
            return (own - max(plain(symbols), -5.0 * len(token))) / len(token), classes / len(token)

        known = [f for f in map(fits, values[1::2]) if f[0] > -math.inf]
        if known:
            better, likely = (sorted(x)[int(LOW * len(known))] for x in zip(*known, strict=True))
            out.update(t for t in ordinary if (f := fits(t))[0] >= max(0.0, better) and f[1] >= likely)
    return out


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct (kind, value) of a batch: credentials by kind, and candidates outside them as ``ordinary``."""
    for rows in batches:
        found = set()
        for text in rows["text"]:
            if not text:
                continue
            base = base_matches(text)
            found.update((s[0], v) for s, v in base if len(v) <= MAX_VALUE)
            held = [s for s, _ in base]
            found.update(("ordinary", t) for a, b, t in candidates(text) if len(t) <= MAX_VALUE
                         and not any(x < b and a < y for _, x, y in held))
        yield pd.DataFrame(sorted(found), columns=["kind", "value"])


def fit(docs: DataFrame, text_col: str = "text") -> Formats:
    """Infer the formats from the credentials that the base patterns find in all documents."""
    bounded_batches(docs.sparkSession)
    order = F.xxhash64("value")
    chosen = materialize(
        docs.select(F.col(text_col).alias("text")).mapInPandas(_labelled, "kind string, value string")
        .groupBy("kind", F.pmod(order, F.lit(SAMPLE)).alias("bucket"))
        .agg(F.min(F.struct(order.alias("h"), "value")).alias("x")).select("kind", "x.value"), "credentials")
    by_kind: dict[str, list[str]] = {}
    for r in chosen.collect():       # at most SAMPLE values for each of four kinds
        by_kind.setdefault(r.kind, []).append(r.value)
    ordinary = by_kind.pop("ordinary", [])
    return train(by_kind, ordinary)


def find(text: str | None, formats: Formats, memo: dict[str, bool] | None = None) -> list[Span]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    memo = {} if memo is None else memo
    spans = [s for s, _ in base_matches(text)]
    base = list(spans)
    for start, end, token in candidates(text):
        known = memo.get(token)
        if known is None:
            if len(memo) > 200_000:
                memo.clear()
            known = memo[token] = formats.is_secret(token)
        if known and not any(x < end and start < y for _, x, y in base):
            spans.append(("format", start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_text(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in kinds)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch covered by spans replaced by the mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_OUT = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, redacted string")


def scan(docs: DataFrame, formats: Formats, text_col: str = "text", redacted: bool = False,
         out_col: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``out_col`` (``secrets`` or the next free name): counts, digest of the base spans, all spans, and the redacted text.

    ``redacted`` False leaves the last field null.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(formats)    # automata of bounded samples

    @F.pandas_udf(_OUT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        for texts in batches:
            rows = []
            for text in texts:
                spans = find(text, shared.value, memo)
                base = spans_text(spans, BASE_KINDS)
                rows.append((*(sum(s[0] == k for s in spans) for k in BASE_KINDS),
                             hashlib.sha256(base.encode()).hexdigest(), spans_text(spans, KINDS),
                             sum(s[0] == "format" for s in spans),
                             (redact(text, spans) if spans else text) if redacted else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format",
                                              "redacted"])

    return docs.withColumn(out_col or free_name(docs, "secrets"), scanned(F.col(text_col)))
