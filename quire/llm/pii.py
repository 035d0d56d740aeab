"""Operator 10: personal data by proposal, checksum and context.

Regular expressions propose spans; validators confirm them (parts of an IPv4
address, Luhn for cards, mod-97 for IBANs, digit counts for phones); words
around a span adjust its score.  Base kinds are email, ip, card and phone, each
matched leftmost without overlaps of its own kind; IBANs and identity numbers
named by their context are added.  An IBAN ends at the length that its country
code fixes, whatever capitals or digits follow.

Every pattern reads a text in linear time: an email is grown to both sides of
its ``@``, and digit runs are taken whole.

Positions are code points, ends exclusive.  Null and empty texts have no span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Fixed lengths of IBANs by country code, without spaces.
IBAN_LENGTH = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}

BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "id": 0.3}
# Fixed context words by kind: those that support a span, and those that speak against it.
SUPPORT = {
    "email": {"email", "mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "login", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "id": {"ssn", "social", "security", "identity", "passport", "ausweis"},
}
AGAINST = {"version", "v", "example", "sample", "isbn", "order", "invoice", "serial", "section"}
CONTEXT = 48              # code points read to each side
STEP = 0.15
MIN_ADDED = 0.4           # score that an added span needs; base spans stay whatever their score
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    value = 0
    for c in plain[4:] + plain[:4]:
        value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return value == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        last = max(end, at + 1)
        at = text.find("@", last)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        for end in _iban_ends(text, m):
            if mod97(text[m.start():end]):
                yield m.start(), end
                at = end
                break


def _iban_ends(text: str, m: re.Match) -> list[int]:
    """Word ends where a proposal may stop: that of its country's length or, of unknown countries, all, longest first."""
    fixed = IBAN_LENGTH.get(m.group()[:2])
    ends, size = [], 0
    for i in range(m.start(), m.end()):
        size += text[i] != " "
        last = text[i] != " " and not (text[i + 1:i + 2].isascii() and text[i + 1:i + 2].isalnum())
        if last and (size >= 15 if fixed is None else size == fixed):
            ends.append(i + 1)
    return ends[::-1]


def identity_numbers(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _ID.finditer(text))


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "id": identity_numbers}


def confidence(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, moved a step up for a supporting word nearby and down for an opposing one before."""
    before = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT):start])}
    after = {w.lower() for w in _WORD.findall(text[end:end + CONTEXT])}
    score = BASE_SCORE[kind] + STEP * bool((before | after) & SUPPORT[kind]) - STEP * bool(before & AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end, score), by kind as listed and then by start."""
    if not text:
        return []
    out: list[Span] = []
    for kind in KINDS:
        for start, end in _FINDERS[kind](text):
            score = confidence(text, kind, start, end)
            if kind in BASE_KINDS or score >= MIN_ADDED:
                out.append((kind, start, end, score))
    return out


def spans_text(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in kinds)


_OUT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "scores array<double>")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``pii`` (or the next free name): counts of the base kinds, digest and list of spans, their scores."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(_OUT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = find(text)
                base = spans_text(spans, BASE_KINDS)
                rows.append((*(sum(s[0] == k for s in spans) for k in BASE_KINDS),
                             hashlib.sha256(base.encode()).hexdigest(), spans_text(spans, KINDS), [s[3] for s in spans]))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.withColumn(free_name(docs, "pii"), scanned(F.col(text_col)))
