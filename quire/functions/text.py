"""Scalar text functions (S-1 .. S-21) as Column expressions.

Regex dialect notes (Java regex in Spark):
* ``(?m)`` anchors per line; Java's ``\\s`` misses U+001C..1F, U+0085 and the
  Unicode spaces that Python's ``\\s`` covers, so the header pattern spells
  them out.  ``(?d)`` restricts line terminators to ``\\n`` like Python.
* ``round`` is half-up (2.675 -> 2.68) in Spark and DuckDB, half-even-ish in
  Python; the raw score is kept next to the rounded one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
PREVIEW_CHARS = 300                 # search-card preview length
DEFAULT_WEB_TITLE = "Web Source"    # title of a web citation without one
CONFIDENCE_THRESHOLD = 0.7          # "search the web below this"
# -----------------------------------------------------------------------------

_HEADER = r"(?md)^#{1,6}[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_BOLD = r"(?d)\*\*(.*?)\*\*"
_LAST_EXT = r"(?s)\.[^.]*$"


def strip_markdown(col: Column) -> Column:
    """S-1: drop ``#``..``######`` headers at line starts, then unwrap ``**x**``."""
    return F.regexp_replace(F.regexp_replace(col, _HEADER, ""), _BOLD, "$1")


def clean_chunk(col: Column) -> Column:
    """S-2: ``**x**`` -> backtick-x-backtick, then escape every ``$`` as ``\\$``.

    Applied per streamed delta, so bold split over two deltas stays as is.
    """
    ticked = F.regexp_replace(col, _BOLD, "`$1`")
    return F.replace(ticked, F.lit("$"), F.lit("\\$"))


def _drop_last_ext(col: Column) -> Column:
    return F.regexp_replace(col, _LAST_EXT, "")


def citation_file_id(filename: Column) -> Column:
    """S-3: third ``_`` piece (at most 3 pieces) minus its last extension; NULL if < 3 pieces."""
    parts = F.split(filename, "_", 3)
    return _drop_last_ext(F.get(parts, 2))


def hit_file_id(filename: Column) -> Column:
    """S-4: first ``_`` piece minus its last extension (differs from S-3 on purpose)."""
    parts = F.split(filename, "_", 3)
    return _drop_last_ext(F.get(parts, 0))


def document_url(base_url: str, file_id: Column) -> Column:
    """S-5: base URL (a parameter) + file id."""
    return F.concat(F.lit(base_url), file_id)


def round_score(score: Column, places: int = 2) -> Column:
    """S-6."""
    return F.round(score, places)


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    """S-7: first n characters, plus ``...`` only when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def date_range_days(date_from: Column, date_to: Column) -> Column:
    """S-9: to - from in days."""
    return F.datediff(date_to, date_from)


def company_label(name: Column, ticker: Column) -> Column:
    """S-10: ``Name (TICKER)``."""
    return F.concat(name, F.lit(" ("), ticker, F.lit(")"))


_LABEL_RE = r"^(.*) \(([^()]*)\)$"


def parse_company_label(label: Column) -> tuple[Column, Column]:
    """S-10 parse on the *last* `` (`` so names holding `` (`` survive (fixes Q1)."""
    name = F.regexp_extract(label, _LABEL_RE, 1)
    ticker = F.regexp_extract(label, _LABEL_RE, 2)
    ok = label.rlike(_LABEL_RE)
    return F.when(ok, name), F.when(ok, ticker)


def qa_line(question: Column, answer: Column) -> Column:
    """S-11: the input line of a summary."""
    return F.concat(F.lit("User: "), question, F.lit(" | Assistant: "), answer)


def store_name(ticker: Column) -> Column:
    """S-12."""
    return F.concat(ticker, F.lit("_vs"))


def markdown_link(title: Column, url: Column) -> Column:
    """S-13: ``- [title](url)`` + newline; missing title -> ``Web Source``."""
    return F.concat(F.lit("- ["), F.coalesce(title, F.lit(DEFAULT_WEB_TITLE)), F.lit("]("), url, F.lit(")\n"))


def json_or_empty(col: Column) -> Column:
    """S-14: JSON text of a struct/array, ``{}`` when absent."""
    return F.coalesce(F.to_json(col), F.lit("{}"))


def parse_json(col: Column, schema: str) -> Column:
    """S-14: a JSON reply as a struct; fields it lacks, and all of a broken reply, are NULL."""
    return F.from_json(col, schema)


def list_cell(col: Column) -> Column:
    """S-16: an array in a CSV cell, as JSON text (Spark CSV rejects arrays)."""
    return F.to_json(col)


def result_id(*cols: Column) -> Column:
    """S-17: deterministic result id (sha-256 of the parts), stable on re-runs."""
    return F.sha2(F.concat_ws("\u001f", *[c.cast("string") for c in cols]), 256)


def confidence_band(score: Column) -> Column:
    """S-18: band label, half-open from below."""
    return (F.when(score.isNull(), F.lit(None))
            .when(score >= 1.0, F.lit("direct quote"))
            .when(score >= 0.8, F.lit("reliable company document"))
            .when(score >= 0.7, F.lit("reputable web source"))
            .when(score >= 0.5, F.lit("indirect or older"))
            .otherwise(F.lit("uncertain")))


def below_threshold(score: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """S-18: should the web be searched (score under the threshold)?"""
    return score < F.lit(threshold)


CONFIDENCE_RE = r"Confidence Score:\s*([0-9]+(?:\.[0-9]+)?)"


def parse_confidence(answer: Column) -> Column:
    """S-19: the number after the last ``Confidence Score:``, as double (NULL if none).

    Linear in the text: all matches are extracted and the last one kept (a
    leading ``.*`` would make ``find()`` quadratic on answers without a score).
    """
    raw = F.try_element_at(F.regexp_extract_all(answer, F.lit(CONFIDENCE_RE), F.lit(1)), F.lit(-1))
    return raw.try_cast("double")


SOURCE_RE = r"(?md)^[ \t]*-?[ \t]*Source:[ \t]*([^\n]*)"


def parse_sources(answer: Column) -> Column:
    """S-19: the rest of every ``Source:`` line (optionally bulleted), in order."""
    return F.regexp_extract_all(answer, F.lit(SOURCE_RE), F.lit(1))


def selected_types(col: Column) -> Column:
    """S-21: NULL list == empty list, NULL items dropped (fixes Q2)."""
    return F.array_compact(F.coalesce(col, F.array().cast("array<string>")))
