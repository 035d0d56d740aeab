"""Splitting text into pre-tokens, as the byte-level vocabularies do before merging."""

from __future__ import annotations

import re

import regex

# Fixed value: the pre-token pattern the two byte-level vocabulary files were built with.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The classes of that pattern within Latin-1: letters, numbers and white space.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0")     # the characters of the last class
_LATIN1 = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Splitter:
    """Pre-tokens of a text, in order; their concatenation is the text.

    Texts within Latin-1 go through an equal pattern written with explicit
    classes, which the plain ``re`` module runs about twice as fast; all
    others, and any other pattern, go through the Unicode pattern itself.
    """

    def __init__(self, pattern: str = GPT_PATTERN):
        self._full = regex.compile(pattern).findall
        self._fast = _LATIN1.findall if pattern == GPT_PATTERN else None

    def is_latin(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self._fast is not None

    def split(self, text: str) -> list[str]:
        return self._fast(text) if self.is_latin(text) else self._full(text)
