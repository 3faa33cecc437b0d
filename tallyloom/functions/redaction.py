"""Private values taken out of payloads: only the values change, every other byte stays as it was.

A payload is read token by token. In JSON a private key hides the value behind its colon, whatever it is. A text inside a JSON string is read in
the same way as a payload of its own, so JSON in strings and sentences in strings are covered. In plain text a private name is a whole
word, bare or in quotes; it hides the value behind a colon or an equals sign. A name that says no value in such a way cannot be
judged, so the payload is refused as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose values are taken out of payloads, and what stands in their place (fixed values).
PRIVATE_KEYS = ("cardholder_id", "prescriber_id", "prescriber_npi", "rendering_provider_npi", "person_code", "bin", "pcn", "group_id")
REDACTED = "[REDACTED:PHI]"


class Refused(Exception):
    """A private name whose value cannot be told."""


class Token(NamedTuple):
    kind: str
    start: int
    end: int


_TOKENS = re.compile(r"""(?P<string>"(?:[^"\\]|\\.)*")|(?P<quoted>'[^']*')|(?P<word>\w+)|(?P<blank>\s+)|(?P<mark>.)""", re.DOTALL)
_OPEN, _CLOSE = {"{": "}", "[": "]"}, "}]"
#: What ends a bare value in plain text.
_ENDS = ",;&|)}]"


def _tokens(text: str) -> list[Token]:
    return [Token(str(m.lastgroup), m.start(), m.end()) for m in _TOKENS.finditer(text)]


def _said(text: str, token: Token) -> str | None:
    """The word that a token is, without its quotes."""
    raw = text[token.start : token.end]
    if token.kind == "string":
        try:
            return json.loads(raw, strict=False)
        except ValueError:
            return raw[1:-1]
    return raw[1:-1] if token.kind == "quoted" else raw if token.kind == "word" else None


class _Scan:
    """One pass over a text, which gathers what is to be replaced: ``start, end, replacement``."""

    def __init__(self, text: str, private: frozenset[str]) -> None:
        self.text, self.private, self.removed = text, private, set()
        self.tokens = _tokens(text)
        self.is_json = self._parses()
        self.changes: list[tuple[int, int, str]] = []

    def _parses(self) -> bool:
        try:
            return isinstance(json.loads(self.text), dict | list)
        except (ValueError, RecursionError):
            return False

    def _next(self, at: int) -> int:
        """The place of the next token that is not blank."""
        while at < len(self.tokens) and self.tokens[at].kind == "blank":
            at += 1
        return at

    def _mark(self, at: int) -> str:
        return self.text[self.tokens[at].start] if at < len(self.tokens) and self.tokens[at].kind == "mark" else ""

    def _behind(self, at: int) -> int:
        """The place behind the value that begins at ``at``: a string, what brackets hold, or a bare value."""
        if at < len(self.tokens) and self.tokens[at].kind in ("string", "quoted"):
            return at + 1
        depth = 0
        while at < len(self.tokens):
            mark = self._mark(at)
            if depth == 0 and (self.tokens[at].kind == "blank" or mark and mark in _ENDS):
                return at
            depth += (mark in _OPEN) - (mark != "" and mark in _CLOSE) if mark else 0
            at += 1
            if mark and mark in _CLOSE and depth == 0:
                return at
        return at

    def changed(self) -> str:
        at = 0
        while at < len(self.tokens):
            token = self.tokens[at]
            word = _said(self.text, token)
            sign = self._next(at + 1)
            named = word in self.private
            if named and self._mark(sign) and self._mark(sign) in (":" if self.is_json else ":="):
                at = self._hide(word, self._next(sign + 1))
                continue
            if word is not None and token.kind != "word":
                self._inside(token, word, alone=named and self.is_json)
            elif named:
                raise Refused(word)
            at += 1
        out, done = [], 0
        for start, end, new in self.changes:
            out += [self.text[done:start], new]
            done = end
        return "".join([*out, self.text[done:]])

    def _hide(self, name: str, at: int) -> int:
        behind = self._behind(at)
        start = self.tokens[at].start if at < len(self.tokens) else len(self.text)
        end = self.tokens[behind - 1].end if behind > at else start
        self.changes.append((start, end, json.dumps(REDACTED) if self.is_json else REDACTED))
        self.removed.add(name)
        return max(behind, at)

    def _inside(self, token: Token, word: str, alone: bool) -> None:
        """Texts in quotes are read by themselves. A JSON string that is nothing but a name says no value."""
        if alone or not any(p in word for p in self.private):
            return
        inner = _Scan(word, self.private)
        new = inner.changed()
        self.removed |= inner.removed
        if new != word:
            quote = self.text[token.start]
            self.changes.append((token.start, token.end, json.dumps(new, ensure_ascii=False) if quote == '"' else f"'{new}'"))


def redacted_text(payload: str, private: tuple[str, ...] = PRIVATE_KEYS) -> tuple[str | None, list[str] | None]:
    """The payload without private values, and the sorted names whose values went; both None where it is refused.

    A payload nested deeper than Python can follow is refused.
    """
    try:
        scan = _Scan(payload, frozenset(private))
        return scan.changed(), sorted(scan.removed)
    except (Refused, RecursionError):
        return None, None


def redaction(payload: Column, private: tuple[str, ...] = PRIVATE_KEYS) -> Column:
    """``redacted_text`` of a column as a struct of ``payload`` and ``removed``.

    What lies under a key has no bounded depth, so this is no composition of column functions.
    """

    @F.pandas_udf("payload string, removed array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(None, None) if t is None else redacted_text(t, private) for t in texts], columns=["payload", "removed"])

    return of(payload)


def redact_json(payload: Column, private: tuple[str, ...] = PRIVATE_KEYS) -> Column:
    """The payload with the values of private keys replaced, at any depth; null where it is refused."""
    return redaction(payload, private)["payload"]


def removed_keys(payload: Column, private: tuple[str, ...] = PRIVATE_KEYS) -> Column:
    """Names of the private keys that a payload holds, sorted; null where it is refused."""
    return redaction(payload, private)["removed"]
