"""Secret scans: fixed patterns, and guess costs of values in a credential's context.

The guess cost of a value is that of its cheapest segmentation into dictionary words, dates, repeats, keyboard walks
and brute-force characters, found by dynamic programming over its places: every segment that ends at a place is tried.
The dictionary is the vocabulary of a public tokenizer, whose ranks stand for how common a word is. A value that costs
a threshold or more is reported as a secret of kind ``guess``, beside what the patterns find.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value in a credential's context is a secret.
MIN_GUESSES_LOG10 = 9.0
#: Characters of the longest word, and of the longest repeat or keyboard walk that is one segment.
LONGEST_WORD, LONGEST_SEGMENT = 24, 48
#: Characters of the longest block that a repeat repeats.
LONGEST_BLOCK = 8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|authorization|bearer|private[_-]?key)["']?\s{0,4}(?:[:=]>?|->|\x20is\x20)\s{0,4}["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "credential", "authorization", "bearer", "private")
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates in the three orders, and years, each with the log10 of its guesses; lookaheads let them overlap.
_DATES = tuple(
    (re.compile(f"(?=({pattern}))", re.ASCII), price)
    for pattern, price in (
        (rf"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}", 4.5),
        (rf"{_DAY}[-/.]?{_MONTH}[-/.]?{_YEAR}", 4.5),
        (rf"{_MONTH}[-/.]?{_DAY}[-/.]?{_YEAR}", 4.5),
        (_YEAR, 2.1),
    )
)
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

_KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


@functools.cache
def _neighbours() -> dict[str, str]:
    at = {k: (r, c) for r, row in enumerate(_KEY_ROWS) for c, k in enumerate(row)}
    return {k: "".join(o for o, (r, c) in at.items() if o != k and abs(r - at[k][0]) <= 1 and abs(c - at[k][1]) <= 1) for k in at}


@functools.lru_cache(maxsize=2)
def _words(vocabulary: str) -> dict[str, float]:
    """log10 of each word's rank, from a vocabulary of ranked byte tokens."""
    import base64

    out: dict[str, float] = {}
    with open(vocabulary, "rb") as f:
        for line in f:
            token, rank = line.split()
            word = base64.b64decode(token).strip()
            if len(word) >= 3 and word.isalpha() and word.isascii():
                out.setdefault(word.decode().lower(), math.log10(int(rank) + 1))
    return out


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _char_cost(ch: str) -> float:
    if ch.isdigit():
        return 1.0
    if ch.isascii() and ch.isalpha():
        return math.log10(26)
    return math.log10(33) if ch.isascii() else 2.0


def word_cost(part: str, words: dict[str, float]) -> float | None:
    """What a part costs as a dictionary word, its capitals included; None if it is none."""
    price = words.get(part.lower())
    if price is None:
        return None
    upper = sum(c.isupper() for c in part)
    if not upper:
        return price
    usual = upper == len(part) or (upper == 1 and part[0].isupper())
    return price + (0.31 if usual else 0.31 * min(upper, len(part) - upper) + 0.31)


def repeat_cost(block: str, times: int) -> float:
    return sum(map(_char_cost, block)) + math.log10(times)


def walk_cost(length: int) -> float:
    """A start among all keys, and one of eight ways at half of the steps."""
    return math.log10(len(_neighbours())) + 0.5 * math.log10(8) * (length - 1)


def guess_cost(value: str, vocabulary: str | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses for ``value``: the least over all its segmentations, each segment's cost added.

    A segment is one character, a word, a date, a block of up to ``LONGEST_BLOCK`` characters two or more times over
    (of one or two characters, three times), or a walk over three neighbouring keys or more; the last two have ``LONGEST_SEGMENT``
    characters at most. Segments cost nothing less than zero, so once all places that a segment can reach back to
    cost ``enough``, the rest cannot be cheaper; the least of them is then returned.
    """
    words = _words(vocabulary or default_words())
    near = _neighbours()
    low = value.lower()
    n = len(value)
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, price in _DATES:
        for m in pattern.finditer(value):
            dates.setdefault(m.end(1), []).append((m.start(1), price))
    best = [0.0] + [math.inf] * n
    same = [0] * (LONGEST_BLOCK + 1)  # for each size of block, how many characters up to here equal those a block before
    walk = 1
    for i in range(1, n + 1):
        ch = low[i - 1]
        cost = best[i - 1] + _char_cost(ch)
        for size in range(1, LONGEST_BLOCK + 1):
            same[size] = same[size] + 1 if i > size and low[i - 1 - size] == ch else 0
            least = 3 if size < 3 else 2
            for times in range(least, min(same[size] + size, LONGEST_SEGMENT) // size + 1):
                cost = min(cost, best[i - times * size] + repeat_cost(low[i - size : i], times))
        walk = walk + 1 if i > 1 and ch in near.get(low[i - 2], "") else 1
        for length in range(3, min(walk, LONGEST_SEGMENT) + 1):
            cost = min(cost, best[i - length] + walk_cost(length))
        for j, price in dates.get(i, ()):
            cost = min(cost, best[j] + price)
        for j in range(max(0, i - LONGEST_WORD), i - 2):
            if low[j:i] in words:
                cost = min(cost, best[j] + word_cost(value[j:i], words))
        best[i] = cost
        if i >= LONGEST_SEGMENT and cost >= enough and (floor := min(best[i + 1 - LONGEST_SEGMENT : i + 1])) >= enough:
            return floor
    return best[n]


def scan(text: str, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of one text, in code points, by start and then kind as listed in ``KINDS``."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8").translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    if any(w in low for w in _CONTEXT_WORDS):
        base = sorted(found)
        for m in _CONTEXT.finditer(text):
            start, end = m.span(1)
            if not any(s <= start and end <= e for s, e, _ in base) and guess_cost(m.group(1), vocabulary, MIN_GUESSES_LOG10) >= MIN_GUESSES_LOG10:
                found.append((start, end, "guess"))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, secrets`` for every row of ``docs``; ``secrets`` is an array of ``kind, start, end, value``.

    A null text counts as empty; a text without secrets has an empty array. Repeated rows each give one, a null ``doc_id``
    is kept, and an empty table gives an empty result. Texts are scanned whole, whatever their length.
    """
    vocabulary = vocabulary or default_words()

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,value:string>>")
    def secrets_of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, e, k in scan(t, vocabulary)] for t in texts])

    return docs.select("doc_id", secrets_of(text_of()).alias("secrets"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of the result of ``scan_documents``."""

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans")
    )


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if end > at:
            out += [text[at : max(at, start)], mark if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])
