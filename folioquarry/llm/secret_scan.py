"""Operator 9: secret scan.

Base rules find assigned secrets, access keys and long hexadecimal strings.  The method adds candidate strings
(maximal runs of key characters, dots within them as in signed tokens) in which a sliding window reaches the Shannon
entropy of its character class; counts change by one character in and one out a step.  An allow-list suppresses known
harmless forms: identifiers, digits alone, words, paths and file names, versions, hosts.

Defined results: null and empty texts have no spans; of overlapping spans of one kind the leftmost holds, and an
added span never overlaps a base one; repeated rows give repeated results; an empty table gives no rows; kept
columns whose names clash with a result's are left out.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import Words, over_texts, unused

KINDS = ("assign", "access", "hex", "entropy")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of a candidate at least, and of the window; shorter candidates are one window, their limit being scaled.
LEAST, WINDOW = 16, 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
#: The entropy in bits a character that a window must reach, by class of the candidate's characters.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("alphanumeric", re.compile(r"[0-9A-Za-z]+"), 3.6), ("base64", re.compile(r"[A-Za-z0-9+/_=~.-]+"), 3.8))
#: Forms that are no secrets.
_NAME = r"[A-Za-z]{1,14}[0-9]{0,4}|[0-9]{1,5}[A-Za-z]{0,2}"
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # identifiers
    re.compile(r"[0-9+/_=.~-]+"),  # numbers, dates, addresses
    re.compile(rf"[/._=~-]*(({_NAME})[/._=~-]+)*({_NAME})[/._=~-]*"),  # words, paths, versions, hosts
)
#: Upper-case share of letters, and the longest lower-case run, of a key without digits.
_MIXED, _LONGEST = (0.25, 0.75), re.compile(r"[a-z]{6,}")


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy of any window, by incremental counts: n log n sums change at two characters a step."""
    counts: dict[str, int] = {}
    cost = [0.0, *[n * math.log2(n) for n in range(1, window + 1)]]
    total, best = 0.0, 0.0
    for i, c in enumerate(text):
        if i >= window:
            n = counts[old := text[i - window]]
            counts[old] = n - 1
            total += cost[n - 1] - cost[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if i >= window - 1:
            best = max(best, math.log2(window) - total / window)
    return best


def _jumbled(text: str) -> bool:
    """Whether letters without a digit are mixed as no name mixes them."""
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and _MIXED[0] <= sum(c.isupper() for c in letters) / len(letters) <= _MIXED[1] and not _LONGEST.search(text)


def high_entropy(text: str) -> bool:
    """Whether a candidate is of mixed characters, not allowed, and has a window with its class's entropy."""
    if len(text) < LEAST or any(a.fullmatch(text) for a in ALLOWED) or not any(c.isdigit() for c in text) and not _jumbled(text):
        return False
    window = min(len(text), WINDOW)
    scale = math.log2(window) / math.log2(WINDOW)
    return next(window_entropy(text, window) >= least * scale for _, form, least in CLASSES if form.fullmatch(text))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A candidate without the marks that open and close a sentence or a quotation."""
    while a < b and text[a] in ".=~-":
        a += 1
    while a < b and text[b - 1] in ".~-":
        b -= 1
    return a, b


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    """start, end, kind of the base rules' matches; failing matches are dropped without retries."""
    out, low = [], low if low is not None else text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def find(texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, as (start, end, kind).

    Long runs lie within long words, so the words' table tells which texts need the patterns for those.
    """
    w = Words(texts)
    long = np.bincount(w.doc[(w.end - w.start) >= LEAST], minlength=len(texts)) > 0
    hexes = np.bincount(w.doc[(w.end - w.start) >= 32], minlength=len(texts)) > 0
    out = []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        if hexes[i]:
            base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        added = []
        if long[i]:
            for m in _CANDIDATE.finditer(text):
                x, y = _trimmed(text, m.start(), m.end())
                if not any(a < y and x < b for a, b, _ in base) and high_entropy(text[x:y]):
                    added.append((x, y, "entropy"))
        out.append((base, added))
    return out


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


FIELDS = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_entropy", T.LongType())])


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, counts by kind, the base spans' digest and all spans of each row."""

    def kernel(texts: list[str | None]) -> list[list]:
        found = find(texts)
        count = lambda k: [sum(s[2] == k for s in a + b) for a, b in found]
        return [*[count(k) for k in KINDS[:3]], [hashlib.sha256(_line(a).encode()).hexdigest() for a, _ in found], [_line(a + b) for a, b in found], count("entropy")]

    return over_texts(df, text_col, kernel, FIELDS, df.columns if keep is None else keep)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with each span (overlapping ones as one) replaced by a mark; null texts stay null."""

    def clean(text: str | None, spans: list) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, b, _ in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def kernel(texts: list[str | None]) -> list[list]:
        return [[clean(t, a + b) for t, (a, b) in zip(texts, find(texts), strict=True)]]

    name = unused(df, "clean")
    out = over_texts(df, text_col, kernel, T.StructType([T.StructField(name, T.StringType())]), df.columns)
    return out.select(*[F.col(f"`{name}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
