"""Operator 1: quality rules by line labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate (Viterbi); the
share of words in content lines decides retention, after fixed base rules.  The field is trained from the
labelled line table that ``labelled_lines`` makes by rule, so it behaves alike for every input.

Defined results: null and empty texts have no words and fail the base rules; a text without content lines has
share 0; repeated rows give repeated results; an empty table gives no rows; kept columns whose names clash with
a result's are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import SPACE, Words, char_starts, over_texts, unused
from folioquarry.llm.crf import Crf, train, viterbi

#: Least share of words in content lines, and the base rules' limits.
CONTENT_SHARE, LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 0.5, 20, 0.30, 8
BOILERPLATE, CONTENT = 0, 1

_KINDS = {k: np.zeros(256, bool) for k in ("symbol", "upper", "lower", "digit", "bar", "shout", "stop", "high")}
_KINDS["symbol"][list(b"#*$%&|<>")] = True
_KINDS["upper"][list(range(65, 91))] = True
_KINDS["lower"][list(range(97, 123))] = True
_KINDS["high"][128:] = True
_KINDS["digit"][list(range(48, 58))] = True
_KINDS["bar"][list(b"|>")] = True
_KINDS["shout"][list(b"!")] = True
_KINDS["stop"][list(b".!?:;")] = True

#: Name, and the steps at which each measure of a line goes to its next feature.
STEPS = [
    ("words", (2, 4, 8, 16)),
    ("symbols a word", (0.001, 0.1, 0.4, 0.9)),
    ("upper-case share of letters", (0.02, 0.15, 0.3, 0.6)),
    ("digit share", (0.001, 0.1, 0.3)),
    ("lone bars a word", (0.001, 0.08, 0.25)),
    ("exclamation marks a word", (0.001, 0.15, 0.5)),
    ("equal neighbours", (0.001, 0.05, 0.2, 0.5)),
    ("ends a sentence", (0.5,)),
    ("equal to an earlier line", (0.5,)),
    ("mean word length", (2, 4, 9, 14)),
]
OFFSETS = np.cumsum([0, *[len(s) + 1 for _, s in STEPS]])


class Lines:
    """Measures of the lines with a word of a few texts, and their features."""

    def __init__(self, texts: list[str | None]):
        w = self.words = Words(texts)
        data = w.data
        breaks = np.flatnonzero(data == 10)  # also the breaks between texts
        line = np.searchsorted(breaks, w.start)
        self.ids = _word_ids(w)
        new = np.flatnonzero(np.diff(line, prepend=-1))
        self.first_word = new
        self.count = np.diff(np.append(new, len(line)))
        self.doc = w.doc[new]
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        per_line = lambda per_word: np.add.reduceat(per_word, new) if len(new) else np.zeros(0)
        size = per_line(w.end - w.start)
        total = {k: per_line(w.total(m[data])) for k, m in _KINDS.items()}
        equal = np.zeros(len(line), np.int64)
        if len(line) > 1:
            equal[1:] = (self.ids[1:] == self.ids[:-1]) & (line[1:] == line[:-1])
        last = np.append(new[1:], len(line))[: len(new)] - 1
        begin = np.concatenate([[0], breaks + 1])[line[new]] if len(new) else np.zeros(0, np.int64)
        stop = breaks[line[new]] if len(new) else np.zeros(0, np.int64)
        self.repeated = _seen_before(w.joined, begin, stop, self.doc)
        letters = np.maximum(total["upper"] + total["lower"] + total["high"], 1)
        n = np.maximum(self.count, 1)
        lone = per_line(((w.end - w.start) <= 2) & (w.total(_KINDS["bar"][data]) > 0))
        ends = _KINDS["stop"][data[w.end[last] - 1]] if len(new) else np.zeros(0)
        measures = [self.count, total["symbol"] / n, total["upper"] / letters, total["digit"] / np.maximum(size, 1), lone / n, total["shout"] / n, per_line(equal) / n, ends, self.repeated, size / n]
        self.active = np.stack([OFFSETS[k] + np.searchsorted(s, np.asarray(m, float), side="right") for k, ((_, s), m) in enumerate(zip(STEPS, measures, strict=True))], 1) if len(new) else np.zeros((0, len(STEPS)), np.int64)


def _word_ids(w: Words) -> np.ndarray:
    """Numbers of words: equal within a batch if and only if the words are."""
    known: dict[bytes, int] = {}
    put = known.setdefault
    return np.fromiter((put(x, len(known)) for x in w.joined.split()), np.int64, len(w.start))


def _seen_before(joined: bytes, begin: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out, seen, now = np.zeros(len(begin), bool), set(), -1
    for i, (a, b, d) in enumerate(zip(begin.tolist(), stop.tolist(), doc.tolist(), strict=True)):
        if d != now:
            seen, now = set(), d
        line = joined[a:b]
        if line in seen:
            out[i] = True
        else:
            seen.add(line)
    return out


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words in k-word windows that it holds twice or more.

    A hash names the windows that may be repeated; those alone are then compared word by word.
    """
    out = np.zeros(n_docs, np.int64)
    if len(ids) < k:
        return out
    mix = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    size = len(ids) - k + 1
    with np.errstate(over="ignore"):
        h = doc[:size].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(k):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + mix[j : j + size]
    at = np.flatnonzero(doc[:size] == doc[k - 1 :])
    h = h[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return out
    likely = np.zeros(len(h), bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    at = at[likely]  # windows that may be repeated; now exactly
    windows = np.stack([doc[at], *[ids[at + j] for j in range(k)]], 1)
    _, which, n = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[n[which.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def labelled_lines(seed: int = 7, n_texts: int = 240) -> list[tuple[list[str], list[int]]]:
    """Texts as lines with their labels, made by rule from random syllables: prose, menus, notices, tables, shouting, symbol noise, loops."""
    rng = np.random.default_rng(seed)
    parts = ["ka", "ro", "mi", "tel", "sun", "ver", "do", "é", "lan", "ß", "qui", "o", "na", "the", "ing", "ón"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    words = lambda n: [word() for _ in range(n)]
    symbols = ["%%%", "***", "###", "$$$", "&&&", "##", "|||"]

    def prose() -> str:
        out = []
        for _ in range(rng.integers(1, 7)):
            s = words(rng.integers(1, 22))
            s[0] = s[0].capitalize()
            if rng.random() < 0.3:
                s.insert(rng.integers(len(s)), str(rng.choice(["12", "+1 (555) 123-4567", "a.b@c.d.org", "10.2.3.4", "4539578763621486", 'key = "0a1b2c"'])))
            out.append(" ".join(s) + str(rng.choice([".", ".", ".", "?", ","])))
        return " ".join(out)

    loop = lambda: " ".join(x for x in prose().split()[: rng.integers(1, 9)] for _ in range(rng.integers(4, 30)))
    noise = {  # half of the kinds are spoilt prose, so sentence ends and lengths alone tell little
        "symbols": lambda: " ".join(x + str(rng.choice(symbols)) for x in prose().split()),
        "shout": lambda: " ".join(x.upper() + str(rng.choice(["!!", "!!!", "!"])) for x in prose().split()),
        "table": lambda: " | ".join(prose().split()) + str(rng.choice(["", " |"])),
        "loop": loop,
        "menu": lambda: " > ".join(words(rng.integers(3, 9))),
        "tags": lambda: " ".join("#" + x for x in words(rng.integers(3, 12))),
        "numbers": lambda: " ".join(str(rng.integers(10, 9999)) for _ in range(rng.integers(4, 20))) + str(rng.choice(["", "."])),
    }
    out = []
    for i in range(n_texts):
        lines, labels = [], []
        bad = list(noise)[i % len(noise)] if i % 2 else None
        for _ in range(rng.integers(1, 12)):
            if bad and rng.random() < 0.85:
                lines.append(noise[bad]())
                labels.append(BOILERPLATE)
            else:
                lines.append(prose())
                labels.append(CONTENT)
                if rng.random() < 0.05:  # a line that stands twice
                    lines.append(lines[-1])
                    labels.append(BOILERPLATE)
        out.append((lines, labels))
    return out


def fit(examples: list[tuple[list[str], list[int]]]) -> Crf:
    lines = Lines(["\n".join(x) for x, _ in examples])
    cut = [lines.active[a:b] for a, b in zip(lines.bounds, lines.bounds[1:], strict=False)]
    return train(cut, [np.array(y) for _, y in examples], int(OFFSETS[-1]), 2)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return fit(labelled_lines())


def judge(model: Crf, texts: list[str | None]) -> dict[str, list]:
    """All results of whole texts, by column."""
    lines, n = Lines(texts), len(texts)
    w = lines.words
    n_words = np.bincount(w.doc, minlength=n)
    word_chars = np.bincount(w.doc, weights=w.total(char_starts(w.data)), minlength=n).astype(np.int64)
    n_symbols = np.bincount(w.doc, weights=w.total(_KINDS["symbol"][w.data]), minlength=n).astype(np.int64)
    n_dup = np.bincount(lines.doc, weights=lines.repeated, minlength=n).astype(np.int64)
    n_repeat = repeated_words(lines.ids, w.doc, n)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 100 * MOST_REPEATED * n_words)
    labels = viterbi(model, model.emissions(lines.active), lines.bounds)
    content = np.bincount(lines.doc, weights=lines.count * (labels == CONTENT), minlength=n)
    share = content / np.maximum(n_words, 1)
    return {
        "n_words": n_words.tolist(),
        "word_chars": word_chars.tolist(),
        "n_symbols": n_symbols.tolist(),
        "n_dup_lines": n_dup.tolist(),
        "n_repeat_words": n_repeat.tolist(),
        "base_failed": failed.tolist(),
        "kept": (~failed & (share >= CONTENT_SHARE)).tolist(),
        "content_share": share.tolist(),
    }


FIELDS = T.StructType([*[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])


def score(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: Crf | None = None) -> DataFrame:
    """Kept columns and all results for each row."""
    model = model or default_model()
    return over_texts(df, text_col, lambda texts: list(judge(model, texts).values()), FIELDS, df.columns if keep is None else keep)


def retain(df: DataFrame, text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """The rows, with their own columns alone, that the rules keep."""
    model = model or default_model()
    name = unused(df, "kept")
    verdict = T.StructType([T.StructField(name, T.BooleanType())])
    out = over_texts(df, text_col, lambda texts: [judge(model, texts)["kept"]], verdict, df.columns)
    return out.filter(F.col(f"`{name}`")).select(*[F.col(f"`{c}`") for c in df.columns])
