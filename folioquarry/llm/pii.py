"""Operator 3: personal data by base rules and a conditional random field over word shapes.

The field labels every word of every text.  Words that are outside on every best path, whatever stands beside them,
cut a text into short runs that are decoded exactly.  The field is trained from the labelled table that ``labelled_words``
makes by rule, and adds spans beside the base ones: telephone numbers without a plus, cards with dots, addresses of
hosts that are written with brackets or as version 6, mail without a dotted host, names and street addresses.

Defined results: null and empty texts have no spans; of overlapping matches of one kind the leftmost holds;
an added span never overlaps another span; repeated rows give repeated results; an empty table gives no rows;
kept columns whose names clash with a result's are left out.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioquarry.llm.common import Words, char_starts, over_texts, word_hashes
from folioquarry.llm.crf import Crf, train, viterbi

#: Kinds of the base rules, and all that the field knows.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "address")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The lookbehind only spares starts within a number, from which no leftmost match can begin.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Hash slots for word features.
SLOTS = 4096
LABELS = 1 + 2 * len(KINDS)  # outside, then the first and the further words of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: from each at sign back over the local part, no further than the last match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            floor = m.end()
            out.append((a, floor))
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind, by kind as listed, then start."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 38 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class _Shapes(dict):
    """Table for str.translate that learns a character when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


_SHAPES = _Shapes()


def shape(word: str) -> str:
    """Digits as 9, letters as A or a, the rest as it is."""
    return word.translate(_SHAPES)


def _squeeze(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", text)


#: Words after which a name may follow, and words that close a street's name.
CUES = "Mr Mrs Ms Miss Dr Prof Sir Madam Herr Frau Dear Signed Name name Author Contact contact Patient named called".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Ct Place Square Terrace Way".split()
_EDGES = "\"'.,;:!?#*$%&|<>[]{}"


def _plain(word: str) -> str:
    return _squeeze(shape(word)) if any(c.isdigit() for c in word) else re.sub("[^a-z@+]", "", word.lower())


def own_features(word: str) -> tuple[int, ...]:
    """Numbers of what a word tells of itself."""
    core = word.strip(_EDGES)
    s, digits = shape(core), re.sub("[^0-9]", "", core)
    names = [
        "bias",
        f"shape {s}",
        f"short {_squeeze(s)}",
        f"digits {min(len(digits), 20)}",
        f"luhn {len(digits) >= 13 and luhn(digits)}",
        f"first {s[:2]}",
        f"separators {sorted({c for c in s if not c.isalnum()})}",
        f"groups {[len(g) for g in re.findall('9+', s)]}",
        f"letters {bool(re.search('[Aa]', s))}",
        f"ends {word[len(word.rstrip(_EDGES)) :][:1]}",
        f"street {core in STREETS}",
    ]
    return tuple(zlib.crc32(n.encode()) % SLOTS for n in names)


def before_features(word: str) -> list[int]:
    """Numbers of what a word, or an empty one where the text begins, tells of the next."""
    core = word.strip(_EDGES)
    return [zlib.crc32(n.encode()) % SLOTS for n in (f"before {_plain(word)}", f"cue {core in CUES} {shape(core)[:1]}")]


def after_features(word: str) -> list[int]:
    """Numbers of what a word, or an empty one where the text ends, tells of the one before it."""
    core = word.strip(_EDGES)
    return [zlib.crc32(n.encode()) % SLOTS for n in (f"after {_plain(word)}", f"next {_squeeze(shape(core))[:3]} {core in STREETS}")]


def features(word: str, before: str, after: str) -> list[int]:
    """Numbers of a word's features; words before and after may be empty."""
    return [*own_features(word), *before_features(before), *after_features(after)]


def labelled_words(seed: int = 11, n: int = 900) -> list[tuple[list[str], list[int]]]:
    """Runs of words with a digit or at sign between plain words, with labels, made by rule: personal data and what resembles it."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    plain = lambda: "".join(rng.choice(list("aeioutnrsl"), rng.integers(2, 9)))

    def card() -> str:
        body = str(rng.choice(["4", "51", "37", "6011"])) + d(11)
        body = body[:15].ljust(15, "7")
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    def bad() -> str:
        body = str(rng.integers(1, 9)) + d(14)
        return next(body + str(k) for k in range(10) if not luhn(body + str(k)))

    area = lambda: f"{rng.integers(2, 9)}{d(2)}"
    split = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, 16, 4))
    capital = lambda: plain().capitalize()
    street = lambda: f"{rng.integers(1, 999)} {capital()} {rng.choice(STREETS)}"
    yes = {
        "name": [lambda: f"{capital()} {capital()}", lambda: f"{capital()} {capital()}", lambda: capital(), lambda: f"{capital()} {capital()[0]}. {capital()}"],
        "address": [street, lambda: f"{rng.integers(1, 999)} {capital()} {capital()} {rng.choice(STREETS)}", lambda: f"{street()}, Apt {rng.integers(1, 99)}", lambda: f"{rng.integers(1, 99)}{rng.choice(list('abAB'))} {capital()} {rng.choice(STREETS)}"],
        "phone": [lambda: f"({area()}) {area()}-{d(4)}", lambda: f"{area()}-{area()}-{d(4)}", lambda: f"{area()}.{area()}.{d(4)}", lambda: f"+{rng.integers(1, 9)} ({area()}) {area()}-{d(4)}", lambda: f"({area()}){area()}-{d(4)}"],
        "email": [lambda: f"{plain()}.{d(2)}@{plain()}.org", lambda: f"{plain()}@{plain()}.{plain()[:3]}", lambda: f"{plain()}{d(1)}@localhost", lambda: f"{plain()}_{d(1)}@mail{d(1)}.{plain()}.com"],
        "ip": [lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)), lambda: "[.]".join(str(rng.integers(1, 256)) for _ in range(4)), lambda: ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8)), lambda: f"fe80::{rng.integers(1, 65536):x}:{rng.integers(4096, 65536):x}"],
        "card": [lambda: card(), lambda: split(card(), "-"), lambda: split(card(), " "), lambda: split(card(), ".")],
    }
    ends = ["", "", "", ".", ",", "###", "%%%", "$$$", "***", "&&&", ")", "!!"]

    def heading() -> str:
        case, end = rng.choice(["capital", "upper", "mixed"]), str(rng.choice(ends))
        return " ".join((w.upper() if case == "upper" else w.capitalize() if case == "capital" or rng.random() < 0.5 else w) + (end if rng.random() < 0.7 else "") for w in (plain()[: rng.integers(1, 9)] for _ in range(rng.integers(1, 8))))

    no = [
        lambda: str(rng.integers(1900, 2100)), lambda: f"{rng.integers(1, 99)}.{d(2)}", lambda: f"{rng.integers(0, 9)}.{rng.integers(0, 9)}.", lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 30)}",
        lambda: f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", lambda: f"{rng.integers(10, 23)}:{rng.integers(10, 59)}", lambda: f"{rng.integers(1, 9)}-{rng.integers(10, 19)}", lambda: bad(), lambda: d(rng.integers(1, 13)),
        lambda: f"{plain()}{d(2)}", lambda: f'"{rng.bytes(20).hex()}"', lambda: f"password={rng.bytes(9).hex()}", lambda: f"AKIA{plain().upper()}{d(3)}Z", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"@{plain()}", lambda: f"{area()}-{d(2)}-{d(2)}-{d(2)}-{d(3)}",
        lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{rng.choice(CUES)} {plain()} {plain()}", lambda: f"{rng.choice(CUES)}. {capital()} {plain()} {plain()}.", lambda: f"{rng.integers(1, 99)} {capital()} {plain()}", lambda: f"{capital()} {rng.choice(STREETS)}", lambda: f"{rng.integers(1, 99)} {plain()} {rng.choice(STREETS)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{rng.integers(2, 30)}. {capital()} {plain()} {rng.choice(STREETS)}", lambda: f"{rng.bytes(20).hex()}", lambda: f"{plain()} {plain()} {rng.choice(STREETS)} {plain()}",
        lambda: f"{plain()}. {capital()} {plain()}", lambda: f"{capital()} {plain()} {plain()}", lambda: f"{capital()} {capital()} {plain()}", lambda: f"{plain()} {capital()}{rng.choice(list('.,;:'))} {plain()}", lambda: plain().upper(),
        lambda: f"{plain()}{rng.choice(list('.,;:!?'))} {rng.choice(CUES)} {plain()}", lambda: f"{capital()} {rng.choice(CUES)} {plain()}", heading, heading, heading, lambda: " ".join([capital() + str(rng.choice(ends))] * rng.integers(2, 9)),
    ]
    cues = {"name": CUES, "address": ["at", "lives", "to"], "phone": ["call", "tel", "phone"], "email": ["mail", "write"], "ip": ["host", "from"], "card": ["card", "pay"]}
    out = []
    for _ in range(n):
        words, labels = [plain(), plain()], [0, 0]
        for _ in range(rng.integers(1, 5)):
            if rng.random() < 0.5:
                kind = str(rng.choice(KINDS))
                if kind == "name" or rng.random() < 0.2:
                    words.append(str(rng.choice(cues[kind])) + (str(rng.choice(["", ".", ":"])) if kind == "name" else ""))
                    labels.append(0)
                parts = (str(yes[kind][rng.integers(len(yes[kind]))]()) + str(rng.choice(ends))).split()
                at = 1 + 2 * KINDS.index(kind)
                labels += [at, *[at + 1] * (len(parts) - 1)]
                words += parts
            else:
                made = (str(no[rng.integers(len(no))]()) + str(rng.choice(ends))).split()
                words += made
                labels += [0] * len(made)
            if rng.random() < 0.65:
                between = [str(rng.choice(["", "", "", ".", ","])).join([plain(), ""])] if rng.random() < 0.7 else [plain() + ".", capital()]
                words += between
                labels += [0] * len(between)
        out.append(([*words, plain()], [*labels, 0]))
    return out


_CUE, _STREET = frozenset(CUES), frozenset(STREETS)


def candidates(words: list[str]) -> list[bool]:
    """Which words of a text the field labels: all."""
    return [True] * len(words)


def _candidate_words(w: Words) -> np.ndarray:
    """Numbers of the words of a batch that the field labels: all."""
    return np.arange(len(w.start))


def fit(examples: list[tuple[list[str], list[int]]]) -> Crf:
    """Learns from all words of the examples."""
    runs = [np.array([features(x, y, z) for x, y, z in zip(w, ["", *w], [*w[1:], ""], strict=False)]) for w, _ in examples]
    return train(runs, [np.array(y) for _, y in examples], SLOTS, LABELS, rounds=60)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return fit(labelled_words())


@lru_cache(maxsize=50_000)
def _of_shape(s: str) -> tuple[tuple[int, ...], int, int]:
    """What all words of a shape share that hold no digit and are no cue or street's word: their own features, and what they tell of the next and of the one before."""
    return own_features(s), before_features(s)[1], after_features(s)[1]


_NO_LETTER = re.compile("[^a-z@+]")


def _told(word: str) -> tuple[tuple[int, ...], int, int, int, int]:
    """own_features(), before_features() and after_features() of a word, with less work for words without digits."""
    core = word.strip(_EDGES)
    if len(word) < 64 and core not in _CUE and core not in _STREET and not any(map(str.isdigit, word)):
        own, cue, after = _of_shape(shape(word))
        data = _NO_LETTER.sub("", word.lower()).encode()
        return own, zlib.crc32(b"before " + data) % SLOTS, cue, zlib.crc32(b"after " + data) % SLOTS, after
    return own_features(word), *before_features(word), *after_features(word)


def emissions(model: Crf, w: Words) -> np.ndarray:
    """Scores of each label for every word: the sum of what it, the word before and the word after tell; each distinct word is looked at once."""
    _, once, same = np.unique(word_hashes(w), return_index=True, return_inverse=True)
    told = [_told(w.joined[a:b].decode()) for a, b in zip(w.start[once].tolist(), w.end[once].tolist(), strict=True)]
    weights = model.weights
    alike: dict[tuple, int] = {}  # most words share their own features with others
    kinds = np.array([alike.setdefault(t[0], len(alike)) for t in told])
    own = model.emissions(np.array(list(alike)))[kinds]
    pairs = np.array([t[1:] for t in told])
    before, after = weights[pairs[:, 0]] + weights[pairs[:, 1]], weights[pairs[:, 2]] + weights[pairs[:, 3]]
    out = own[same]
    new = np.diff(w.doc, prepend=-1) != 0
    prior = before[np.concatenate([[0], same[:-1]])]
    prior[new] = weights[before_features("")].sum(0)
    later = after[np.concatenate([same[1:], [0]])]
    later[np.append(new[1:], True)] = weights[after_features("")].sum(0)
    return out + prior + later


def outside(model: Crf, scores: np.ndarray) -> np.ndarray:
    """Words that are outside on every best path: no label's gain by its neighbours makes up for its score, whatever they are."""
    t, f = model.step, model.first
    into = np.vstack([t, f])  # from each label, or from the text's begin
    out = np.hstack([t, np.zeros((len(t), 1))])  # to each label, or to the text's end
    gain = (into - into[:, :1]).max(0) + (out - out[:1]).max(1)
    return (scores[:, 1:] + gain[1:] < scores[:, :1] - 1e-6).all(1)


def decode(model: Crf, w: Words) -> np.ndarray:
    """The best labels of every word of every text.

    Texts are cut at words that are outside on every best path, which leaves the paths as they are: what stands
    between two such words is decoded with them.
    """
    scores = emissions(model, w)
    sure = outside(model, scores)
    labels = np.zeros(len(scores), np.int8)
    new = np.diff(w.doc, prepend=-1) != 0
    end = np.append(new[1:], True)
    open_ = ~sure
    use = open_ | (np.append(open_[1:], False) & ~end) | (np.concatenate([[False], open_[:-1]]) & ~new)
    at = np.flatnonzero(use)
    if len(at):
        scores = scores[at]
        scores[sure[at], 1:] = -np.inf
        apart = (np.diff(at) != 1) | new[at[1:]]
        labels[at] = viterbi(model, scores, np.concatenate([[0], np.flatnonzero(apart) + 1, [len(at)]]))
    return labels


def find(model: Crf, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text in code points; every word of every text is labelled."""
    w = Words(texts)
    data = w.data
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    if not len(w.start):
        return out
    marks = np.unique(w.doc[w.total(((data >= 48) & (data <= 57)) | (data == 64)) > 0])  # all base spans hold a digit or an at sign
    for doc in marks.tolist():
        out[doc] = (base_spans(texts[doc]), [])
    labels = decode(model, w)
    number = np.cumsum(char_starts(data))  # code points up to and with a byte
    stop = 0
    for k in np.flatnonzero(labels).tolist():
        if k < stop:
            continue
        kind, doc, stop = KINDS[(int(labels[k]) - 1) // 2], int(w.doc[k]), k + 1
        while stop < len(labels) and labels[stop] == 2 + 2 * KINDS.index(kind) and w.doc[stop] == doc:
            stop += 1
        zero = int(number[w.first[doc]]) - 1
        a = int(number[w.start[k]]) - 1 - zero
        b = int(number[w.end[stop - 1] - 1]) - zero
        text = texts[doc]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if valid(kind, text[a:b]) and not any(x < b and a < z for x, z, _ in out[doc][0] + out[doc][1]):
            out[doc][1].append((a, b, kind))
    return out


def valid(kind: str, text: str) -> bool:
    """What a span that the field adds has to have in any case."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(text.replace("[.]", ".").strip("[]")))
        except ValueError:
            return False
    if kind == "card":
        return 13 <= digits <= 19 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])*", text) is not None and luhn(re.sub("[^0-9]", "", text))
    if kind == "phone":
        return 9 <= digits <= 15 and len(text) <= 2 * digits
    if kind == "name":
        return digits == 0 and text[:1].isupper()
    if kind == "address":
        return digits > 0 and any(x.strip(_EDGES) in _STREET for x in text.split())
    return "@" in text[1:-1]


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0])))


FIELDS = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: Crf | None = None) -> DataFrame:
    """Kept columns, base counts by kind, the base spans' digest, all spans, how many the field added, and how many there are."""
    model = model or default_model()

    def kernel(texts: list[str | None]) -> list[list]:
        found = find(model, texts)
        return [*[[sum(s[2] == k for s in a) for a, _ in found] for k in BASE], [hashlib.sha256(_line(a).encode()).hexdigest() for a, _ in found], [_line(a + b) for a, b in found], [len(b) for _, b in found], [len(a) + len(b) for a, b in found]]

    return over_texts(df, text_col, kernel, FIELDS, df.columns if keep is None else keep)
