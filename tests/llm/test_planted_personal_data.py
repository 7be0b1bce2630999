"""Personal data as people write it, planted among words that the field was not trained on, and what only looks like it."""

import random

import numpy as np
import pytest

from folioquarry.llm import pii
from folioquarry.llm.common import Words

rng = random.Random(31)
d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
FIRST, LAST = "Anna Boris Clara David Elena Farid Grace Henrik Ines Jonas".split(), "Smith Okafor Rivera Novak Tanaka Lindqvist Dubois Khan Weber Costa".split()
PROSE = "the report was late and nobody could say why it had been sent to the wrong office before the meeting on monday".split()


def card(sep):
    body = rng.choice(["4", "5"]) + d(14)
    digits = next(body + str(k) for k in range(10) if pii.luhn(body + str(k)))
    return sep.join(digits[i : i + 4] for i in range(0, 16, 4))


PLANTED = {
    "phone": lambda: rng.choice([f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{d(4)}", f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{d(4)}", f"{rng.randint(200, 999)}.{rng.randint(200, 999)}.{d(4)}"]),
    "card": lambda: card("."),
    "ip": lambda: rng.choice(["[.]".join(str(rng.randint(1, 255)) for _ in range(4)), f"fe80::{rng.randint(1, 65535):x}:{rng.randint(4096, 65535):x}"]),
    "name": lambda: f"{rng.choice(['Mr.', 'Ms.', 'Dr.', 'Mrs.'])} {rng.choice(FIRST)} {rng.choice(LAST)}",
    "address": lambda: f"{rng.randint(1, 900)} {rng.choice(LAST)} {rng.choice(['Street', 'Avenue', 'Road', 'Lane', 'St.'])}",
}
HARMLESS = [
    "faf2116c45395d7876362f1486aa45395787", "version 1.2.3 of 2024-01-31", "page 12 of 300", "the Street was empty", "in 1999 Smith went home", "see Main Street and Baker Street", "it costs 1,234,567.89 or $12.50", "at 10:30:15 sharp",
    "ISBN 978-3-16-148410-0", "order 1234567890", "7 of 9", "Dr. said so", "called it a day", "the name of the game", "3 of 4 Roads", "50% of 120", "room 12b, 2nd floor",
]


def around(x):
    words = rng.choices(PROSE, k=rng.randint(4, 14))
    at = rng.randint(1, len(words) - 1)
    return " ".join([*words[:at], x, *words[at:]])


@pytest.mark.parametrize("kind", list(PLANTED))
def test_planted_spans_are_added(kind):
    made = [PLANTED[kind]() for _ in range(150)]
    texts = [around(x) for x in made]
    hits = 0
    for text, x, (_, added) in zip(texts, made, pii.find(pii.default_model(), texts), strict=True):
        core = x.split(" ", 1)[1] if kind == "name" else x
        hits += any(k == kind and text[a:b].strip("().") in core.strip(".") + x and b - a >= len(core) - 3 for a, b, k in added)
    assert hits / len(made) >= 0.9


def test_harmless_words_stay():
    texts = [around(x) for x in HARMLESS for _ in range(6)]
    found = [(t[a:b], k) for t, (base, added) in zip(texts, pii.find(pii.default_model(), texts), strict=True) for a, b, k in base + added]
    assert found == []


def test_base_spans_stay_and_spans_do_not_overlap():
    text = "Dr. Anna Smith of 12 Baker Street, mail a@b.org, 10.0.0.1, 4539578763621486, +1 (555) 123-4567, (555) 123-4567"
    ((base, added),) = pii.find(pii.default_model(), [text])
    assert [(text[a:b], k) for a, b, k in base] == [("a@b.org", "email"), ("10.0.0.1", "ip"), ("4539578763621486", "card"), ("+1 (555) 123-4567", "phone")]
    assert {(text[a:b], k) for a, b, k in added} == {("Anna Smith", "name"), ("12 Baker Street", "address"), ("(555) 123-4567", "phone")}
    spans = sorted(base + added)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_candidates_of_a_batch_are_those_of_each_text():
    words = ["Mr.", "Dr", "Anna", "Smith", "12", "Baker", "Street", "St.", "went", "a@b", "Apt", "home,", "Road", "(Dear", "to"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)]
    want = [i for t in texts for i in pii.candidates(t.split())]
    w = Words(texts)
    got = np.zeros(len(w.start), bool)
    got[pii._candidate_words(w)] = True
    assert got.tolist() == want


def test_long_words_are_read_to_their_ends():
    long = "x" * 90 + "1"
    assert pii.features(long + "a", "", "") != pii.features(long + "-", "", "")
    ((base, added),) = pii.find(pii.default_model(), ["9" * 100_000 + " " + "é" * 5000 + "1"])
    assert base == added == []
