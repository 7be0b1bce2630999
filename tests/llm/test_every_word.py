"""The field of op3 labels every word of every text, also where no digit and no listed form of a cue stands near."""

import random

import numpy as np

from folioquarry.llm import pii
from folioquarry.llm.common import Words
from folioquarry.llm.crf import viterbi

WORDS = "Mr. Dr Anna Smith 12 Baker Street St. went a@b Apt home, Road (Dear to report late The Éva x² 10.0.0.1 Weber".split()


def test_spans_where_few_words_were_looked_at():
    texts = ["he lives at 12 Maple Road? yes", "she wrote to 9 Oak Street! today", "then *Dr.* Anna Bell came in", "it was Dr. Anna B. Smith who said so"]
    found = [[t[a:b] for a, b, _ in added] for t, (_, added) in zip(texts, pii.find(pii.default_model(), texts), strict=True)]
    assert found == [["12 Maple Road"], ["9 Oak Street"], ["Anna Bell"], ["Anna B. Smith"]]


def test_cut_texts_decode_as_whole_ones():
    rng, model = random.Random(7), pii.default_model()
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 80))) for _ in range(200)]
    active = [pii.features(x, y, z) for t in texts for w in [t.split()] for x, y, z in zip(w, ["", *w], [*w[1:], ""], strict=False)]
    whole = viterbi(model, model.emissions(np.array(active)), np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])]))
    w = Words(texts)
    assert pii.outside(model, pii.emissions(model, w)).any() and whole.any()
    assert pii.decode(model, w).tolist() == whole.tolist()


def test_what_a_word_tells():
    for word in ["name:", "St!", "Hello,", "x²", "İst", "ß", "AB1", "...", "'Tis", "naïve", *WORDS]:
        assert pii._told(word) == (pii.own_features(word), *pii.before_features(word), *pii.after_features(word))
