"""Operators against plain versions of what they compute, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from folioquarry.llm import byte_bpe, crf, dart_minhash, html_tree, knn_quality, license_index, pii, quality_lines, secret_scan, winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_line_counts(texts):
    sample = [*texts.values(), "", "a b c d e f g h a b c d e f g h", "x\nx\n\n\ny\nx"]
    got = quality_lines.judge(quality_lines.default_model(), sample)
    for i, text in enumerate(sample):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines, seen, dup = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        hit = {k for j, w in enumerate(windows) if w in twice for k in range(j, j + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), dup, len(hit))
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_line_labels_held_out():
    model = quality_lines.default_model()
    made = quality_lines.labelled_lines(seed=1234, n_texts=80)
    lines = quality_lines.Lines(["\n".join(x) for x, _ in made])
    got = crf.viterbi(model, model.emissions(lines.active), lines.bounds)
    assert (got == np.concatenate([np.array(y) for _, y in made])).mean() > 0.97


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(0)
    model = crf.Crf(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = [0, 1, 4, 2, 5]
    e, first = rng.normal(size=(sum(sizes), 3)), np.concatenate([[0], np.cumsum(sizes)])
    got = crf.viterbi(model, e, first)
    for a, b in zip(first, first[1:], strict=False):
        score = lambda p: model.first[p[0]] + sum(e[a + i, x] for i, x in enumerate(p)) + sum(model.step[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=score)


def test_tokens_equal_the_other_library(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    odd = ["".join(rng.choice("aé漢😀 \n\t'sll1₂½  \x1c|<>") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for text in [*texts.values(), *odd, "<|endoftext|>"]:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids).decode() == text
        if len(text) < 100:
            spans = codec.offsets(text, ids)
            assert all(text[a:b].encode().find(codec.bytes_of[i]) >= 0 for (a, b), i in zip(spans, ids, strict=True))


def test_personal_data_base_and_added():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        out = []
        for k, p in kinds.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                    out.append((m.start(), m.end(), k))
        return out

    rng = random.Random(2)
    sample = ["".join(rng.choice("aB1.2@+-( )9%é") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["4539578763621486 x@y.org 10.1.2.3 +1 (555) 123-4567"]
    found = pii.find(pii.default_model(), sample)
    assert [a for a, _ in found] == [plain(t) for t in sample]
    assert len(found[-1][0]) == 4
    text = "please call (555) 123-4567 at noon on 2024-01-31 for 1,234,567 units"
    ((_, added),) = pii.find(pii.default_model(), [text])
    assert [(text[a:b], k) for a, b, k in added] == [("(555) 123-4567", "phone")]


def test_near_duplicate_classes(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    rows, base = [], [[word() for _ in range(120)] for _ in range(6)]
    for i in range(160):
        text = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(200, "a b c"), (201, "a b c"), (202, "a b d"), (203, ""), (204, ""), (205, None)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in rows if t is not None}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a and b and len(a & b) >= 0.8 * len(a | b) or not a and not b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in root}


def test_dart_signatures_estimate_weighted_similarity():
    n = 40
    weight = np.concatenate([np.full(n, 3.0), np.full(n, 1.0)])
    doc, element = np.repeat([0, 1], n), np.tile(np.arange(1, n + 1, dtype=np.uint64), 2)
    s = dart_minhash.signatures(doc, element, weight, 2, 2000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.05 and (s != 0).all()


def test_licences(spark):
    base = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    rows = [(1, "Released under the MIT License. under, the mit-license"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "the license of this place"), (4, "Licensed under CC BY-NC 4.0."), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"), (6, "kelvin K under the mıt license")]
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = sorted(j for p in base.values() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0] if at else None, at[-1] if at else None)
    assert [got[i].labels for i in range(1, 7)] == ["mit", "gpl-3", "", "cc-by-nc", "mit", ""]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination(spark, broadcast):
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 10, 14, 30])))) for i in range(25)] + [(90, ""), (91, None)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"x {t} y, {t}") for i, t in items if t] + [(7, docs[7][1])]
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast).collect())
    want = []
    for i, t in docs:
        w, hit, met = split(t), set(), set()
        for n, u in items:
            x = split(u)
            k = min(10, len(x))
            wins = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    met.add(str(n))
        want.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()))
    assert got == sorted(want)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in knn_quality.classify(docs, knn_quality.learn(docs, labels)).collect()}
    truth = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(r.predicted, y) for r, y in truth if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_secrets():
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    rng = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "=", ": ", '"', "deadbeef" * 4, "AKIA", "ABCDEFGH1234", "abc", " ", "é", "x9_", "\n"]
    sample = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for text, (base, added) in zip(sample, secret_scan.find(sample), strict=True):
        want = sorted(((m.start(), m.end(), k) for k, p in kinds.items() for m in p.finditer(text) if least[k](m)), key=lambda s: (s[0], list(kinds).index(s[2])))
        assert base == want
        assert not any(a < y and x < b for a, b, _ in added for x, y, _ in base)
    odd = ["key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY end", "id 123e4567-e89b-12d3-a456-426614174000", "internationalisation-of-words-and-more", "1234567890123456789012345"]
    assert [len(b) for _, b in secret_scan.find(odd)] == [1, 0, 0, 0]


def test_window_entropy_is_incremental():
    from collections import Counter
    from math import log2

    text = "".join(random.Random(6).choice("abc01") for _ in range(200))
    plain = max(-sum(n / 20 * log2(n / 20) for n in Counter(text[i : i + 20]).values()) for i in range(181))
    assert abs(secret_scan.window_entropy(text) - plain) < 1e-9


def test_messages_are_exact():
    import itertools

    page = html_tree.Page("<div><p>a</p><ul><li>b<li>c</ul></div><p>d</p>")
    rng = np.random.default_rng(1)
    scores, pair = rng.normal(size=(len(page.tag), 2)), rng.normal(size=(2, 2))
    got = np.exp(html_tree.Forest([page]).infer(scores, pair)[0])
    total = np.zeros_like(got)
    for s in itertools.product((0, 1), repeat=len(page.tag)):
        w = np.exp(sum(scores[i, x] for i, x in enumerate(s)) + sum(pair[s[p], s[i]] for i, p in enumerate(page.parent) if p >= 0))
        for i, x in enumerate(s):
            total[i, x] += w
    assert np.allclose(got, total / total.sum(1, keepdims=True))


def test_main_text_held_out():
    made = html_tree.labelled_pages(seed=77, n=80)
    exact = 0
    for (source, kept), got in zip(made, html_tree.extract(html_tree.default_model(), [s for s, _ in made]), strict=True):
        exact += [t for _, t in html_tree.Page(source).blocks if t in kept] == (got.split("\n") if got else [])
    assert exact / len(made) > 0.9
