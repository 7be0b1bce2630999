"""Near duplicates: large groups of near copies and of unlike texts, and which rows stay."""

import random

import pytest
from pyspark.sql import functions as F

from folioquarry.llm import common, dart_minhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}


def plain_classes(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= threshold * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def family(rng, n, edits, words=120, own="e"):
    """Texts of one base with some words changed, the new ones out of few, so that changes recur."""
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.choice(edits)):
            text[rng.randrange(words)] = f"{own}{rng.randint(0, 3)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies_and_of_unlike_texts(spark, seed):
    rng = random.Random(seed)
    texts = family(rng, 220, range(0, 9)) + family(rng, 160, range(4, 14)) + family(rng, 40, [1], words=8)
    shared = [f"s{i}" for i in range(70)]  # texts that share a passage and little else: bands in common, no links
    texts += [" ".join(shared + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(10, 60))]) for _ in range(150)]
    rows = list(enumerate(dict.fromkeys(texts)))
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_classes(rows)


def test_pairs_without_a_leader_are_found(spark):
    """Links between texts of a band whose leader is like neither of them, by the prefix join alone."""
    rng = random.Random(5)
    rows = list(enumerate(dict.fromkeys(family(rng, 90, range(0, 8), words=60))))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = dart_minhash._sets(docs, "doc_id", "text", docs.select(F.col("doc_id").alias("vid"), _digest("text").alias("digest"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("raw")).alias("row"))).cache()
    everyone = sets.select("vid", F.col("vid").alias("root"), F.lit(True).alias("outside"))
    pairs = dart_minhash.similar(dart_minhash.residue(dart_minhash.prefixes(everyone, sets, 0.8), 0.8), sets, 0.8).collect()
    s = {i: shingles(t) for i, t in rows}
    want = {(i, j) for i in s for j in s if i < j and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert len(want) > 10 and {(min(p), max(p)) for p in pairs} == want


def _digest(column):
    return F.udf(dart_minhash._digest, "binary")(column)


def run(spark, rows):
    return sorted(((r.doc_id, r.text) for r in dart_minhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_one_row_of_each_class_stays(spark, monkeypatch, most):
    monkeypatch.setattr(dart_minhash, "bounded", lambda side: common.bounded(side, most))
    t, u, w = (" ".join(f"{x}{i}" for i in range(40)) for x in "tuw")
    assert run(spark, [(1, t), (1, t), (2, t), (2, u), (3, w)]) == [(1, t), (2, u), (3, w)]
    assert run(spark, [(4, t + " x"), (5, t), (5, t + " y"), (5, t + "  y")]) == [(4, t + " x")]
    assert run(spark, [(None, t), (None, t), (None, u), (7, u), (None, w)]) == sorted([(7, u), (None, t), (None, w)], key=repr)
    assert run(spark, [(None, None), (None, None), (1, None), (1, None), (2, ""), (3, "")]) == sorted([(None, None), (None, None), (1, None), (1, None), (2, "")], key=repr)
    assert run(spark, [(3, t + "\n"), (3, t), (3, t)]) in ([(3, t)], [(3, t + "\n")])


def test_further_columns_stay_and_do_not_clash(spark):
    rows = [(1, "a b c", "x", "y", 1, 2), (2, "a  b c", "x", "y", 1, 2), (2, "d", "x", "y", 1, 2), (2, "d", "x", "y", 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, digest string, raw long, vid int")
    out = dart_minhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert [(r.doc_id, r.text) for r in out.orderBy("doc_id").collect()] == [(1, "a b c"), (2, "d")]


def test_long_words_that_differ_by_places_are_not_equal(spark):
    a, b = "x" * 4095 + "ab" + "x" * 4094, "x" * 4095 + "ba" + "x" * 4094
    rows = [(1, a), (2, b), (3, "q" + "y" * 4096 + "r"), (4, "r" + "y" * 4096 + "q"), (5, "r" + "y" * 4095 + "q")]
    got = dart_minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.class_id for r in got}) == 5
    w = common.Words([f"{'p' * 5000} {'p' * 904}q{'p' * 4095} {'q' + 'p' * 4999}", f"{'p' * 5000}"])
    h = common.word_hashes(w)
    assert h[0] == h[3] and len(set(h[:3].tolist())) == 3
