"""The training-data operators read all of their input: one test for each cut that was removed."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from folioquarry.llm import dart_minhash, html_tree, knn_quality, license_index, oracle, winnow


def test_every_licence_template_is_found_by_its_own_text(spark):
    templates = license_index.TEMPLATES
    told = lambda text, keys: f"Licensed under the {text}." if keys == [text] else text
    rows = [(i, told(text, keys)) for i, (_, text, keys) in enumerate(templates)] + [(1000, "Licensed under CC BY-SA 4.0."), (1001, "stand by a sa cc 4")]
    got = {r.doc_id: r for r in license_index.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(templates):
        assert label in got[i].method_labels.split(",") and got[i].score == pytest.approx(1.0)
    assert (got[1000].labels, got[1000].method_labels, got[1001].labels) == ("cc-by-sa", "cc-by-sa", "")


def test_no_licence_template_is_left_out_of_the_index():
    assert {r["label"] for r in license_index.build_index([("x", "by a to", ["by a"]), ("y", "by a so", ["by a"])])} == {"x", "y"}
    with pytest.raises(ValueError, match="same words"):
        license_index.build_index([("x", "same words", ["same"]), ("y", "same words", ["words"])])


def test_all_attribute_words_of_a_node_are_features():
    words = [f"w{chr(97 + i)}" for i in range(20)]
    page = html_tree.Page(f'<div class="{" ".join(words)} sidebar" style="margin: 0">x</div>')
    got = html_tree.features(page)[1]
    assert {zlib.crc32(f"word {w}".encode()) % html_tree.SLOTS for w in [*words, "class", "sidebar", "style", "margin"]} <= set(got)
    assert len(got) == 9 + len(words) + 4


@pytest.mark.parametrize("n", [5, 20])
def test_main_text_of_pages_with_many_classes(n):
    rng = random.Random(3)
    fill = "flex grid col row mt mb px py bg rounded shadow border hover focus active dark light sm md lg xl inner outer block item theme clearfix fade lazy js has gap order align relative absolute visible display font size".split()

    def crowd(m):
        names = [*rng.sample(fill, n), m[2]]
        rng.shuffle(names)
        return f'{m[1]}="{" ".join(names)}" style="margin: 0; padding: 1px"'

    made = [(re.sub(r'\b(class|id|role)="([^"]*)"', crowd, s), kept) for s, kept in html_tree.labelled_pages(seed=77, n=80)]
    exact = 0
    for (source, kept), got in zip(made, html_tree.extract(html_tree.default_model(), [s for s, _ in made]), strict=True):
        exact += [t for _, t in html_tree.Page(source).blocks if t in kept] == (got.split("\n") if got else [])
    assert exact / len(made) > 0.9


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_items_with_repeated_and_null_ids(spark, broadcast):
    w = lambda letter, n, low=0: [f"{letter}{i}" for i in range(low, low + n)]
    d = w("d", 20)
    items = [(1, d[:10] + w("x", 10)), (1, w("y", 10) + d[10:]), (2, ["s1", "s2"]), (2, ["s1", "s2", "s3"]), (None, w("n", 12)), (None, w("m", 3)), (3, w("n", 12))]
    docs = [(1, d), (2, ["q", "s1", "s2", "s3"]), (3, ["q", *w("n", 12), "q"]), (4, w("m", 3)), (5, w("n", 10, 1) + w("m", 3) + d), (6, ["q"]), (7, [])]
    items, docs = ([(i, " ".join(t)) for i, t in rows] for rows in (items, docs))
    con = duckdb.connect()
    for name, key, rows in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.sql(oracle.SQL["op6_winnowing"]).select(*columns).fetchall())
    got = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast)
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    assert [r[2] for r in want] == [20, 3, 12, 3, 33, 0, 0]
    assert {r.doc_id: r["items"] for r in got.collect()} == {1: ["1"], 2: ["2"], 3: ["3"], 4: [], 5: ["1", "3"], 6: [], 7: []}


def test_labelled_texts_get_the_vectors_that_they_are_scored_by(spark):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:6]  # none of the held-out fold
    texts = ["abcd " * 70_000 + "a tail of other words", "a tail of other words", "One two, three", "four five six", "abcd efgh", "Seven: 8 9"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    model = knn_quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert np.allclose(model.vectors, model.latent(*knn_quality.counts(texts)), rtol=0, atol=1e-12)


def test_each_text_of_a_repeated_id_is_compared(spark):
    text = lambda letter: " ".join(f"{letter}{i}" for i in range(60))
    rows = [(i, text(x) + end) for x, i, end in [("a", 1, ""), ("b", 2, ""), ("c", 3, ""), ("a", 9, " x"), ("b", 9, " y"), ("c", 9, " z"), ("d", 8, ""), ("d", 7, " w"), ("e", 8, "")]]
    rows += [(9, text("c")), (6, "")]
    got = dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2), (3, 3), (6, 6), (7, 7), (8, 7), (8, 8), (9, 1), (9, 2), (9, 3), (9, 3)]
