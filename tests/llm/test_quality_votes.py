"""The nearest-neighbour vote against a plain one over the same vectors, and what its model is made of."""

import numpy as np

from folioquarry.llm import knn_quality

SF = "/root/testdata/sf0.001"


def plain_score(vector, model, k=knn_quality.NEIGHBOURS):
    cosines = [float(np.dot(vector, v)) for v in model.vectors]
    order = sorted(range(len(cosines)), key=lambda i: (-round(cosines[i], 9), i))[:k]
    weights = [max(cosines[i], 0.0) for i in order]
    total = sum(weights)
    return sum(w * model.labels[i] for w, i in zip(weights, order, strict=True)) / total if total > 1e-9 else 0.0


def test_every_score_is_the_plain_vote(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        model = knn_quality.learn(docs, labels)
        assert len(model.labels) > knn_quality.NEIGHBOURS
        got = {r.doc_id: r for r in knn_quality.classify(docs, model).collect()}
        rows = docs.select("doc_id", "text").collect()
        for r in rows:
            vector = model.latent(*knn_quality.counts([r.text]))[0]
            want = plain_score(vector, model)
            assert abs(got[r.doc_id].score - want) < 2e-6
            if abs(want - knn_quality.THRESHOLD) > 2e-6:
                assert got[r.doc_id].predicted == int(want >= knn_quality.THRESHOLD)


def test_ties_go_to_the_first_columns():
    cosine = np.array([[0.5, 0.5, 0.9, 0.5, 0.1], [1.0, 1.0, 1.0, 1.0, 1.0]])
    assert knn_quality.nearest(cosine, 3).tolist() == [[True, True, True, False, False], [True, True, True, False, False]]
    assert knn_quality.nearest(cosine, 9).all()


def test_one_id_on_two_texts_learns_alike(spark):
    rows = [(1, "one text"), (1, "another text"), (2, "a third"), (3, "a fourth one here")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    models = [knn_quality.learn(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1])]
    assert np.array_equal(models[0].vectors, models[1].vectors)
