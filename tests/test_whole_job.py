"""The library's queries and operators read all of their input: one test for each cut that was removed."""

from folioquarry.operators import contents, links
from folioquarry.plans.queries import QUERIES


def test_text_problem_judges_whole_texts(spark, tmp_path):
    texts = ["A fox in the snow\n" + "y" * 120, "\n\nuntitled", "image\nof a fox", "Photo by\nAnn Lee", "A fox\n", None]
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.kind, r.rule) for r in QUERIES["text_problem"](spark, str(tmp_path)).collect()}
    assert got == {0: ("too-long", "138 characters (limit 120)"), 1: ("placeholder", "says nothing"), 2: (None, None), 3: ("credit", "a credit or a source"), 4: (None, None), 5: (None, None)}


def test_redirects_are_followed_to_their_end(spark):
    n = 52
    rows = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(n)] + [("in", "x"), ("x", "y"), ("y", "x")], "url string, target string")
    got = {r.url: r.end for r in links.follow(rows).collect()}
    assert got == {f"u{i}": f"u{n}" for i in range(n)} | {"in": "x", "x": "x", "y": "y"}


def test_includes_are_followed_to_their_end(spark):
    n = 61
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, 0)], "file int, includes int")
    got = {r.file: r.depth for r in contents.reached(edges, spark.createDataFrame([(0,)], "file int")).collect()}
    assert got == {i: i for i in range(n + 1)}
