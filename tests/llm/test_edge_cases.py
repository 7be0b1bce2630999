"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest

from folioquarry.llm import byte_bpe, dart_minhash, html_tree, knn_quality, license_index, pii, quality_lines, secret_scan, warc, winnow

SCHEMA = "doc_id long, text string, n_words long, word string, h string, id string, digest string, spans string, kept string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, LONG), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (5, "\n \t"), (6, "a" * 50_000), (7, "é" * 300 + " " + "0" * 300)]


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "quality": lambda d, s: quality_lines.score(d),
    "retain": lambda d, s: quality_lines.retain(d),
    "bpe": lambda d, s: byte_bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
    "encode": lambda d, s: byte_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_offsets=True),
    "pii": lambda d, s: pii.scan(d),
    "near": lambda d, s: dart_minhash.classes(d),
    "license": lambda d, s: license_index.scan(d),
    "winnow": lambda d, s: winnow.decontaminate(d, items(s)),
    "knn": lambda d, s: knn_quality.classify(d, knn_quality.learn(d, s.createDataFrame([(3, 1), (7, 0), (None, 1), (4, None)], "doc_id long, quality int"))),
    "secrets": lambda d, s: secret_scan.scan(d),
    "redact": lambda d, s: secret_scan.redact(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_defined_results(spark, name):
    full = spark.createDataFrame([(i, t, 9, "x", "y", "z", "q", "s", "k") for i, t in ROWS], SCHEMA)
    out = OPERATORS[name](full, spark)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    found = out.collect()
    assert len(found) == (2 if name == "retain" else len(ROWS)) or name == "retain"
    assert OPERATORS[name](full.limit(0), spark).collect() == []


def test_tokens_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> é 😀")], "doc_id long, text string")
    got = {r.doc_id: r for r in OPERATORS["bpe"](docs, spark).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == got[2].decoded_sha256
    assert got[3].n_tokens > 3


def test_pages_and_archives(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>x</p>"), (4, "v\r\nEvil: 1", "<p>x</p>"), (4, "v", "<p>x</p>"), (None, "w", "<p>x</p>"), (5, "z", "WARC/1.1\r\n\r\n" * 3 + "é" * 100_000), (6, "y", "<p>cut <b"), (7, "y", "<" * 5000 + "<!--" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as payload", "2 as original")
    texts = {r.page_id: r.text for r in html_tree.main_text(pages).collect()}
    assert texts[1] == texts[2] == "" and len(texts) == 8
    got = warc.archive(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(0, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 3), (4, "revisit", 3), (5, "response", 0), (6, "response", 0), (7, "response", 0)]
    assert html_tree.main_text(pages.limit(0)).collect() == []
    assert warc.resolve(pages.limit(0)).collect() == []
