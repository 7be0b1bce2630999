"""Scalars against plain values."""

from pyspark.sql import functions as F

from folioquarry.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    for column, want in [
        (t.clean(lit("  Tea  and\x1cCake?! ")), "tea and cake"),
        (t.slugify(lit("Key Concepts &amp; Bob’s  Summary")), "key-concepts-bobs-summary"),
        (t.safe_path(lit("a b/c- .png")), "a-b/c.png"),
        (t.safe_stem(lit("/a/b c")), "a-b-c"),
        (t.safe_stem(lit("//")), "page"),
        (t.letter(lit(1)), "A"), (t.letter(lit(26)), "Z"), (t.letter(lit(27)), "AA"), (t.letter(lit(703)), "AAA"),
        (t.canonical(lit("http://x/a/?q=1#f")), "http://x/a/index.html?q=1"),
        (t.tag(lit("es-ES_tradnl")), "es-ES"), (t.tag(lit("EN_us")), "en-US"), (t.tag(lit("ZH-hant-tw")), "zh-Hant-TW"), (t.tag(lit("English")), None), (t.tag(lit("und")), None), (t.tag(lit("en-x-AB")), "en-x-ab"),
        (t.same_language(lit("en-GB"), lit("en-US")), True), (t.same_language(lit("sr-Latn"), lit("sr-Cyrl")), False), (t.same_language(lit("x"), lit("en")), False),
        (t.unguarded(t.guarded(lit("'=a"))), "'=a"), (t.guarded(lit("-1")), "'-1"), (t.guarded(lit("plain")), "plain"),
        (t.stem_of(lit("media/rId35.so")), "rId35"), (t.stem_of(lit("x/10-p.md#table-6")), "10-p#table-6"),
        (t.classify_link(lit(" #x")), "fragment"), (t.classify_link(lit("MAILTO:a@b")), "external"), (t.classify_link(lit("a/b.html?x#y")), "page"), (t.classify_link(lit("a.pdf")), "asset"), (t.classify_link(lit(" ")), None), (t.classify_link(lit("?q")), "fragment"),
        (t.within_tolerance(lit(100), lit(105)), True), (t.within_tolerance(lit(1000), lit(1021)), False), (t.within_tolerance(lit(1000), lit(1020)), True),
        (t.percent_decoded(lit("a+b%20c")), "a+b c"), (t.percent_decoded(lit("100%")), "100%"),
        (t.title_from_slug(lit("choice-in-a-world")), "Choice in a World"),
        (t.chapter_of(lit("chapter-12")), 12), (t.chapter_of(lit("12-key")), 12), (t.chapter_of(lit("preface")), None),
        (t.matter_role(lit("_x")), "front"), (t.matter_role(lit("A3 Appendix")), "back"), (t.matter_role(lit("one")), "middle"),
        (t.boolean_word(lit("Yes")), True), (t.boolean_word(lit("t")), None),
        (t.parse_number(lit("−3.5 kg")), -3.5), (t.is_amount(lit("$1,200.50")), True), (t.is_amount(lit("abc")), False),
        (t.looks_spelled_out(lit("x a b c d")), True), (t.to_inches(lit("2.54cm")), 1.0), (t.to_inches(lit("wide")), None),
        (t.address_form(lit("HTTPS://a.B/c%20d//")), "a.b/c d"), (t.name_problem(lit("con.txt")), "names a device"), (t.name_problem(lit("ok-1")), None),
    ]:
        assert value(spark, column) == want, (str(column)[:200], want)


def test_natural_order(spark):
    rows = spark.createDataFrame([("10-1",), ("2-1",), ("1-2",), ("1-10",), ("a",)], "s string").orderBy(t.natural_key("s")).collect()
    assert [r.s for r in rows] == ["1-2", "1-10", "2-1", "10-1", "a"]
