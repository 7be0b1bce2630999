"""Names of a site's pages, archives taken apart, configuration files and their types."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioquarry.functions import repairs
from folioquarry.operators import config, sites


def names(spark, urls, **more):
    rows = spark.createDataFrame([("s", u) for u in urls], "site string, url string")
    return {r.url: r.name for r in sites.page_names(rows, ["site"], **more).collect()}


def test_page_names(spark):
    urls = [f"http://a.org/book/ch/{n}.html" for n in ("one", "two", "three", "a b", "x")] + ["http://a.org/index.html"]
    assert names(spark, urls) == dict(zip(urls, ["one", "two", "three", "a-b", "x", "index"], strict=True))
    urls = ["http://a.org/l?section=1", "http://a.org/l?section=2"]
    assert names(spark, urls) == dict(zip(urls, ["section-1", "section-2"], strict=True))
    urls = ["http://a.org/x/1/a.html", "http://a.org/x/2/a.html", "http://a.org/x/2/b/c.html?q=1"]
    assert names(spark, urls) == dict(zip(urls, ["1-a", "2-a", "2-b-c-q-1"], strict=True))
    urls = ["http://a.org/14%3A_Use/14.04%3A_Tests", "http://a.org/15/14.04:_Tests/"]
    assert names(spark, urls, leaf=True) == dict(zip(urls, ["14.04-Tests", "14.04-Tests-2"], strict=True))


def test_archives_are_taken_apart(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("wrap/in/a.txt", "wrap/in/d/b.txt", "__MACOSX/wrap/x", "wrap/in/.DS_Store", "../evil"):
            z.writestr(n, n)
    rows = spark.createDataFrame([("z", out.getvalue())], "path string, content binary")
    assert {(r.name, bytes(r.content).decode()) for r in sites.unpacked(rows).collect()} == {("a.txt", "wrap/in/a.txt"), ("d/b.txt", "wrap/in/d/b.txt")}


def test_settings_files():
    assert config.load_settings('{"a": {"b": null, "c": [1, "x"]}, "d": true, "e": {}}') == [("a.b", None), ("a.c", '[1, "x"]'), ("d", "true")]
    with pytest.raises(ValueError, match="twice"):
        config.load_settings('{"a": 1, "a": 2}')


CASES = [
    ("bool", '" YES "', "true", None), ("bool", "0", "false", None), ("bool", '"maybe"', None, "is not true or false"), ("int", "12", "12", None), ("int", "1.5", None, "is not a whole number in range"), ("int", "101", None, "is not a whole number in range"),
    ("int", "true", None, "is not a whole number in range"), ("float", '"2.5"', "2.5", None), ("float", '"NaN"', None, "is not a number in range"), ("enum", "true", "On", None), ("enum", '"OFF"', "off", None), ("enum", '"x"', None, "is not one of the choices"),
    ("date", '"2024-02-29"', "2024-02-29", None), ("date", '"2023-02-29"', None, "is not a date"), ("language", '"en_us"', "en-US", None), ("language", "false", None, "was read as true or false; quote it"), ("string", "1.1", None, "is a number; quote it to keep it as written"),
    ("string", '"a \\"b\\""', 'a "b"', None), ("list", '"one"', '["one"]', None), ("list", "[1, 2]", "[1, 2]", None), ("opaque", '{"x":1}', '{"x":1}', None),
]


def test_types_of_settings(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _, _) in enumerate(CASES)], "i int, kind string, v string")
    got = rows.select("i", config.coerced(F.col("v"), F.col("kind"), F.lit(0.0), F.lit(100.0), F.array(F.lit("On"), F.lit("off"))).alias("x")).orderBy("i").collect()
    assert [(r.x.value, r.x.problem) for r in got] == [(v, p) for _, _, v, p in CASES]


def test_repairs():
    assert repairs.unspell("upper A v e r a g e of italic x y") == "Average of xy"
    assert repairs.unspell("a plain caption with I alone") == "a plain caption with I alone"
    assert repairs.empty_as_data('<th scope="row" id=a>&nbsp;</th><th>x</th>') == "<td id=a>&nbsp;</td><th>x</th>"
    kept = "<table><thead><tr><th>a</th></tr></thead><tbody></tbody></table>"
    assert repairs.body_out_of_head(kept) == kept
    assert repairs.selected("<div class='a b'><p id=x>One <i>two</i></p></div><p>no</p>", ".a p") == ["One two"]
    text = "\\begin{verbatim}%x\\end{verbatim} \\url{a%b} 5\\% % note\n\\lstinline{x%y} z"
    assert [text[a:b] for a, b in repairs.skip_spans(text)] == ["\\begin{verbatim}%x\\end{verbatim}", "{a%b}", "% note", "\\lstinline{x%y}"]


def test_equations():
    cases = {"x – 1 µ": "x - 1 μ", "\\text{–}3": "-3", "\\text{H–Cl}": "\\text{H–Cl}", "\\text{16~–~2P}": "\\text{16~−~2P}", "\\underset{\\text{–}}{x}": "\\underset{\\text{–}}{x}", "\\text{1–2 and {–3}}": "\\text{1–2 and {−3}}", "\\overset{¯}{x}·ŷ": "\\bar{x}\\cdot \\hat{y}", "H_{Ø}": "H_{0}", "\\text{µ–––}": "\\text{μ–––}", "\\text{open –": "\\text{open -"}
    assert {k: repairs.repair_tex(k) for k in cases} == cases
    text = {"It fell to –5 °C.": "It fell to −5 °C.", "pages 5–9 and A–Z": "pages 5–9 and A–Z", "so x – 3 = –2": "so x − 3 = −2", "a word – and another": "a word – and another", "(–3, –2)": "(−3, −2)", "5–3 = 2": "5−3 = 2"}
    assert {k: repairs.minus_in_text(k) for k in text} == text


MODULE = b"""<document xmlns="http://cnx.rice.edu/cnxml" xmlns:m="http://www.w3.org/1998/Math/MathML" id="m1"><title>A  module</title><content>
<para id="p1">Text <emphasis effect="italics">it</emphasis> &lt; <term>term</term><footnote>note</footnote> <link document="m2" target-id="x">there</link><link url="u"/></para>
<section id="s"><title>One</title><list list-type="enumerated" number-style="lower-alpha"><item>a</item><item>b<list><item>c</item></list></item></list>
<note><title>N</title><para id="p2">in</para></note></section>
<figure id="f"><media alt="A &quot;cat&quot;"><image src="c.png"/></media><caption>Cap</caption></figure>
<equation id="e"><m:math display="block"><m:mi> x </m:mi></m:math></equation>
<table><tgroup cols="2"><colspec colname="a" colnum="1"/><colspec colname="b" colnum="2"/><thead><row><entry namest="a" nameend="b">H</entry></row></thead><tbody><row><entry morerows="1">1</entry><entry>2</entry></row></tbody></tgroup></table>
</content><glossary><definition id="d"><term>t</term><meaning>m</meaning></definition></glossary></document>"""


def test_modules(spark):
    from folioquarry.sources import cnxml

    rows = spark.createDataFrame([("a", bytearray(MODULE)), ("b", bytearray(b"<document><content><odd>x</odd></content></document>")), ("c", bytearray(b"<broken"))], "path string, content binary")
    got = {r.path: r for r in cnxml.read_modules(rows).collect()}
    page = got["a"].html
    assert (got["a"].module, got["a"].title, got["a"].problem) == ("m1", "A module", None)
    for part in (
        '<p id="p1">Text <em>it</em> &lt; <dfn>term</dfn><sup id="fnref1"><a href="#fn1">1</a></sup> <a href="m2.html#x">there</a><a href="u">[link]</a></p>',
        '<section id="s"><h2>One</h2><ol type="a"><li>a</li><li>b<ul><li>c</li></ul></li></ol>', '<aside class="note"><h3>N</h3><p id="p2">in</p></aside>',
        '<figure id="f"><span class="media"><img src="c.png" alt="A &quot;cat&quot;"></span><figcaption>Cap</figcaption></figure>', '<div id="e" class="equation"><math display="block"><mi>x</mi></math></div>',
        '<table><thead><tr><th colspan="2">H</th></tr></thead><tbody><tr><td rowspan="2">1</td><td>2</td></tr></tbody></table>', '<section class="glossary"><div id="d" class="definition"><dfn>t</dfn><div class="meaning">m</div></div></section>', '<ol class="footnotes"><li id="fn1">note</li></ol>',
    ):
        assert part in page
    assert "odd" in got["b"].problem and got["c"].problem and cnxml.convert(b"<document><content><odd>x</odd></content></document>", lenient=True)["html"] == "x"
