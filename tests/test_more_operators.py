"""Operators that the tables cannot exercise: page rules that fire, packages, decks, trees, signatures, stacks."""

import gzip
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioquarry.functions import text as t
from folioquarry.operators import baking, compare, decks, page_rules, sequences, source_rules
from folioquarry.sources import archives, ast, pages, signature


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PAGE = """<html lang="en"><head><title>t</title></head><body><p><span class="math-lost">?</span> and <span class="x math-lost">?</span></p>
<span data-file="notes.pdf">notes</span><div class="table-wrapper wide"><table><caption>c</caption>
<tr><th><math><mi>x</mi><annotation encoding="application/x-tex">x ^ 2</annotation></math></th><th>Words <math><mi>y</mi></math></th><th><img alt="pic"><math></math></th></tr><tr><td>1</td></tr></table></div>
<table role="presentation"><tr><th><math><mi>z</mi></math></th></tr></table><table><tr><th><math><mi>w</mi></math></th></tr><tr><td>2</td></tr></table></body></html>"""


def test_formulas_and_files_that_pages_lost(spark):
    facts = pages.read_pages(spark.createDataFrame([("p", PAGE)], "url string, html string"))
    found = {(r.check, r.detail) for r in page_rules.check_pages(facts).collect()}
    assert {("formula-lost", "2 formula(s)"), ("link-to-file-dropped", "notes.pdf"), ("table-header-is-formula", "table 1: x ^ 2"), ("table-header-is-formula", "table 3"), ("table-not-in-scroll-region", "table 3")} <= found
    assert not {d for c, d in found if c == "table-header-is-formula"} - {"table 1: x ^ 2", "table 3"}
    assert ("table-not-in-scroll-region", "table 1") not in found


@pytest.mark.parametrize(("given", "want"), [("&#8217;&rsquo;&#x2019;", "’’’"), ("a &amp;lt; b &nosuch; &amp", "a &lt; b &nosuch; &amp"), ("&#0;&#xD800;&#x110000;", "���"), ("&#128;&#150;", "€–"), ("&CounterClockwiseContourIntegral;&NotEqualTilde;", "∳≂̸"), ("no reference", "no reference"), ("&#99999999999;", "�")])
def test_character_references(spark, given, want):
    assert one(spark, t.unescaped(F.lit(given))) == want


def test_collation(spark):
    words = ["zebra", "Äpfel", "apfel", "Apfel", "äpfel", "1984", "#tag", "œuvre", "Œuvre", "ofen", "apfelbaum", "éa", "eb"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").orderBy(baking.collation_key(F.col("w")))
    assert [r.w for r in rows.collect()] == ["#tag", "1984", "apfel", "Apfel", "äpfel", "Äpfel", "apfelbaum", "éa", "eb", "œuvre", "Œuvre", "ofen", "zebra"]
    polish = spark.createDataFrame([(w,) for w in ["zebra", "źle", "żaba", "łan", "las", "lis", "mama"]], "w string").orderBy(baking.collation_key(F.col("w"), "pl"))
    assert [r.w for r in polish.collect()] == ["las", "lis", "łan", "mama", "zebra", "źle", "żaba"]
    assert [one(spark, baking.index_letter(F.lit(w))) for w in ("Éclair", "α-helix", "3D", "ßa", " łan")] == ["E", "Symbols", "Symbols", "S", "L"]


def deck(spark, titles, **more):
    rows = [("d", i + 1, title, list(more.get("items", {}).get(i + 1, [])), []) for i, title in enumerate(titles)]
    return spark.createDataFrame(rows, "deck string, slide long, title string, items array<string>, notes array<string>")


def test_decks_are_aligned_in_order(spark):
    pairs = compare.align_decks(deck(spark, ["A", "B", "C", "E", "B"]), deck(spark, ["A", "A (2)", "A (3)", "X", "B", "B (2)", "E", "Y"]))
    assert [(r.first, r.second) for r in pairs.collect()] == [(1, 1), (1, 2), (1, 3), (None, 4), (2, 5), (3, None), (None, 6), (4, 7), (5, None), (None, 8)]
    pairs = compare.align_decks(deck(spark, ["A", "A (2)"]), deck(spark, ["A", "A (2)", "A (2)"]))
    assert [(r.first, r.second) for r in pairs.collect()] == [(1, 1), (2, 2), (None, 3)]


def test_decks_are_compared_with_parts_together(spark):
    first = deck(spark, ["A", "B", "C"], items={1: ["x", "y"], 2: ["z"], 3: ["q"]})
    second = deck(spark, ["A", "A (2)", "B", "D"], items={1: ["x"], 2: ["y"], 3: ["other"]})
    assert {(r.slide, r.what) for r in compare.compare_decks(first, second).collect()} == {(2, "content"), (3, "only in the first"), (4, "only in the second")}


def test_drafted_order_keeps_what_overlaps(spark):
    boxes = [("d", 1, 1, 1, 0, 50, 10, 10, False), ("d", 1, 2, 2, 0, 0, 10, 10, False), ("d", 1, 3, 3, 5, 52, 10, 10, False), ("d", 1, 4, 4, 3, 49, 4, 4, False), ("d", 1, 5, 5, 90, 90, 5, 5, True)]
    shapes = spark.createDataFrame(boxes, "deck string, slide long, shape_id long, seq int, x long, y long, w long, h long, is_title boolean")
    order = [r.shape_id for r in decks.drafted_order(shapes).orderBy("rank").collect()]
    assert order == [5, 2, 1, 3, 4]
    assert decks.violations(shapes, decks.drafted_order(shapes)).collect() == []


def test_missing_alt_at_any_depth(spark):
    rows = [("d", 1, 0, None, "group", "", "told")] + [("d", 1, i, i - 1, "group", "", "") for i in range(1, 30)] + [("d", 1, 40, 41, "picture", "", ""), ("d", 1, 41, 40, "group", "", "")]
    shapes = spark.createDataFrame([(*r, False) for r in rows], "deck string, slide int, shape_id int, parent_id int, kind string, text string, descr string, decorative boolean")
    assert sorted(r.shape_id for r in decks.missing_alt(shapes).collect()) == [40, 41]


def plain_gaps(levels):
    stack, out = [], []
    for level in levels:
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(min(level, stack[-1][1] + 1) if stack else level)
        stack.append((level, out[-1]))
    return out


def test_level_gaps_and_unique_names_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("level", (F.length("text") % 6 + 1).cast("int"))
    by_conv = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    got = {(r.conv_id, r.pos): r.new_level for r in sequences.close_level_gaps(rows, ["conv_id"], "turn", "level").collect()}
    assert got == {(c, r.turn): x for c, rs in by_conv.items() for r, x in zip(rs, plain_gaps([r.level for r in rs]), strict=True)}
    names = {(r.conv_id, r.turn): r.name for r in sequences.unique_names(rows.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").collect()}
    for c, rs in by_conv.items():
        taken, seen = {r.role for r in rs}, set()
        for r in rs:
            name, n = r.role, 2
            if r.role in seen:
                while f"{r.role}-{n}" in taken:
                    n += 1
                name = f"{r.role}-{n}"
            seen.add(r.role)
            taken.add(name)
            assert names[c, r.turn] == name


def test_ranks_over_many_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 as v")
    assert all(r["rank"] == r.v + 1 for r in sequences.ranked(rows, ["v"]).collect())


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


CONTAINER = '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
OPF = """<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A  book</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2020</meta></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" %s/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine/></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav><ol><li><a href="z">no</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="a.xhtml">One</a>
<ol><li><a href="a%20b.xhtml#s">Two <b>bold</b></a></li></ol></li><li><span>Three</span></li></ol></nav></body></html>"""
NCX = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>Two</text></navLabel><content src="b.xhtml#s"/></navPoint></navPoint></navMap></ncx>'


def test_packages(spark):
    nav = packed(**{"META-INF__container.xml": CONTAINER, "OPS__p.opf": OPF % 'properties="nav"', "OPS__nav.xhtml": NAV, "OPS__toc.ncx": NCX})
    old = packed(**{"META-INF__container.xml": CONTAINER, "OPS__p.opf": OPF % "", "OPS__toc.ncx": NCX})
    rows = spark.createDataFrame([("nav", nav), ("old", old)], "path string, content binary")
    outline = [tuple(r) for r in archives.read_epub_outline(rows).orderBy("path", "pos").collect()]
    assert outline == [("nav", 0, 0, "One", "OPS/a.xhtml", None), ("nav", 1, 1, "Two bold", "OPS/a b.xhtml", "s"), ("nav", 2, 0, "Three", None, None), ("old", 0, 0, "One", "OPS/a.xhtml", None), ("old", 1, 1, "Two", "OPS/b.xhtml", "s")]
    assert {(r.name, r.value) for r in archives.read_epub_metadata(rows).collect()} == {("title", "A book"), ("language", "en"), ("dcterms:modified", "2020")}


def test_kinds_of_files(spark):
    warc = b"WARC/1.0\r\nWARC-Type: response\r\n"
    cases = [(warc, "warc"), (gzip.compress(warc), "warc"), (gzip.compress(b"text"), None), (packed(**{"archive__a.warc.gz": gzip.compress(warc)}), "warc"), (packed(**{"imsmanifest.xml": "<m/>"}), "cartridge"), (packed(a="b"), "zip"), (packed(**{"word__document.xml": "<w/>"}), "word"), (b"PK\x03\x04broken", None), (b"<!DOCTYPE html><p>", "html"), (b"From: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related\r\n", "mhtml"), (b"", None)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    assert [r.kind for r in archives.with_kind(rows).orderBy("i").collect()] == [k for _, k in cases]
    assert [r.x for r in rows.orderBy("i").select(archives.is_warc().alias("x")).collect()] == [k == "warc" for _, k in cases]


def test_coded_bodies():
    head = "HTTP/1.1 200 OK\r\nContent-Encoding: {}\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    ways = {"gzip": gzip.compress(b"body"), "deflate": zlib.compress(b"body"), "Deflate": raw.compress(b"body") + raw.flush(), "identity": b"body", "deflate, gzip": gzip.compress(zlib.compress(b"body"))}
    for coding, data in ways.items():
        assert archives.http_response(head.format(coding).encode() + data) == (200, {"content-encoding": coding}, b"body")
    with pytest.raises(ValueError, match="br"):
        archives.http_response(head.format("br").encode() + b"xx")


def test_collections(spark):
    book = b"<collection><content><module document='m1'><title>Preface</title></module><subcollection><title>One</title><content><module document='m2'/><subcollection><title>Deep</title><content><module document='m3'/></content></subcollection></content></subcollection></content></collection>"
    rows = archives.read_collections(spark.createDataFrame([("c", bytearray(book))], "path string, content binary"))
    assert [(r.depth, r.title, r.module) for r in rows.orderBy("pos").collect()] == [(0, "Preface", "m1"), (0, "One", None), (1, None, "m2"), (1, "Deep", None), (2, None, "m3")]


def cell(text, down=1, across=1):
    return [["", [], []], {"t": "AlignDefault"}, down, across, [{"t": "Plain", "c": [{"t": "Str", "c": text}]}]]


def test_trees(spark):
    row = lambda *cells: [["", [], []], list(cells)]
    table = {"t": "Table", "c": [["tbl", [], []], [None, []], [], [["", [], []], []], [[["", [], []], 0, [], [row(cell("a", 2), cell("b")), row(cell("c")), row(cell("wide", 1, 2))]]], [["", [], []], []]]}
    image = {"t": "Image", "c": [["", [], []], [{"t": "Str", "c": "A"}, {"t": "Space"}, {"t": "Str", "c": "cat"}], ["m/cat.png", ""]]}
    figure = {"t": "Figure", "c": [["fig", [], []], [None, [{"t": "Plain", "c": [{"t": "Str", "c": "A"}, {"t": "Space"}, {"t": "Str", "c": "cat"}]}]], [{"t": "Plain", "c": [image]}]]}
    blocks = [table, {"t": "Div", "c": [["", ["matrix"], []], [table]]}, figure, {"t": "RawBlock", "c": ["html", "<b>\n"]}, {"t": "Para", "c": [{"t": "Math", "c": [{"t": "InlineMath"}, "x \\ "]}]}]
    docs = spark.createDataFrame([("d", json.dumps({"meta": {"title": 1, "lang": 1}, "blocks": blocks})), ("bad", "{"), ("none", None)], "name string, json string")
    facts = ast.read_trees(docs, "name", "json")
    rows = {r.name: r for r in facts.collect()}
    assert rows["d"].tables[0]["cells"] == [["a", "b"], ["a", "c"], ["wide", "wide"]] and [x["marked"] for x in rows["d"].tables] == [False, True]
    assert rows["d"].ids == ["tbl", "tbl", "fig"] and rows["d"].images[0]["is_caption"] and rows["bad"].parse_error and rows["none"].parse_error is None
    found = {(r.where, r.check) for r in source_rules.check_sources(facts).filter("file = 'd'").collect()}
    assert found == {("table 1", "source-table-no-headers"), ("table 1", "source-table-no-caption"), ("table 2", "source-table-no-caption"), ("image 1", "source-image-alt-is-caption"), ("d", "source-raw-html"), ("d", "source-math-trailing-space")}
    keys = [r.key for r in source_rules.table_keys(facts).filter("name = 'd'").orderBy("table").collect()]
    assert keys[0] == keys[1]


def test_signatures():
    got = signature.signature("""<html lang=en><head><title>A  t</title><style>x</style></head><body><h1>One</h1><p>Two wor<b>ds</b>.</p><ul><li>a<ol><li>b</ol><li>c</ul>
    <img src="m/A.PNG?x" alt=""><img src="b.svg"><a href="#x">x</a><a href="b.html#y">y</a><a href="f.pdf">f</a><a href="https://a.b">z</a>
    <table role=grid><caption>Cap tion</caption><thead><tr><th scope=col>h<th scope=col colspan=2>i</tr></thead><tr><td id=q rowspan=2>1<td headers=q>2<td>3</tr></table></body></html>""")
    want = {"title": "A t", "lang": "en", "h1_text": "One", "list_outline": "ul1:2,ol2:1", "img_stems": "A b", "img_extensions": ".png .svg", "img_alt_missing": "1", "img_alt_empty": "1", "link_fragment_count": "1", "link_page_count": "1", "link_asset_count": "1", "link_external_count": "1", "table[1].cols": "3", "table[1].rows": "2", "table[1].thead_rows": "1", "table[1].scope": "col=2", "table[1].colspan": "1", "table[1].rowspan": "1", "table[1].cell_ids": "1", "table[1].headers_attr": "1", "table[1].caption": "Cap tion", "table[1].role": "grid", "word_count": "14"}
    assert {k: got[k] for k in want} == want


def test_redirects_in_chains_and_cycles(spark):
    from folioquarry.operators import links

    rows = [(f"a{i}", f"a{i + 1}") for i in range(150)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("x", "c2"), ("self", "self"), ("b", "a100")]
    got = {r.url: r.end for r in links.follow(spark.createDataFrame(rows, "url string, target string")).collect()}
    assert all(got[f"a{i}"] == "a150" for i in range(150)) and got["b"] == "a150"
    step = dict(rows)
    for url in ("c1", "c2", "c3", "x", "self"):
        end, seen = step[url], {url}
        while end in step and end not in seen:
            seen.add(end)
            end = step[end]
        assert got[url] == end
