"""Operators on inline rows: one that fires, one that must not, and the boundary."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioquarry.operators import alttext, compare, contents, decisions, decks, findings, links, page_rules, sequences, tables
from folioquarry.sources import archives, sidecars
from folioquarry.sources.pages import facts_of, read_pages
from folioquarry.streaming import incremental

PAGE = """<html lang="en"><head><title>t_x</title></head><body><h1 id="a">H</h1><h3 id="a">x</h3><h2></h2><img src="p.png"><img src="a/db-lock.png" alt="db lock"><img src="u" alt="">
<img src="v" alt="a red fox"><img src="w" alt="A red fox."><a href="q.html#z">l</a><a href="#a" aria-label="foo">Bar</a><a href="#nope">n</a><a href="https://x/">e</a>
<table role="presentation"><tr><td>1</td></tr></table><table><tr><td>1</td></tr></table><script>var s = "</p>";</script></body>"""


def test_page_rules(spark):
    facts = read_pages(spark.createDataFrame([("d/t_x.html", PAGE), ("e.html", None)], "url string, html string"))
    got = sorted((r.where, r.check, r.detail) for r in page_rules.check_pages(facts).collect() if r.where != "e.html")
    assert [g[1] for g in got] == ["duplicate-id", "empty-heading", "heading-skips-level", "image-alt-is-file-name", "image-empty-alt-not-decorative", "image-without-alt", "link-label-without-text", "table-not-in-scroll-region", "table-without-headers-or-caption", "title-is-file-name"]
    assert ("d/t_x.html", "table-without-headers-or-caption", "table 2") in got
    lost = {(r.check, r.detail) for r in links.check_links(facts).collect()}
    assert lost == {("link-to-missing-file", "q.html#z"), ("link-to-missing-fragment", "#nope")}
    assert sorted(r.detail for r in page_rules.check_shared_alt(facts).collect()) == ["v: 'a red fox' (shared with 1 other image)", "w: 'A red fox.' (shared with 1 other image)"]
    final = {r.Check: (r.Severity, r.Fix) for r in findings.finalize(page_rules.check_pages(facts)).collect()}
    assert final["empty-heading"] == ("warning", "manual") and final["no-lang"] == ("error", "source")
    top = findings.summarize(findings.finalize(links.check_links(facts))).collect()
    assert [tuple(r) for r in top] == [("link-to-missing-file", 1), ("link-to-missing-fragment", 1)]


def test_cut_page_still_reads():
    assert facts_of("x", "<html><title>a</ti")["title"] is not None
    assert facts_of("x", "<p>", strict=True)["parse_error"]


def test_text_problems(spark):
    cases = {"Photo by Ann Lee": "credit", "Source: NASA": "credit", "CC BY 4.0": None, "Drawing by Otto Keller of two barges": None, "j0309720": "placeholder", "...": "placeholder", "Untitled.": "placeholder", "fox.png": "is-file-name", "www.jpeg.org": "credit", "Woman | Premium Vector": "page-title", "a fox": None, "": None, "y" * 121: "too-long", "y" * 120: None, "Description automatically generated": "auto-generated"}
    rows = spark.createDataFrame([(a,) for a in cases], "a string")
    got = {r.a: r.p and r.p.kind for r in rows.select("a", alttext.problem(F.col("a")).alias("p")).collect()}
    assert got == cases
    own = rows.select("a", alttext.problem(F.col("a"), extra=("A fox", "re:^y+$")).alias("p")).filter("p.rule = 'says nothing'").collect()
    assert {r.a for r in own} == {"a fox", "y" * 121, "y" * 120, "Untitled."}


def test_redirects_end_in_cycles(spark):
    rows = spark.createDataFrame([("x", "y"), ("y", "x"), ("a", "b"), ("b", "c"), ("s", "s")], "url string, target string")
    assert {r.url: r.end for r in links.follow(rows).collect()} == {"x": "x", "y": "y", "a": "c", "b": "c", "s": "s"}


def test_references(spark):
    pages = spark.createDataFrame([("http://h/a/index.html",)], "url string")
    refs = spark.createDataFrame([("http://h/p", "http://h/a/?u=1", True), ("http://h/p", "http://h/gone", True), ("http://h/p", "http://cdn/i.png", False), ("http://h/p", "http://h/old", True)], "page string, value string, is_link boolean")
    held = spark.createDataFrame([("http://h/i.png", "k")], "url string, key string")
    moved = spark.createDataFrame([("http://h/old", "http://h/a/")], "url string, target string")
    got = {r.value: (r.local, r.missing) for r in links.localize(refs, pages, held, moved).collect()}
    assert got == {"http://h/a/?u=1": ("http://h/a/index.html", None), "http://h/gone": (None, "page-not-saved"), "http://cdn/i.png": (None, "resource-not-held"), "http://h/old": ("http://h/a/index.html", None)}


def grid(rows, bold=(0,), same=()):
    return [[{"cell_id": 100 * i + (0 if i in same else j), "text": x, "bold": i in bold, "shaded": False, "image": False} for j, x in enumerate(r)] for i, r in enumerate(rows)]


def test_table_kinds_and_guesses(spark):
    cases = {
        "first": (grid([["Name", "Age", "City"], ["ann", "x1 long text", "rome"], ["ann", "y", "z"]]), "first-row", "first-row"),
        "keyed": (grid([["Name", "Age"], ["ann", "3"], ["bob", "4"], ["cy", "9"]]), "first-row", "both"),
        "one": (grid([["x"]]), "layout(single-cell)", None),
        "none": (grid([["1", "2"], ["3", "4"], ["5", "6"]], bold=()), "no-header-signal", "none"),
        "title": (grid([["T", "T"], ["A", "B"], ["x", "y"]], bold=(1,), same=(0,)), "title-row-then-headers", "first-row"),
        "empty": ([], "empty", None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], f"name string, grid {tables.GRID}")
    got = {r["name"]: (r.kind, r.guess) for r in tables.explain(tables.classify(rows)).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    held = {r["name"]: (r.caption_rows, r.split_at) for r in tables.structure(rows).collect()}
    assert held["title"] == ("1", "") and held["first"] == ("", "")
    cells = lambda *x: grid([list(x)])[0]
    edge = spark.createDataFrame([(cells("1", "a", "b"),), (cells("1", "2", "a"),)], f"c {tables.GRID[6:-1]}").select(tables.mostly_numeric(F.col("c")).alias("m"), tables.keys_rows(F.col("c")).alias("k")).collect()
    assert [r.m for r in edge] == [True, True] and edge[0].k


def test_sequences(spark):
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate([1, 3, 3, 2, 4])], "doc string, pos long, level int")
    assert [(r.pos, r.new_level) for r in sequences.close_level_gaps(rows, ["doc"], "pos", "level").orderBy("pos").collect()] == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert [r.pos for r in sequences.level_skips(rows, ["doc"], ["pos"], "level").collect()] == [1, 4]
    ids = spark.createDataFrame([("d", i, w) for i, w in enumerate(["a", "a", "a-2", "a"])], "doc string, pos long, want string")
    assert [r.name for r in sequences.unique_names(ids, ["doc"], ["pos"], "want").orderBy("pos").collect()] == ["a", "a-3", "a-2", "a-4"]
    blocks = [("s", 0, "para", None, "x"), ("s", 1, "heading", 1, "One"), ("s", 2, "heading", 2, "In"), ("s", 3, "para", None, "y"), ("s", 4, "heading", 1, "Two"), ("s", 5, "heading", 2, "In"), ("s", 6, "para", None, "z")]
    got = sequences.split_pieces(spark.createDataFrame(blocks, "doc string, pos int, kind string, level int, text string")).orderBy("piece").collect()
    assert [(r.name, r.position) for r in got] == [("s", "0"), ("s--in", "1.1"), ("s--two--in", "2.1")]


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("d", None)], "k string, guess string")
    said = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "manual", 3), ("c", " ", 4), ("z", "q", 5)], "k string, said string, row_no int")
    last = decisions.last_rows(said, ["k"])
    assert {r.k: r.conflict for r in last.collect()}["a"]
    got = {r.k: (r.value, r.supplier, r.status) for r in decisions.in_effect(rows, last, ["k"], "said", "guess").collect()}
    assert got == {"a": ("y", "sidecar", "declared"), "b": ("", "sidecar", "manual"), "c": ("g", "guess", "blank"), "d": (None, "", "new")}
    assert [r.k for r in decisions.stale_rows(rows, said, ["k"]).collect()] == ["z"]
    both = spark.createDataFrame([("p", 1, True, "a"), ("p", 2, True, None), ("q", 1, True, "b"), ("q", 2, False, None)], "key string, layer int, present boolean, value string")
    assert {r.key: r.value for r in decisions.cascade(both, spark.createDataFrame([("p", "d"), ("q", "d"), ("r", "d")], "key string, value string")).collect()} == {"p": "d", "q": "b", "r": "d"}


def test_compare_and_align(spark):
    a = spark.createDataFrame([("p", 100, "x"), ("q", 1, "y")], "stem string, words int, title string")
    b = spark.createDataFrame([("p", 104, "z"), ("r", 1, "y")], "stem string, words int, title string")
    got = sorted((r.stem, r.status, r.field or "") for r in compare.compare_runs(a, b, "stem", ["words", "title"], tolerant=("words",)).collect())
    assert got == [("p", "both", "title"), ("q", "only-before", ""), ("r", "only-after", "")]
    deck = lambda *t: spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(t)], "deck string, slide int, title string")
    pairs = compare.align_decks(deck("A", "B", "C"), deck("A", "A (2)", "C")).collect()
    assert {(r.first, r.second) for r in pairs} >= {(1, 1), (3, 3)}


def test_decks(spark):
    box = "deck string, slide int, shape_id int, parent_id int, seq int, kind string, text string, descr string, decorative boolean, is_title boolean, x long, y long, w long, h long"
    rows = spark.createDataFrame([("d", 1, 1, None, 0, "shape", "low", None, False, False, 0, 100, 10, 10), ("d", 1, 2, None, 1, "shape", "high", None, False, False, 0, 0, 10, 10), ("d", 1, 3, None, 2, "group", "", "told", False, False, 5, 5, 10, 10), ("d", 1, 4, 3, 3, "picture", "", None, False, False, 6, 6, 2, 2), ("d", 1, 5, None, 4, "picture", "", None, False, False, 90, 90, 2, 2)], box)
    assert {(r.first, r.second) for r in decks.overlapping(rows).collect()} == {(2, 3), (2, 4), (3, 4)}
    assert decks.reading_order(rows).count() == 1
    assert [r.shape_id for r in decks.missing_alt(rows).collect()] == [5]
    assert decks.visual_order(rows).filter("rank = 1").first().shape_id == 2
    near = decks.nearest(spark.createDataFrame([("w", [1, 1])], "typeface string, panose array<int>"), spark.createDataFrame([("f", [9, 9]), ("g", [1, 2])], "face string, panose array<int>"))
    assert near.first().nearest == "g"


def test_book_order(spark):
    stems = ["2-1-b", "10-1-x", "1-introduction", "chapter-1", "1-key-terms", "1-2-z", "preface", "glossary", "2-odd"]
    got = contents.book_order(spark.createDataFrame([(s,) for s in stems], "stem string"), []).orderBy("position").collect()
    assert [r.stem for r in got] == ["preface", "chapter-1", "1-introduction", "1-2-z", "1-key-terms", "2-1-b", "2-odd", "10-1-x", "glossary"]
    assert [r.role for r in contents.unknown_roles(spark.createDataFrame([(s,) for s in stems], "stem string")).collect()] == ["odd"]
    nodes = spark.createDataFrame([("b", 0, None, "Pre", "front"), ("b", 1, None, "One", "main"), ("b", 2, 1, "One", "main"), ("b", 3, 1, "S", "main"), ("b", 4, None, "App", "appendix")], "book string, pos int, parent int, title string, role string")
    assert [(r.pos, r.number) for r in contents.numbered(nodes, ["book"]).orderBy("pos").collect()] == [(0, None), (1, "1"), (2, "1"), (3, "1.1"), (4, "A")]


def test_archives(spark, tmp_path):
    import gzip

    def record(kind, url, block, more=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a</p>"
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    moved = b"HTTP/1.1 301 Moved\r\nLocation: http://h/a\r\n\r\n"
    parts = [record("response", "http://h/a", ok), record("response", "http://h/i.png", chunked), record("response", "http://h/old", moved), record("revisit", "http://h/b", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To-Target-URI: http://h/a\r\n")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="g" href="gone.css" media-type="text/css"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<p/>")
    raw = archives.files(spark, str(tmp_path), "*.gz")
    assert raw.filter(archives.is_warc()).count() == 1
    got = links.resolve_redirect_map(archives.read_warc(raw))
    assert [r.url for r in got["pages"].collect()] == ["http://h/a"] and got["redirects"].first().target == "http://h/a" and got["aliases"].first().target == "http://h/a"
    assert got["resources"].count() == 1
    items = archives.read_epub(archives.files(spark, str(tmp_path), "*.epub"))
    assert [r.member for r in items.collect()] == ["o/a.xhtml", "o/gone.css"]
    assert [r.check for r in archives.epub_rules(items).collect()] == ["manifest-item-missing"]


def test_slides(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<sld><spTree><sp><nvSpPr><cNvPr id="2"/><nvPr><ph type="title"/></nvPr></nvSpPr><spPr><xfrm><off x="1" y="2"/><ext cx="3" cy="4"/></xfrm></spPr><txBody><p><r><t>Hi</t></r></p></txBody></sp><grpSp><nvGrpSpPr><cNvPr id="3" descr="both"/></nvGrpSpPr><pic><nvPicPr><cNvPr id="4"/></nvPicPr></pic></grpSp></spTree></sld>')
    (tmp_path / "d.pptx").write_bytes(data.getvalue())
    got = archives.read_decks(archives.files(spark, str(tmp_path), "*.pptx")).orderBy("seq").collect()
    assert [(r.shape_id, r.parent_id, r.kind, r.text, r.is_title, r.w) for r in got] == [(2, None, "shape", "Hi", True, 3), (3, None, "group", "", False, 0), (4, 3, "picture", "", False, 0)]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "=1", "")], "source string, note string, other string")
    assert sidecars.write_report(rows, str(tmp_path / "r")) and not sidecars.write_report(rows.limit(0), str(tmp_path / "e"))
    back = sidecars.read_sidecar(spark, str(tmp_path / "r"), ["source", "note", "other", "absent"]).collect()
    assert [(r.source, r.note, r.other, r.absent) for r in back] == [("a", "=1", "", None)]


def test_incremental(spark):
    inputs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha string")
    cache = spark.createDataFrame([("a", "1", "", "f"), ("b", "9", "", "g"), ("c", "3", "x", "h")], "path string, sha string, options string, found string")
    assert sorted(r.path for r in incremental.work(inputs, cache).collect()) == ["b", "c"]
    assert [r.found for r in incremental.kept(inputs, cache).collect()] == ["f"]
    assert incremental.store(cache, cache.filter("path = 'b'").withColumn("found", F.lit("new"))).count() == 3


@pytest.mark.parametrize("name", ["page_facts"])
def test_stream_of_files(spark, tmp_path, name):
    source = spark.createDataFrame([("u", "<html><title>t</title>")], "url string, html string")
    source.write.parquet(str(tmp_path / "in"))
    done = incremental.watch(spark, str(tmp_path / "in"), "url string, html string", lambda df: page_rules.check_pages(read_pages(df)), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination(120)
    assert [r.check for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["no-lang"]
