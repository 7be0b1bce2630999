"""Word files, front matter, includes, code pages and reports."""

import io
import json
import zipfile

from folioquarry.operators import tables
from folioquarry.sources import archives, markup, word


def test_word_tables(spark, tmp_path):
    run = lambda t, b=False: f"<r>{'<rPr><b/></rPr>' if b else ''}<t>{t}</t></r>"
    cell = lambda t, b=False, pr="": f"<tc><tcPr>{pr}</tcPr><p>{run(t, b)}</p></tc>"
    body = f"<p><pPr><pStyle val='Heading2'/></pPr>{run('Data')}</p><p>{run('Table 1')}</p><tbl><tr>{cell('A', True)}{cell('B', True)}</tr><tr>{cell('wide', False, '<gridSpan val=\"2\"/>')}</tr><tr>{cell('x')}{cell('1')}</tr></tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<document><body>{body}</body></document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    raw = archives.files(spark, str(tmp_path), "*.docx")
    got = tables.classify(word.read_tables(raw)).first()
    assert (got.kind, got.label, got.n_rows, got.n_columns) == ("first-row", "Table 1", 3, 2)
    assert got.grid[1][0].cell_id == got.grid[1][1].cell_id
    assert [(r.kind, r.level) for r in word.read_blocks(raw).orderBy("pos").collect()] == [("heading", 2), ("para", None), ("table", None)]


def test_plain_sources(spark):
    rows = spark.createDataFrame([("a", "---\ntitle: \"T x\"\nnav_order: 3\n---\nbody"), ("b", "no front")], "file string, value string")
    got = {r.file: (r.meta, r.body) for r in markup.front_matter(rows).collect()}
    assert got == {"a": ({"title": "T x", "nav_order": "3"}, "body"), "b": ({}, "no front")}
    tex = spark.createDataFrame([("m.tex", "\\documentclass{book}\n\\begin{document}\n\\include{ch1} % \\input{no}\n\\input{ch2.tex}\n")], "file string, value string")
    assert [(r.includes, r.seq) for r in markup.includes(tex).orderBy("seq").collect()] == [("ch1.tex", 0), ("ch2.tex", 1)]
    assert tex.filter(markup.is_master()).count() == 1
    assert markup.repaired("é\n".encode() + "naïve".encode("cp1252")) == "é\nnaïve"
    assert markup.repaired("“x” café".encode("mac_roman")) == "“x” café"
    report = spark.createDataFrame([(json.dumps({"url": "u", "violations": [{"id": "r", "help": "h", "nodes": [{"html": "a"}, {"html": "b"}]}]}),)], "value string")
    assert [tuple(r) for r in markup.rule_report(report).collect()] == [("u", "axe:r", "h (2)")]
