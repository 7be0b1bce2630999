"""Word files: tables as grids with spans expanded, headings and paragraphs, bookmarks and links."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from folioquarry.operators.tables import GRID
from folioquarry.sources.archives import mapped

TABLES = f"path string, book string, tbl int, depth int, label string, grid {GRID}, marked boolean, style string"
BLOCKS = "path string, pos int, kind string, level int, text string"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _value(e: ET.Element | None, name: str = "val") -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _child(e: ET.Element, *path: str) -> ET.Element | None:
    for step in path:
        e = next((c for c in e if _name(c) == step), None) if e is not None else None
    return e


def _on(e: ET.Element | None) -> bool:
    return e is not None and _value(e) not in ("0", "false", "none")


def _text(e: ET.Element) -> str:
    return "".join((t.text or "") if _name(t) == "t" else " " for t in e.iter() if _name(t) in ("t", "tab", "br"))


def _cell(tc: ET.Element, number: int) -> dict:
    runs = [r for r in tc.iter() if _name(r) == "r" and _text(r).strip()]
    fill = _value(_child(tc, "tcPr", "shd"), "fill")
    return {
        "cell_id": number,
        "text": " ".join("\n".join(_text(p) for p in tc if _name(p) == "p").split()),
        "bold": bool(runs) and all(_on(_child(r, "rPr", "b")) for r in runs),
        "shaded": fill not in (None, "auto", "FFFFFF"),
        "image": any(_name(x) in ("drawing", "pict") for x in tc.iter()),
    }


def grid_of(tbl: ET.Element) -> tuple[list[list[dict]], bool]:
    """Rows of cells, one cell object repeated over its span and its vertical merge; whether row 1 repeats as a heading."""
    rows, above, number, marked = [], {}, 0, False
    for i, tr in enumerate(x for x in tbl if _name(x) == "tr"):
        marked |= i == 0 and _on(_child(tr, "trPr", "tblHeader"))
        row: list[dict] = []
        for tc in (x for x in tr if _name(x) == "tc"):
            span = int(_value(_child(tc, "tcPr", "gridSpan")) or 1)
            merge = _child(tc, "tcPr", "vMerge")
            if merge is not None and _value(merge) != "restart" and len(row) in above:
                cell = above[len(row)]
            else:
                cell = _cell(tc, number)
                number += 1
            for _ in range(span):
                above[len(row)] = cell
                row.append(cell)
        rows.append(row)
    return rows, marked


def _body(content: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _child(ET.fromstring(z.read("word/document.xml")), "body")


def _below(after: list[ET.Element]) -> str:
    """The first paragraph with text before any table, unless the next element is a table, whose label it then is."""
    for k, e in enumerate(after):
        if _name(e) == "tbl":
            return ""
        if _name(e) == "p" and (text := " ".join(_text(e).split())):
            return "" if k + 1 < len(after) and _name(after[k + 1]) == "tbl" else text
    return ""


def tables_of(path: str, content: bytes, root: str = "") -> list[tuple]:
    """Every table with its depth, outer first, and its label: the paragraph above, else that below unless a table follows it."""
    out: list[tuple] = []
    book = path.removeprefix(root).lstrip("/").split("/")[0]
    todo = [(_body(content), 0)]
    while todo:
        parent, depth = todo.pop(0)
        before, inner, elements = "", [], list(parent)
        for at, e in enumerate(elements):
            if _name(e) == "p":
                before = " ".join(_text(e).split()) or before
            elif _name(e) == "tbl":
                grid, marked = grid_of(e)
                out.append((path, book, len(out) + 1, depth, before or _below(elements[at + 1 :]), grid, marked, _value(_child(e, "tblPr", "tblStyle"))))
                inner += [(tc, depth + 1) for tc in e.iter() if _name(tc) == "tc" and any(_name(x) == "tbl" for x in tc)]
                before = ""
        todo = inner + todo
    return out


def blocks_of(path: str, content: bytes) -> list[tuple]:
    """Paragraphs, headings (level from their style) and tables of the body in order."""
    out = []
    for e in _body(content):
        if _name(e) == "p":
            style = (_value(_child(e, "pPr", "pStyle")) or "").lower()
            level = int(style.removeprefix("heading")) if style.startswith("heading") and style[7:].isdigit() else None
            out.append((path, len(out), "heading" if level else "para", level, " ".join(_text(e).split())))
        elif _name(e) == "tbl":
            out.append((path, len(out), "table", None, ""))
    return out


def read_tables(rows: DataFrame, root: str = "") -> DataFrame:
    return mapped(rows, lambda p, c: tables_of(p, c, root), TABLES)


def read_blocks(rows: DataFrame) -> DataFrame:
    return mapped(rows, blocks_of, BLOCKS)
