"""Documents kept as JSON trees (kind "t", content "c") to facts: one walk a document, in batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = """name string, kind string, title boolean, lang boolean, text string, ids array<string>, media array<string>, headings array<struct<level:int,text:string>>,
links array<struct<target:string,label:string,named:boolean>>, images array<struct<src:string,alt:string,decorative:boolean,is_caption:boolean>>,
tables array<struct<rows:int,columns:int,has_header:boolean,has_caption:boolean,marked:boolean,keyed:boolean,cells:array<array<string>>>>,
raw_html array<string>, formulas array<string>, parse_error string"""
_COLUMNS = [c.split()[0] for c in FACTS.replace("\n", " ").replace(", ", "\0").split("\0")]
#: Elements whose text is a space or nothing, and those that say it as a string of their own.
SPACES = ("Space", "SoftBreak", "LineBreak")


def text_of(node) -> str:
    """The text of any part of a tree."""
    if isinstance(node, list):
        return "".join(map(text_of, node))
    if not isinstance(node, dict):
        return ""
    kind, content = node.get("t"), node.get("c")
    if kind in SPACES:
        return " "
    if kind == "Str":
        return content
    if kind in ("Code", "CodeBlock", "Math"):
        return content[1]
    if kind == "Quoted":
        return "“" + text_of(content[1]) + "”" if content[0].get("t") == "DoubleQuote" else "‘" + text_of(content[1]) + "’"
    if kind in ("Note", "RawInline", "RawBlock"):
        return ""
    if kind in ("Para", "Plain", "Header", "LineBlock"):
        return text_of(content if kind != "Header" else content[2]) + " "
    return text_of(content)


def _words(node) -> str:
    return " ".join(text_of(node).split())


def grid_of(table: list) -> tuple[list[list[str]], int]:
    """Texts of a table's cells by grid place, spans filled with their cell's text, and how many rows are its head."""
    head, bodies, foot = table[3], table[4], table[5]
    rows = [*head[1], *[r for b in bodies for r in (*b[2], *b[3])], *foot[1]]
    grid: list[list[str]] = []
    taken: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        line: list[str] = []
        cells = iter(row[1])
        while True:
            if (i, len(line)) in taken:
                line.append(taken.pop((i, len(line))))
                continue
            cell = next(cells, None)
            if cell is None:
                break
            text, down, across = _words(cell[4]), cell[2], cell[3]
            for k in range(across):
                for below in range(1, down):
                    taken[i + below, len(line) + k] = text
            line += [text] * across
        grid.append(line)
    return grid, len(head[1])


def facts_of(name: str, source: str | None, markers: tuple[str, ...] = ("matrix", "row-headers"), kind: str = "") -> dict:
    out: dict = {c: [] for c in _COLUMNS} | {"name": name, "kind": kind, "title": False, "lang": False, "text": "", "parse_error": None}
    try:
        tree = json.loads(source or "{}")
        blocks = tree.get("blocks", [])
    except (ValueError, AttributeError) as e:
        return out | {"parse_error": str(e)}
    out["title"], out["lang"] = "title" in tree.get("meta", {}), "lang" in tree.get("meta", {})
    out["text"] = _words(blocks)

    def attr(a: list) -> None:
        if a and a[0]:
            out["ids"].append(a[0])

    def walk(node, marked: bool, caption: str | None) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x, marked, caption)
            return
        if not isinstance(node, dict):
            return
        t, c = node.get("t"), node.get("c")
        if t == "Header":
            attr(c[1])
            out["headings"].append({"level": c[0], "text": _words(c[2])})
            walk(c[2], False, caption)
        elif t in ("Div", "Span"):
            attr(c[0])
            for x in c[1]:
                direct = t == "Div" and isinstance(x, dict) and x.get("t") == "Table" and any(k in markers for k in c[0][1])
                walk(x, direct, caption)
        elif t == "Link":
            attr(c[0])
            out["links"].append({"target": c[2][0], "label": text_of(c[1]).strip(), "named": "aria-label" in dict(c[0][2])})
            walk(c[1], False, caption)
        elif t == "Image":
            attr(c[0])
            alt = text_of(c[1]).strip()
            out["media"].append(c[2][0])
            out["images"].append({"src": c[2][0], "alt": alt, "decorative": "decorative" in c[0][1], "is_caption": bool(caption) and " ".join(alt.split()) == caption})
        elif t == "Figure":
            attr(c[0])
            walk(c[1][1], False, caption)
            walk(c[2], False, _words(c[1][1]) or None)
        elif t == "Table":
            attr(c[0])
            grid, head = grid_of(c)
            first = [r[0] if r else "" for r in grid[head:]]
            out["tables"].append({
                "rows": len(grid), "columns": max(map(len, grid), default=0), "has_header": head > 0 or any(b[2] for b in c[4]), "has_caption": bool(c[1][0] or c[1][1]),
                "marked": marked, "keyed": len(first) > 1 and all(first) and len(set(first)) == len(first), "cells": grid,
            })
            walk(c[1:], False, caption)
        elif t == "RawBlock":
            if c[0] in ("html", "html5"):
                out["raw_html"].append(c[1].strip().split("\n", 1)[0][:60])  # the report shows a line's beginning
        elif t == "Math":
            out["formulas"].append(c[1])
        elif t in ("Code", "CodeBlock"):
            attr(c[0])
        else:
            walk(c, False, caption)

    try:
        walk(blocks, False, None)
    except (IndexError, KeyError, TypeError, AttributeError) as e:
        out["parse_error"] = f"{type(e).__name__}: {e}"
    return out


def read_trees(docs: DataFrame, name_col: str, json_col: str, kind: str = "source-md") -> DataFrame:
    """Facts of every document; a null one has none, and what cannot be read says why."""
    rows = docs.select(F.col(name_col).cast("string").alias("name"), F.col(json_col).cast("string").alias("json"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([facts_of(n, j, kind=kind) for n, j in zip(batch["name"], batch["json"], strict=True)], columns=_COLUMNS)

    return rows.mapInPandas(run, FACTS)
