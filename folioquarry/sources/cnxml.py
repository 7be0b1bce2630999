"""CNXML modules to pages: one table of elements, walked once a module, in batches."""

from __future__ import annotations

import html
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that become one of the page's, with a class where the name would be lost.
PLAIN = {
    "para": ("p", ""), "quote": ("blockquote", ""), "preformat": ("pre", ""), "code": ("code", ""), "term": ("dfn", ""), "sub": ("sub", ""), "sup": ("sup", ""), "foreign": ("span", "foreign"), "span": ("span", ""), "div": ("div", ""),
    "cite": ("cite", ""), "cite-title": ("cite", "title"), "note": ("aside", "note"), "example": ("section", "example"), "exercise": ("section", "exercise"), "problem": ("div", "problem"), "solution": ("div", "solution"),
    "commentary": ("div", "commentary"), "rule": ("section", "rule"), "statement": ("div", "statement"), "proof": ("div", "proof"), "definition": ("div", "definition"), "meaning": ("div", "meaning"), "figure": ("figure", ""),
    "subfigure": ("figure", "subfigure"), "caption": ("figcaption", ""), "equation": ("div", "equation"), "label": ("span", "label"), "media": ("span", "media"), "item": ("li", ""), "iframe": ("iframe", ""),
}
EFFECTS = {"bold": "strong", "italics": "em", "italic": "em", "underline": "u", "smallcaps": "span", "normal": "span"}
#: What stands in a heading's place at the start of its parent.
TITLED = ("section", "note", "example", "exercise", "problem", "solution", "rule", "list", "quote", "para", "table", "figure", "definition", "proof", "commentary")
MATH = "{http://www.w3.org/1998/Math/MathML}"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


class Unread(ValueError):
    """An element that no rule reads."""


class Writer:
    """One module's page: body(), and the footnotes that go to its end."""

    def __init__(self, lenient: bool = False):
        self.notes: list[str] = []
        self.lenient = lenient

    def tag(self, name: str, inside: str, e: ET.Element | None = None, kind: str = "", **more: str) -> str:
        attrs = {"id": e.get("id", "") if e is not None else "", "class": " ".join(x for x in (kind, e.get("class", "") if e is not None else "") if x), **{k.replace("_", "-"): v for k, v in more.items()}}
        return f"<{name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in attrs.items() if v) + f">{inside}</{name}>"

    def inside(self, e: ET.Element, depth: int, skip: tuple[str, ...] = ()) -> str:
        parts = [html.escape(e.text or "", quote=False)]
        for c in e:
            if _name(c) not in skip:
                parts.append(self.one(c, depth))
            parts.append(html.escape(c.tail or "", quote=False))
        return "".join(parts)

    def title(self, e: ET.Element, level: str) -> str:
        found = next((c for c in e if _name(c) == "title"), None)
        return self.tag(level, self.inside(found, 0), found) if found is not None and _name(e) in TITLED else ""

    def one(self, e: ET.Element, depth: int) -> str:
        name = _name(e)
        own = getattr(self, "do_" + name.replace("-", "_"), None)
        if isinstance(e.tag, str) and e.tag.startswith(MATH):
            return self.math(e)
        if own:
            return own(e, depth)
        if name in PLAIN:
            element, kind = PLAIN[name]
            level = "strong" if name == "para" else f"h{min(depth + 1, 6)}"
            return self.tag(element, self.title(e, level) + self.inside(e, depth, ("title",)), e, kind)
        if not name:  # a comment or an instruction
            return ""
        if self.lenient:
            return self.inside(e, depth)
        raise Unread(f"no rule reads the element {name}")

    def math(self, e: ET.Element) -> str:
        names = " ".join(f'{k.rpartition("}")[2]}="{html.escape(v)}"' for k, v in e.attrib.items())
        inner = html.escape((e.text or "").strip(), quote=False) + "".join(self.math(c) + html.escape((c.tail or "").strip(), quote=False) for c in e if isinstance(c.tag, str))
        return f"<{_name(e)}{' ' + names if names else ''}>{inner}</{_name(e)}>"

    def do_section(self, e, depth):
        return self.tag("section", self.title(e, f"h{min(depth + 1, 6)}") + self.inside(e, depth + 1, ("title",)), e)

    def do_title(self, e, depth):
        return self.tag("strong", self.inside(e, depth), e)

    def do_emphasis(self, e, depth):
        effect = e.get("effect", "bold")
        return self.tag(EFFECTS.get(effect, "em"), self.inside(e, depth), e, effect if EFFECTS.get(effect) == "span" else "")

    def do_list(self, e, depth):
        kind = e.get("list-type", "bulleted")
        element = "ol" if kind == "enumerated" else "ul"
        more = {"start": e.get("start-value", ""), "type": {"lower-alpha": "a", "upper-alpha": "A", "lower-roman": "i", "upper-roman": "I"}.get(e.get("number-style", ""), "")} if element == "ol" else {}
        return self.title(e, "div") + self.tag(element, "".join(self.one(c, depth) for c in e if _name(c) == "item"), e, "labeled" if kind == "labeled-item" else "", **more)

    def do_newline(self, e, depth):
        return "<br>" * int(e.get("count", "1"))

    def do_space(self, e, depth):
        return "\xa0" * int(e.get("count", "1"))

    def do_footnote(self, e, depth):
        self.notes.append(self.inside(e, depth))
        n = len(self.notes)
        return f'<sup id="fnref{n}"><a href="#fn{n}">{n}</a></sup>'

    def do_link(self, e, depth):
        target = e.get("url") or (e.get("document", "") + (".html" if e.get("document") else "") + ("#" + e.get("target-id") if e.get("target-id") else "")) or e.get("resource", "")
        return self.tag("a", self.inside(e, depth) or "[link]", e, href=target)

    def do_image(self, e, depth):
        return f'<img src="{html.escape(e.get("src", ""))}" alt="{html.escape(self.alt)}">'

    def do_media(self, e, depth):
        self.alt = e.get("alt", "")
        return self.tag("span", self.inside(e, depth), e, "media")

    def do_figure(self, e, depth):
        caption = "".join(self.one(c, depth) for c in e if _name(c) == "caption")
        return self.tag("figure", self.title(e, "div") + self.inside(e, depth, ("title", "caption")) + caption, e)

    def do_table(self, e, depth):
        rows, columns = {"thead": [], "tbody": [], "tfoot": []}, {}
        for c in e.iter():
            if _name(c) == "colspec" and c.get("colname"):
                columns[c.get("colname")] = int(c.get("colnum", len(columns) + 1))
        for part in (x for x in e.iter() if _name(x) in rows):
            for row in (x for x in part if _name(x) == "row"):
                cells = ""
                for entry in (x for x in row if _name(x) == "entry"):
                    across = columns.get(entry.get("nameend"), 0) - columns.get(entry.get("namest"), 0) + 1 if entry.get("namest") else 1
                    down = int(entry.get("morerows", "0")) + 1
                    cells += self.tag("th" if _name(part) == "thead" else "td", self.inside(entry, depth), entry, colspan=str(across) if across > 1 else "", rowspan=str(down) if down > 1 else "")
                rows[_name(part)].append(f"<tr>{cells}</tr>")
        title = next((self.inside(c, depth) for c in e if _name(c) in ("title", "caption")), "")
        body = "".join(f"<{k}>{''.join(v)}</{k}>" for k, v in rows.items() if v)
        return self.tag("table", (f"<caption>{title}</caption>" if title else "") + body, e)

    def do_iframe(self, e, depth):
        return f'<iframe src="{html.escape(e.get("src", ""))}"></iframe>'

    alt = ""


def convert(content: bytes, lenient: bool = False) -> dict:
    """id, title and html of a module; what cannot be read says why."""
    try:
        if b"<!ENTITY" in content[:20000]:
            raise Unread("entities are not read")
        root = ET.fromstring(content)
        writer = Writer(lenient)
        title = next((" ".join("".join(c.itertext()).split()) for c in root if _name(c) == "title"), None)
        body = "".join(writer.inside(c, 1).strip() for c in root if _name(c) == "content")
        words = "".join(writer.one(d, 1) for c in root if _name(c) == "glossary" for d in c)
        notes = "".join(f'<li id="fn{i}">{n}</li>' for i, n in enumerate(writer.notes, 1))
        page = body + (f'<section class="glossary">{words}</section>' if words else "") + (f"<ol class=\"footnotes\">{notes}</ol>" if notes else "")
        return {"module": root.get("id"), "title": title, "html": page, "problem": None}
    except (ET.ParseError, Unread) as e:
        return {"module": None, "title": None, "html": None, "problem": str(e)}


def read_modules(rows: DataFrame, content: str = "content", lenient: bool = False) -> DataFrame:
    """path, module, title, html and problem of module files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p} | convert(bytes(c or b""), lenient) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "module", "title", "html", "problem"])

    return rows.select(F.col("path").cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "path string, module string, title string, html string, problem string")
