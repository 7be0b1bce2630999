"""Text and markup put right, in Arrow batches: spelled-out letters, empty header cells, heads that hold the body, spans to leave alone, selections."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say a letter's type before it is spelled out.
FONT_WORDS = frozenset("normal italic bold monospace double-struck script fraktur sans-serif".split())


def unspell(text: str) -> str:
    """Letters that stand alone joined to words; "upper" and "lower" begin one with the next letter in that case."""
    tokens, out, word = text.split(), [], ""
    letter = lambda k: k < len(tokens) and re.fullmatch("[A-Za-z]", tokens[k]) is not None
    at = 0
    while at < len(tokens):
        now = tokens[at]
        if now.lower() in FONT_WORDS and (letter(at + 1) or tokens[at + 1 : at + 2] in (["upper"], ["lower"])):
            at += 1
            continue
        cased = now in ("upper", "lower") and letter(at + 1)
        if word and (cased or not letter(at)):
            out.append(word)
            word = ""
        if cased:
            word = getattr(tokens[at + 1], now)()
        elif letter(at):
            word += now
        else:
            out.append(now)
        at += 2 if cased else 1
    return " ".join(out + [word] * bool(word))


_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_TH = re.compile(rf"(?i)<th\b({_ATTRS})>((?:\s|\xa0|&nbsp;|&#160;|&#x0*a0;)*)</th\s*>")
_OF_HEADERS = re.compile(r"""(?i)\s+(?:scope|abbr)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")


def empty_as_data(markup: str) -> str:
    """Header cells without text as data cells, the white space in them kept."""
    return _TH.sub(lambda m: f"<td{_OF_HEADERS.sub('', m[1])}>{m[2]}</td>", markup)


_THEAD = re.compile(rf"(?is)(<thead\b{_ATTRS}>)((?:(?!</thead\s*>).)*)(</thead\s*>)(?=\s*</table\s*>)")
_CELL = re.compile(rf"(?i)<(td|th)\b{_ATTRS}>")
_SHOWS = re.compile(r"(?i)<(?:img|math|svg|object|embed|video|audio|iframe|canvas|input)\b")


def body_out_of_head(markup: str) -> str:
    """Tables that end with their head get a body of its rows from the first with a filled data cell on."""

    def filled(row: str) -> bool:
        cells = [*_CELL.finditer(row)]
        ends = [c.start() for c in cells[1:]] + [len(row)]
        inner = [row[c.end() : e] for c, e in zip(cells, ends, strict=True) if c[1].lower() == "td"]
        return any(_SHOWS.search(x) or html.unescape(re.sub("<[^<>]*>", "", x)).strip() for x in inner)

    def divided(m: re.Match) -> str:
        opening, inside, closing = m.groups()
        if re.search(r"(?i)<table\b", inside):
            return m[0]
        places = [x.start() for x in re.finditer(r"(?i)<tr\b", inside)]
        rows = [inside[a:b] for a, b in zip(places, [*places[1:], len(inside)], strict=True)]
        first = next((i for i, row in enumerate(rows) if filled(row)), None)
        if first is None:
            return m[0]
        if first == 0:
            return "<tbody" + opening[6:] + inside + "</tbody>"
        return opening + inside[: places[first]] + closing + "<tbody>" + inside[places[first] :] + "</tbody>"

    return _THEAD.sub(divided, markup)


_SKIPPED = re.compile(
    r"""(?s)\\begin\{(?P<env>verbatim\*?|Verbatim|lstlisting|minted|comment)\}.*?(?:\\end\{(?P=env)\}|\Z)|\\(?:verb|Verb)\*?(?P<mark>[^\sA-Za-z*])[^\n]*?(?P=mark)"""
    r"""|\\lstinline(?:\[[^\]\n]*\])?(?:\{[^\n}]*\}|(?P<code>[^\sA-Za-z{\[])[^\n]*?(?P=code))|\\(?:url|nolinkurl|path|href)\s*(?P<address>\{[^{}\n]*\})|\\.|%[^\n]*"""
)


def skip_spans(text: str) -> list[tuple[int, int]]:
    """start and end of what no rewrite of LaTeX may touch: comments, verbatim text, code within a line, addresses."""
    out = []
    for m in _SKIPPED.finditer(text):
        if m["address"]:
            out.append(m.span("address"))
        elif m[0][0] == "%" or m["env"] or m["mark"] or m["code"] or m[0].startswith("\\lstinline"):
            out.append(m.span())
    return out


# Characters of equations and what they mean, in order; the first list holds within text too.
LOOKALIKES = [("\u00b5", "\u03bc"), ("\u2206", "\u0394")]
COMMANDS = [("\\overset{\u00af}{", "\\bar{"), ("\\overset{\u2013}{", "\\bar{"), ("\u0177", "\\hat{y}"), ("\u0176", "\\hat{Y}"), ("_{\u00d8}", "_{0}"), ("\u00b7", "\\cdot ")]
DASH, MINUS = "\u2013", "\u2212"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff"
#: A dash between two letters (a bond), two digits (a range) or beside another dash stays one.
_SIGN = re.compile(f"(?<!{DASH}){DASH}(?!{DASH})")


def _text_signs(body: str) -> str:
    def sign(m: re.Match) -> str:
        a, b = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
        alike = any(re.fullmatch(f"[{k}]", a) and re.fullmatch(f"[{k}]", b) for k in (_LETTER, "0-9"))
        return DASH if alike else MINUS

    return _SIGN.sub(sign, body)


def repair_tex(tex: str) -> str:
    """An equation with look-alikes as the characters they mean and dashes as signs, its own text by the rules of text.

    A text that is one dash is the sign itself; one set over or under something as its mark stays.
    """
    for old, new in LOOKALIKES:
        tex = tex.replace(old, new)
    out, at = [], 0

    def maths(part: str) -> str:
        for old, new in COMMANDS:
            part = part.replace(old, new)
        return part.replace(DASH, "-")

    for m in re.finditer(r"\\text\{", tex):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while end < len(tex) and depth:
            depth += {"{": 1, "}": -1}.get(tex[end], 0)
            end += 1
        if depth:
            break
        body = tex[m.end() : end - 1]
        mark = re.search(r"\\(?:under|over)set\{$", tex[: m.start()])
        out.append(maths(tex[at : m.start()]))
        if not mark and re.sub(r"\\ |[ ~\u00a0]", "", body) == DASH:
            out.append("-")
        else:
            out.append(f"\\text{{{body if mark else _text_signs(body)}}}")
        at = end
    return "".join(out) + maths(tex[at:])


_OPENS = r"(?<![^\s(\[{=<>\u2264\u2265\u2260+\u00d7\u00f7*/,;:])"
_OPERAND = r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]|\)"
_RELATION = re.compile(r"[=<>\u2264\u2265\u2260\u2248]|\bequals?\b")


def minus_in_text(text: str) -> str:
    """Dashes that are signs in running text: before a number that stands at the start or after a sign, and between operands of an equation.

    A clause counts as an equation if it has a relation; ranges (5\u20139) and dashes between words stay.
    """

    def clause(part: str) -> str:
        part = re.sub(rf"{_OPENS}{DASH}(?=[0-9]|\.[0-9])", MINUS, part)
        if _RELATION.search(part):
            part = re.sub(rf"((?:(?<![A-Za-z0-9])|(?<=[0-9]))(?:{_OPERAND}))( ?){DASH}( ?)(?=(?:[0-9]+|[A-Za-z](?![A-Za-z])|\())", rf"\1\2{MINUS}\3", part)
        return part

    return "".join(clause(x) if i % 2 == 0 else x for i, x in enumerate(re.split(r"([;:!?]\s|\.\s)", text)))


class _Tree(HTMLParser):
    """Elements of a page with their parents and texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.elements.append({"tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "up": list(self.open), "text": []})
        if tag not in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"):
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[k]]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for k in self.open:
            self.elements[k]["text"].append(data)


def _matches(element: dict, part: str) -> bool:
    for x in re.findall(r"\[[^\]]*\]|[.#]?[^.#\[\]]+", part):
        if x[0] == ".":
            ok = x[1:] in element["attrs"].get("class", "").split()
        elif x[0] == "#":
            ok = element["attrs"].get("id") == x[1:]
        elif x[0] == "[":
            name, sign, value = x[1:-1].partition("=")
            got = element["attrs"].get(name.strip())
            ok = got is not None and (not sign or got == value.strip("\"'"))
        else:
            ok = x == "*" or element["tag"] == x.lower()
        if not ok:
            return False
    return True


def selected(markup: str, selector: str) -> list[str]:
    """Texts of the elements that a selector of tags, .classes, #ids and [attributes] names; a space goes down to any depth."""
    tree, parts = _Tree(), selector.split()
    tree.feed(markup)
    tree.close()
    out = []
    for e in tree.elements:
        if _matches(e, parts[-1]):
            left = parts[:-1]
            for k in reversed(e["up"]):
                if left and _matches(tree.elements[k], left[-1]):
                    left = left[:-1]
            if not left:
                out.append(" ".join("".join(e["text"]).split()))
    return out


def mapped(column: Column | str, one: Callable, kind: str) -> Column:
    """A column by a function of one text, in Arrow batches; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return run(column)


def unspelled(column: Column | str) -> Column:
    return mapped(column, unspell, "string")


def equations_repaired(column: Column | str) -> Column:
    return mapped(column, repair_tex, "string")


def minus_signs(column: Column | str) -> Column:
    return mapped(column, minus_in_text, "string")


def headers_as_data(column: Column | str) -> Column:
    return mapped(column, empty_as_data, "string")


def bodies_out_of_heads(column: Column | str) -> Column:
    return mapped(column, body_out_of_head, "string")


def spans_to_skip(column: Column | str) -> Column:
    return mapped(column, lambda v: [{"start": a, "end": b} for a, b in skip_spans(v)], "array<struct<start:int,end:int>>")


def select(column: Column | str, selector: str) -> Column:
    return mapped(column, lambda v: selected(v, selector), "array<string>")
