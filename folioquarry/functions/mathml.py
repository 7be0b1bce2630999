"""Mathematics between forms: MathML and chemistry as TeX, drawn formulas as the MathML or TeX that they carry."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from pyspark.sql import Column

from folioquarry.functions.repairs import mapped

# Characters that TeX writes as commands.
SYMBOLS = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\varepsilon", "ϵ": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta", "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "ξ": "\\xi", "π": "\\pi",
    "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "υ": "\\upsilon", "φ": "\\varphi", "ϕ": "\\phi", "χ": "\\chi", "ψ": "\\psi", "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda", "Ξ": "\\Xi", "Π": "\\Pi", "Σ": "\\Sigma",
    "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega", "×": "\\times", "÷": "\\div", "·": "\\cdot", "⋅": "\\cdot", "±": "\\pm", "∓": "\\mp", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "∼": "\\sim", "∝": "\\propto", "∞": "\\infty",
    "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∮": "\\oint", "∂": "\\partial", "∇": "\\nabla", "√": "\\surd", "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊆": "\\subseteq", "∪": "\\cup", "∩": "\\cap", "∅": "\\emptyset", "∀": "\\forall", "∃": "\\exists",
    "→": "\\rightarrow", "←": "\\leftarrow", "↔": "\\leftrightarrow", "⇒": "\\Rightarrow", "⇔": "\\Leftrightarrow", "⇌": "\\rightleftharpoons", "…": "\\ldots", "⋯": "\\cdots", "°": "{^\\circ}", "′": "'", "−": "-", "⟨": "\\langle", "⟩": "\\rangle", "∠": "\\angle",
}
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln exp lim max min det gcd arg dim ker".split())
ACCENTS = {"¯": "\\bar", "‾": "\\overline", "^": "\\hat", "ˆ": "\\hat", "~": "\\tilde", "˜": "\\tilde", "→": "\\vec", "⃗": "\\vec", "˙": "\\dot", ".": "\\dot", "¨": "\\ddot"}
UNSEEN = frozenset("\u2061\u2062\u2063\u2064\u200b")
SPECIAL = re.compile(r"([#$%&_{}])")


def _leaf(text: str) -> str:
    return " ".join(SYMBOLS.get(c, SPECIAL.sub(r"\\\1", c)) if c not in UNSEEN else "" for c in text) if len(text) == 1 else "".join(SYMBOLS.get(c, SPECIAL.sub(r"\\\1", c)) + (" " if c in SYMBOLS and SYMBOLS[c][-1:].isalpha() else "") for c in text if c not in UNSEEN)


def _joined(parts: list[str]) -> str:
    out = ""
    for p in parts:
        if re.search(r"\\[A-Za-z]+$", out) and p[:1].isalpha():
            out += " "
        out += p
    return out


def _group(tex: str) -> str:
    return tex if len(tex) == 1 or re.fullmatch(r"\\[A-Za-z]+", tex) else "{" + tex + "}"


def _tex(e: ET.Element) -> str:
    name = e.tag.rpartition("}")[2]
    kids = [c for c in e if isinstance(c.tag, str)]
    text = " ".join((e.text or "").split())
    inner = [_tex(c) for c in kids]
    whole = lambda: _joined(inner)
    if name == "mi":
        return "\\" + text if text in FUNCTIONS else _leaf(text) if len(text) <= 1 else f"\\mathrm{{{_leaf(text)}}}"
    if name in ("mn", "mo"):
        return _leaf(text)
    if name in ("mtext", "ms"):
        return f"\\text{{{SPECIAL.sub(r'\\\1', e.text or '')}}}" if text else "\\ "
    if name == "mspace":
        return "\\ "
    if name == "mfrac":
        return ("\\binom" if e.get("linethickness") == "0" else "\\frac") + "{%s}{%s}" % tuple(inner[:2])
    if name == "msqrt":
        return f"\\sqrt{{{whole()}}}"
    if name == "mroot":
        return f"\\sqrt[{inner[1]}]{{{inner[0]}}}"
    if name in ("msub", "msup", "msubsup"):
        marks = {"msub": "_", "msup": "^", "msubsup": "_^"}[name]
        if name == "msup" and set(inner[1]) == {"'"}:
            return _group(inner[0]) + inner[1]
        return _group(inner[0]) + "".join(m + _group(x) for m, x in zip(marks, inner[1:], strict=False))
    if name in ("mover", "munder", "munderover"):
        mark = " ".join("".join(kids[-1].itertext()).split())
        if name == "mover" and mark in ACCENTS:
            return f"{ACCENTS[mark]}{{{inner[0]}}}"
        if name == "munder" and mark in ("_", "̲", "‾"):
            return f"\\underline{{{inner[0]}}}"
        marks = {"mover": "^", "munder": "_", "munderover": "_^"}[name]
        if inner[0] in ("\\sum", "\\prod", "\\int", "\\oint", "\\lim", "\\max", "\\min"):
            return inner[0] + "".join(m + _group(x) for m, x in zip(marks, inner[1:], strict=False))
        for m, x in zip(marks, inner[1:], strict=False):
            inner[0] = f"{'\\underset' if m == '_' else '\\overset'}{{{x}}}{{{inner[0]}}}"
        return inner[0]
    if name == "mfenced":
        seps = (e.get("separators", ",") or "").replace(" ", "")
        body = inner[0] if inner else ""
        for i, x in enumerate(inner[1:]):
            body += (seps[min(i, len(seps) - 1)] if seps else "") + x
        return f"\\left{_leaf(e.get('open', '('))or '.'}{body}\\right{_leaf(e.get('close', ')')) or '.'}"
    if name == "mtable":
        rows = [" & ".join(_tex(c) for c in r if isinstance(c.tag, str)) for r in kids]
        return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"
    if name == "menclose":
        return f"\\boxed{{{whole()}}}" if "box" in e.get("notation", "") else f"\\cancel{{{whole()}}}" if "strike" in e.get("notation", "") else whole()
    if name == "mphantom":
        return f"\\phantom{{{whole()}}}"
    if name == "semantics":
        return inner[0] if inner else ""
    if name in ("annotation", "annotation-xml"):
        return ""
    return whole() if kids else _leaf(text)


def tex_of(markup: str) -> str | None:
    """TeX of one math element; None for what is no XML."""
    try:
        root = ET.fromstring(re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);", "", markup))
    except ET.ParseError:
        return None
    return " ".join(_tex(root).split()) if root.tag.rpartition("}")[2] == "math" else None


ARROWS = {"<=>": "\\rightleftharpoons", "<->": "\\leftrightarrow", "->": "\\rightarrow", "<-": "\\leftarrow"}
_CE = re.compile(
    r"\s*(?:(?P<arrow><=>|<->|->|<-)(?:\[(?P<over>[^\]]*)\])?|(?P<plus>(?<=\s)\+(?=\s|$))|(?P<state>\((?:s|l|g|aq)\))|(?P<element>[A-Z][a-z]?)|(?P<open>[(\[])|(?P<close>[)\]])"
    r"|(?P<charge>\^(?:\{[^}]*\}|[0-9]*[+-]?)|[0-9]*[+-](?=\s|$|\)))|(?P<number>[0-9]+(?:[./][0-9]+)?)|(?P<electron>e\^?-)|(?P<dot>\*|\.))"
)


def ce_tex(argument: str) -> str | None:
    """TeX of a chemical formula or equation; None if something in it has no rule."""
    out, at, after = [], 0, False  # after: whether a number here counts what stands before it
    while at < len(argument.rstrip()):
        m = _CE.match(argument, at)
        if not m:
            return None
        kind, spaced = m.lastgroup if m.lastgroup != "over" else "arrow", argument[at : at + 1].isspace()
        said = m[kind]
        if kind == "arrow":
            out.append(f" \\overset{{\\text{{{m['over']}}}}}{{{ARROWS[said]}}} " if m["over"] else f" {ARROWS[said]} ")
        elif kind == "plus":
            out.append(" + ")
        elif kind == "state":
            out.append(f"\\text{{{said}}}")
        elif kind == "element":
            out.append(f"\\mathrm{{{said}}}")
        elif kind == "electron":
            out.append("\\mathrm{e}^{-}")
        elif kind == "charge":
            bare = said.lstrip("^").strip("{}")
            if after and not said.startswith("^") and len(bare) > 1:
                out.append(f"_{{{bare[:-1]}}}^{{{bare[-1]}}}")  # NO3- has three, and one charge
            else:
                out.append(f"^{{{bare}}}")
        elif kind == "number":
            out.append(f"_{{{said}}}" if after and not spaced else said + "\\,")
        elif kind == "dot":
            out.append(" \\cdot ")
        else:
            out.append(said)
        after = kind in ("element", "close") or (kind == "charge")
        at = m.end()
    tex = "".join(out).strip()
    return tex if tex in ARROWS.values() else "{" + tex + "}" if tex else None


def with_chemistry(tex: str) -> str:
    """TeX with every \\ce{...} that can be read as plain TeX."""
    return re.sub(r"\\ce\{((?:[^{}]|\{[^{}]*\})*)\}", lambda m: ce_tex(m[1]) or m[0], tex)


_DRAWN = re.compile(r"(?is)<(mjx-container|span)\b(?=[^>]*\b(?:mathjax|jax=|mjx-))[^>]*>(?:(?!</?\1\b).|<\1\b(?:(?!</?\1\b).)*</\1>)*</\1>(?:\s*<script\b[^>]*type=[\"']math/(tex|mml)[^>]*>(.*?)</script>)?")


def rebuilt(markup: str) -> str:
    """Pages whose formulas a script has drawn: each drawing as the MathML or TeX that stands with it, else a mark that it is lost."""

    def one(m: re.Match) -> str:
        inside = re.search(r"(?is)<math\b.*?</math>", m[0])
        if inside:
            return inside[0]
        if m[3] is not None:
            display = "display" if "mode=display" in m[0] else "inline"
            return m[3] if m[2].lower() == "mml" else f'<span class="math {display}">{m[3].strip()}</span>'
        return '<span class="math-lost"></span>'

    return _DRAWN.sub(one, markup)


def mathml_as_tex(column: Column | str) -> Column:
    return mapped(column, tex_of, "string")


def chemistry_as_tex(column: Column | str) -> Column:
    return mapped(column, with_chemistry, "string")


def drawings_rebuilt(column: Column | str) -> Column:
    return mapped(column, rebuilt, "string")
