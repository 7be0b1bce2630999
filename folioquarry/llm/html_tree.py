"""Operator 10: main text of web pages by a tree-structured graphical model.

Every element that is no inline one is a node with a hidden state, main text or not.  Node potentials come from
tag, class words, link share, lengths and place; parent-child potentials tie neighbours.  Exact sum-product
messages go up and down the trees of a whole batch at once, and the marginals decide.  The model is trained from
labelled pages that ``labelled_pages`` makes by rule.

Defined results: a null or empty page gives the empty text; broken or cut markup is read as far as it goes;
pages that repeat give equal texts; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import over_texts

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var output ruby rt rp".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option button textarea title datalist".split())
#: What a start tag closes if it is open: (elements closed, elements that stop the search).
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
SLOTS = 2048


class Page:
    """Tree of one page: tag, parent, depth and attribute text of each node, its blocks (node, text), text and link lengths."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.attrs = ["#root"], [-1], [0], [""]
        self.length, self.linked, self.stops = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._pending: list[str] = []
        self._open: dict[str, int] = {}
        self._hidden = 0
        self._read(source or "")

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # name and the node that text inside belongs to
        at, lone, quotes = 0, False, True
        while at < len(s):
            i = s.find("<", at)
            if i < 0:
                i = len(s)
            if i > at and not self._hidden:
                self._text(stack[-1][1], s[at:i])
            if i == len(s):
                break
            if s.startswith("<!--", i):
                j = -1 if lone else s.find("-->", i + 4)
                lone = lone or j < 0  # a comment that never ends: the rest is its text
                at = len(s) if j < 0 else j + 3
                continue
            m = _TAG.match(s, i) if quotes else None
            if m is None:
                j = s.find(">", i)
                if i + 1 < len(s) and (s[i + 1] in "!?/" or s[i + 1].isalpha()):
                    quotes = quotes and not s[i + 1].isalpha()  # a quote that never ends
                    plain = _NAME.match(s, i)
                    if j < 0:
                        break  # cut within a tag
                    at = j + 1
                    if not plain:
                        continue
                    closing, name, rest = plain[1], plain[2].lower(), s[plain.end() : j]
                else:
                    if not self._hidden:
                        self._text(stack[-1][1], "<")
                    at = i + 1
                    continue
            else:
                closing, name, rest = m[1], m[2].lower(), m[3]
                at = m.end()
            if closing:
                if name == "br":
                    self._pending.append(" ")
                for k in range(len(stack) - 1, 0, -1) if self._open.get(name) else ():
                    if stack[k][0] == name:
                        self._pop(stack, k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
            elif name in VOID:
                if name == "hr":
                    self._flush(stack[-1][1])
                else:
                    self._pending.append(" " if name in ("br", "wbr", "img", "input") else "")
            else:
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(s, at)
                    at = end.end() if end else len(s)
                    continue
                if name in _P_ENDS:
                    self._close(stack, {"p"}, {"table", "td", "button"})
                if name in _CLOSES:
                    self._close(stack, *_CLOSES[name])
                if name in INLINE:
                    self._push(stack, name, stack[-1][1])
                else:
                    self._flush(stack[-1][1])
                    self._push(stack, name, self._node(name, stack[-1][1], rest))
        self._flush(stack[-1][1])

    def _node(self, name: str, parent: int, rest: str) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.attrs.append(" ".join(f"{k.lower()}:{(v or '').strip(chr(34) + chr(39))}" for k, v in _ATTR.findall(rest)) if rest.strip() else "")
        self.length.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.tag) - 1

    def _text(self, node: int, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self._pending.append(text)
        n = len(text) - text.count(" ")
        self.length[node] += n
        self.linked[node] += n if self._open.get("a") else 0
        self.stops[node] += text.count(".") + text.count(",")

    def _flush(self, node: int) -> None:
        if self._pending:
            text = " ".join("".join(self._pending).split())
            self._pending = []
            if text:
                self.blocks.append((node, text))

    def _push(self, stack: list, name: str, node: int) -> None:
        stack.append((name, node))
        self._open[name] = self._open.get(name, 0) + 1
        self._hidden += name in HIDDEN

    def _pop(self, stack: list, k: int) -> None:
        if any(name not in INLINE for name, _ in stack[k:]):
            self._flush(stack[-1][1])
        for name, _ in stack[k:]:
            self._open[name] -= 1
            self._hidden -= name in HIDDEN
        del stack[k:]

    def _close(self, stack: list, names: set, stops: set) -> None:
        for k in range(len(stack) - 1, 0, -1) if any(self._open.get(x) for x in names) else ():
            if stack[k][0] in names:
                self._pop(stack, k)
                return
            if stack[k][0] in stops:
                return


def features(page: Page) -> list[list[int]]:
    """Numbers of each node's features: tag, attribute words, sizes of its own and all text below, link share, place."""
    n = len(page.tag)
    below, linked, stops = list(page.length), list(page.linked), list(page.stops)
    children = [0] * n
    rank = [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        below[p] += below[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    for i in range(1, n):
        rank[i] = children[page.parent[i]]
        children[page.parent[i]] += 1
    total = max(below[0], 1)
    out = []
    for i in range(n):
        size, tag = below[i], page.tag[i]
        share = 0 if not linked[i] else 1 + min(3, int(4 * linked[i] / max(size, 1)))
        names = [
            "bias",
            f"tag {tag}",
            f"parent {page.tag[page.parent[i]] if i else ''}",
            f"links {share}",
            f"size {min(8, size.bit_length() // 2)}",
            f"part {min(4, int(5 * size / total))}",
            f"stops {min(4, int(40 * stops[i] / max(size, 1)))}",
            f"own {min(8, page.length[i].bit_length() // 2)}",
            f"tag size {tag} {min(8, size.bit_length() // 2)}",
        ]
        if page.attrs[i]:
            names += [f"word {w}" for w in sorted(set(re.findall(r"[a-z]{2,}", re.sub(r"([a-z])([A-Z])", r"\1 \2", page.attrs[i]).lower())))]
        out.append([zlib.crc32(x.encode()) % SLOTS for x in names])
    return out


@dataclass
class TreeModel:
    """weights: log odds of main text by feature; pair: score of (parent state, child state); root: score of the root's states."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, pages: list[Page], rows: list[list[list[int]]] | None = None) -> list[np.ndarray]:
        """Chance of main text of every node of every page."""
        rows = rows or [features(p) for p in pages]
        forest = Forest(pages)
        p = np.exp(forest.infer(self._node_scores(rows), self.pair)[0])[:, 1]
        return np.split(p, np.cumsum([len(x.tag) for x in pages])[:-1])

    def _node_scores(self, rows: list[list[list[int]]]) -> np.ndarray:
        return np.stack([np.zeros(sum(map(len, rows))), _sums(self.weights, rows)], 1)


def _sums(weights: np.ndarray, rows: list[list[list[int]]]) -> np.ndarray:
    flat = [f for page in rows for f in page]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    every = np.fromiter((x for f in flat for x in f), np.int64, int(sizes.sum()))
    return np.add.reduceat(weights[every], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


class Forest:
    """Nodes of many pages with their levels, for messages of a whole level at once."""

    def __init__(self, pages: list[Page]):
        base = np.cumsum([0, *[len(p.tag) for p in pages]])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base, strict=False)])
        depth = np.concatenate([p.depth for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]

    def infer(self, scores: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of nodes, and summed chances of (parent state, child state): exact, as the graph is a forest."""
        up, down = scores.copy(), np.zeros_like(scores)
        message = np.zeros_like(scores)
        for level in reversed(self.levels):
            message[level] = np.logaddexp(up[level, :1] + pair[:, 0], up[level, 1:] + pair[:, 1])
            np.add.at(up, self.parent[level], message[level])
        joint = np.zeros((2, 2))
        for level in self.levels:
            p = self.parent[level]
            rest = up[p] + down[p] - message[level]
            down[level] = np.logaddexp(rest[:, :1] + pair[0], rest[:, 1:] + pair[1])
            both = rest[:, :, None] + pair + up[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint += (both / both.sum((1, 2), keepdims=True)).sum(0)
        out = up + down
        return out - np.logaddexp(out[:, :1], out[:, 1:]), joint


def fit(pages: list[Page], labels: list[list[int]], rounds: int = 150, l2: float = 0.01) -> TreeModel:
    """Maximum likelihood by Adam: observed less expected features, expected ones from the messages."""
    rows = [features(p) for p in pages]
    y = np.concatenate([np.array(x) for x in labels])
    forest = Forest(pages)
    flat = [f for page in rows for f in page]
    every = np.concatenate([np.array(f) for f in flat])
    owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    goal = np.bincount(every, weights=y[owner], minlength=SLOTS)
    child = np.flatnonzero(forest.parent >= 0)
    goal_pair = np.zeros((2, 2))
    np.add.at(goal_pair, (y[forest.parent[child]], y[child]), 1)
    params = [np.zeros(SLOTS), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        scores = np.stack([np.zeros(len(y)), _sums(params[0], rows)], 1)
        log_p, joint = forest.infer(scores, params[1])
        now = np.bincount(every, weights=np.exp(log_p[:, 1])[owner], minlength=SLOTS)
        for i, g in enumerate([(goal - now) / len(y) * 10, (goal_pair - joint) / len(y) * 10]):
            g = g - l2 * params[i] / 10
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + 0.1 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    return TreeModel(*[np.round(p, 6) for p in params])


def labelled_pages(seed: int = 5, n: int = 260) -> list[tuple[str, set[str]]]:
    """Pages made by rule, with the texts of their main blocks: many layouts, with and without telling tags and classes."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: str(rng.choice(x))
    parts = ["ka", "ro", "mi", "tel", "sun", "ver", "do", "lan", "qui", "na", "the", "ing", "st", "ou"]
    serial = iter(range(10**9))
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))

    def say(low: int, high: int) -> str:  # unique, as labels go by text
        text = [word() for _ in range(rng.integers(low, high))]
        return " ".join([f"x{next(serial)}", *text]).capitalize() + pick(".", ".", ".", "?", ", and.")

    def link(low: int = 0, high: int = 3) -> str:
        return f'<a href="/{word()}">{say(low, high)[:-1]}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 9)))
        return pick(f"<nav><ul>{items}</ul></nav>", f'<div class="{pick("menu", "navbar", "main-nav", "breadcrumb", "navigation top")}"><ul>{items}</ul></div>', f'<ul id="{pick("nav", "menu", "topnav")}">{items}</ul>', f'<div role="navigation">{items}</div>')

    def head() -> str:
        return pick(f"<header><h1>{say(1, 5)}</h1>{menu()}</header>", f'<div id="{pick("header", "masthead", "site-header", "banner")}"><p>{say(1, 6)}</p></div>', f"<header><p>{say(1, 8)}</p></header>")

    def foot() -> str:
        return pick(f"<footer>&copy; {say(1, 12)}</footer>", f'<div class="{pick("footer", "site-footer", "copyright", "bottom")}"><p>{say(2, 12)}</p>{link()}</div>', f"<footer><p>{say(1, 9)}</p><ul><li>{link()}</li><li>{link()}</li></ul></footer>")

    def aside() -> str:
        inner = pick(f"<h3>{say(1, 3)}</h3><ul><li>{link(2, 8)}</li><li>{link(2, 8)}</li></ul>", f"<p>{say(4, 25)}</p>", f"<h4>{say(1, 4)}</h4><p>{say(4, 20)}</p><p>{link()}</p>")
        return pick(f"<aside>{inner}</aside>", f'<div class="{pick("sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "side")}">{inner}</div>')

    def notice() -> str:
        return f'<{(t := pick("div", "section", "p", "aside"))} class="{pick("ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner-ad", "cookie", "cookie-notice", "consent", "notice", "alert", "newsletter", "subscribe", "share", "social", "popup", "modal", "ad-box")}">{say(3, 24)}</{t}>'

    def form() -> str:
        return pick(f'<form action="/s"><label>{say(1, 4)}</label><input name="q"></form>', f'<form class="{pick("login", "search", "signup")}"><p>{say(3, 12)}</p><input><button>{say(0, 2)}</button></form>')

    def comments() -> str:
        each = "".join(f'<{(t := pick("div", "li", "article", "p"))} class="{pick("comment", "reply", "comment-body", "user-comment")}">{pick("", "<p>")}{say(4, 30)}</{t}>' for _ in range(rng.integers(1, 5)))
        return pick(f'<section class="comments"><h3>{say(0, 3)}</h3>{each}</section>', f'<div id="{pick("comments", "disqus", "comment-list", "responses", "discussion")}">{each}</div>', f'<ol class="commentlist">{each}</ol>')

    def main() -> tuple[str, list[str]]:
        kept: list[str] = []

        def body(low: int, high: int) -> str:
            kept.append(say(low, high))
            return kept[-1]

        out = [f"<h1>{body(1, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.integers(1, 9)):
            out.append(
                [
                    lambda: f"<p>{body(5, 90)}</p>", lambda: f"<p>{body(5, 90)}</p>", lambda: f"<p>{body(1, 90)}", lambda: f"<p><b>{body(2, 30)}<br>",
                    lambda: f"<h{(k := rng.integers(2, 5))}>{body(1, 8)}</h{k}>", lambda: f"<blockquote><p>{body(5, 40)}</p></blockquote>", lambda: f"<ul><li>{body(1, 20)}</li><li>{body(1, 20)}</ul>",
                    lambda: f"<table><tr><th>{body(0, 3)}</th><td>{body(0, 4)}</td></tr></table>", lambda: f"<pre>{body(3, 20)}</pre>", lambda: f"<figure><img src='x'><figcaption>{body(2, 10)}</figcaption></figure>", lambda: f"<div>{body(8, 60)}</div>",
                ][min(10, int(rng.exponential(3)))]()
            )
            if rng.random() < 0.08:
                out.append(pick(notice(), aside(), form()))
        if rng.random() < 0.12:
            out.append(comments())
        inner = "".join(out)
        return pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="{pick("content", "post", "entry-content", "article-body", "main-content", "story", "text", "post-body")}">{inner}</div>', f'<div id="{pick("content", "main", "article")}">{inner}</div>', f"<div>{inner}</div>"), kept

    out = []
    for _ in range(n):
        text, kept = main()
        before = [f() for f in (head, menu, notice, form, aside) if rng.random() < 0.5]
        after = [f() for f in (aside, comments, notice, form, menu, foot) if rng.random() < 0.45]
        if rng.random() < 0.3:
            text = f'<div class="{pick("wrap", "container", "page", "row")}">{text}{"".join(after[:1])}</div>'
            after = after[1:]
        html = f"<html><head><title>t</title></head><body>{''.join(before)}{text}{''.join(after)}</body></html>"
        out.append((html[: len(html) - int(rng.choice([0, 0, 0, 14]))], set(kept)))
    return out


def labels_of(page: Page, kept: set[str]) -> list[int]:
    """State of every node: main text if one of its own blocks or anything below is."""
    out = [0] * len(page.tag)
    for node, text in page.blocks:
        if text in kept:
            out[node] = 1
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return out


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    made = [(Page(s), kept) for s, kept in labelled_pages()]
    return fit([p for p, _ in made], [labels_of(p, kept) for p, kept in made])


def extract(model: TreeModel, sources: list[str | None]) -> list[str]:
    """Main text of each page: the blocks whose node and all of its ancestors are more likely main text than not."""
    pages = [Page(s) for s in sources]
    out = []
    for page, p in zip(pages, model.marginals(pages), strict=True):
        keep = p >= 0.5
        for i in range(1, len(keep)):
            keep[i] &= keep[page.parent[i]] or page.parent[i] == 0
        out.append("\n".join(text for node, text in page.blocks if keep[node]))
    return out


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""
    model = model or default_model()
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), F.col(f"`{html_col}`").cast("string").alias("__html"))

    def kernel(sources: list[str | None]) -> list[list]:
        texts = extract(model, sources)
        return [texts, [len(t) for t in texts]]

    return over_texts(rows, "__html", kernel, FIELDS, [id_col, url_col])
