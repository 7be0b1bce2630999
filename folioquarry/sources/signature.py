"""Web pages to comparable fields: what two runs of a converter are compared by."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import EXTERNAL, FOLDED, PAGE_SUFFIXES

#: Elements that hold no text of the page, and those that break words.
SILENT = ("script", "style", "head")
BREAKS = frozenset("address article aside blockquote br caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def bucket_of(href: str) -> str | None:
    """fragment, external, page or asset; None for a blank address."""
    href = href.strip()
    path = href.split("#", 1)[0].split("?", 1)[0]
    if not href:
        return None
    if href.startswith("#"):
        return "fragment"
    if href.lower().startswith(tuple(EXTERNAL)):
        return "external"
    leaf = path.rsplit("/", 1)[-1]
    suffix = "." + leaf.rsplit(".", 1)[1].lower() if "." in leaf.lstrip(".") else ""
    return "fragment" if not path else "page" if suffix in ("", *PAGE_SUFFIXES) else "asset"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang = "", ""
        self.text: list[str] = []
        self.counts: Counter = Counter()
        self.headings: list[list] = []
        self.images: list[tuple] = []
        self.links: list[str] = []
        self.lists: list[list] = []
        self.tables: list[dict] = []
        self.open_lists: list[list] = []
        self.open_tables: list[dict] = []
        self.into: list[tuple[str, list[str]]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if tag in BREAKS:
            self._say(" ")
        self.silent += tag in SILENT
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "title":
            self.into.append((tag, []))
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.headings.append([int(tag[1]), ""])
            self.into.append((tag, []))
        elif tag == "img":
            leaf = a.get("src", "").split("#")[0].split("?")[0].rsplit("/", 1)[-1]
            stem, dot, suffix = leaf.rpartition(".")
            self.images.append((stem if dot else leaf, dot + suffix.lower() if dot else "", a.get("alt")))
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
        elif tag in ("ul", "ol"):
            self.lists.append([tag, len(self.open_lists) + 1, 0])
            self.open_lists.append(self.lists[-1])
        elif tag == "li" and self.open_lists:
            self.open_lists[-1][2] += 1
        elif tag == "table":
            self.tables.append({"rows": 0, "cols": 0, "th": 0, "td": 0, "thead_rows": 0, "colspan": 0, "rowspan": 0, "headers_attr": 0, "cell_ids": 0, "role": a.get("role", ""), "caption": "", "scope": Counter(), "head": False, "width": 0})
            self.open_tables.append(self.tables[-1])
        elif self.open_tables:
            self._in_table(tag, a)
        if tag in ("figure", "figcaption", "math", "blockquote", "iframe", "embed", "object", "video", "audio"):
            self.counts[tag] += 1

    def _in_table(self, tag, a):
        table = self.open_tables[-1]
        number = lambda k: int(a[k]) if a.get(k, "").isdigit() else 1
        if tag == "thead":
            table["head"] = True
        elif tag == "tr":
            table["rows"] += 1
            table["thead_rows"] += table["head"]
            table["width"] = 0
        elif tag in ("th", "td"):
            table[tag] += 1
            table["width"] += number("colspan")
            table["cols"] = max(table["cols"], table["width"])
            table["colspan"] += number("colspan") > 1
            table["rowspan"] += number("rowspan") > 1
            table["headers_attr"] += "headers" in a
            table["cell_ids"] += "id" in a
            if a.get("scope"):
                table["scope"][a["scope"]] += 1
        elif tag == "caption":
            self.into.append((tag, []))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("img", "br", "hr", "input", "meta", "link"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self._say(" ")
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if self.into and self.into[-1][0] == tag:
            _, parts = self.into.pop()
            said = " ".join("".join(parts).split())
            if tag == "title":
                self.title = self.title or said
            elif tag == "caption" and self.open_tables:
                self.open_tables[-1]["caption"] = said
            elif self.headings and tag != "caption":
                self.headings[-1][1] = said
        elif tag in ("ul", "ol") and self.open_lists:
            self.open_lists.pop()
        elif tag == "thead" and self.open_tables:
            self.open_tables[-1]["head"] = False
        elif tag == "table" and self.open_tables:
            self.open_tables.pop()

    def _say(self, data):
        if not self.silent:
            self.text.append(data)

    def handle_data(self, data):
        self._say(data)
        if self.into:
            self.into[-1][1].append(data)


def signature(markup: str | None, fold: bool = False) -> dict[str, str]:
    """The fields of one page by name, as text."""
    reader = _Reader()
    reader.feed(markup or "")
    reader.close()
    folded = lambda s: s if not fold else "".join(FOLDED.get(c, c) for c in s)
    tops = [t for level, t in reader.headings if level == 1]
    buckets = Counter(map(bucket_of, reader.links))
    out = {
        "title": folded(reader.title), "lang": reader.lang, "h1_count": len(tops), "h1_text": folded(" | ".join(tops)), "heading_outline": ",".join(str(level) for level, _ in reader.headings), "heading_count": len(reader.headings),
        "word_count": len(folded("".join(reader.text)).split()), "figure_count": reader.counts["figure"], "figcaption_count": reader.counts["figcaption"], "math_count": reader.counts["math"], "img_count": len(reader.images),
        "embed_count": sum(reader.counts[k] for k in ("iframe", "embed", "object", "video", "audio")),
        **{f"link_{k}_count": buckets[k] for k in ("page", "asset", "external", "fragment")},
        "img_stems": " ".join(s for s, _, _ in reader.images), "img_extensions": " ".join(sorted({e for _, e, _ in reader.images})),
        "img_alt_missing": sum(alt is None for _, _, alt in reader.images), "img_alt_empty": sum(alt is not None and not alt.strip() for _, _, alt in reader.images),
        "blockquote_count": reader.counts["blockquote"], "list_count": len(reader.lists), "list_outline": ",".join(f"{t}{depth}:{n}" for t, depth, n in reader.lists), "table_count": len(reader.tables),
    }
    for i, t in enumerate(reader.tables, 1):
        for k in ("rows", "cols", "th", "td", "thead_rows", "colspan", "rowspan", "headers_attr", "cell_ids", "role", "caption"):
            out[f"table[{i}].{k}"] = t[k]
        out[f"table[{i}].scope"] = " ".join(f"{k}={n}" for k, n in sorted(t["scope"].items()))
    return {k: str(v) for k, v in out.items()}


def signatures(pages: DataFrame, key: str, html_col: str = "html", fold: bool = False) -> DataFrame:
    """key, field, value of every page: one row a field, which two runs are compared by."""
    rows = pages.select(F.col(key).alias(key), F.col(html_col).cast("string").alias("__html"))
    schema = f"{key} {dict(rows.dtypes)[key]}, fields map<string,string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "fields": [signature(h, fold) for h in batch["__html"]]})

    return rows.mapInPandas(run, schema).select(key, F.explode("fields").alias("field", "value"))


def compare_signatures(before: DataFrame, after: DataFrame, key: str, tolerant: tuple[str, ...] = ("word_count",), percent: float = 2.0) -> DataFrame:
    """key, field, old, new of the fields that differ, word counts by more than a tolerance; a field that one page lacks is absent there."""
    both = before.withColumnRenamed("value", "old").join(after.withColumnRenamed("value", "new"), [key, "field"], "full")
    gap = F.abs(F.col("old").try_cast("long") - F.col("new").try_cast("long"))
    near = F.col("field").isin(*tolerant) & F.coalesce((gap <= 5) | (gap * 100.0 <= percent * F.greatest(F.col("old").try_cast("long"), F.col("new").try_cast("long"))), F.lit(False))
    return both.filter(~F.col("old").eqNullSafe(F.col("new")) & ~near).select(key, "field", F.coalesce("old", F.lit("<absent>")).alias("old"), F.coalesce("new", F.lit("<absent>")).alias("new"))
