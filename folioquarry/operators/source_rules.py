"""Rules over a source document's facts, before it is converted: arrays of (where, check, detail) joined and exploded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import let
from folioquarry.operators import alttext
from folioquarry.operators.tables import table_digest


def _found(where: Column, check: str | Column, detail: Column) -> Column:
    return F.struct(where.alias("where"), (F.lit(check) if isinstance(check, str) else check).alias("check"), detail.alias("detail"))


def _each(array: str, keep, where, check: str, detail) -> Column:
    return F.array_compact(F.transform(array, lambda x, i: F.when(F.coalesce(keep(x, i), F.lit(False)), _found(where(x, i), check, detail(x, i)))))


def _leaf(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def document_rules(has_language: Column | None = None) -> list[Column]:
    name, markdown = F.col("name"), F.col("kind") == "source-md"
    tops = F.size(F.filter("headings", lambda h: h["level"] == 1))
    language = F.col("lang") if has_language is None else F.col("lang") | has_language
    one = [
        F.when(F.col("parse_error").isNotNull(), _found(name, "source-unreadable", F.col("parse_error"))),
        F.when(~F.col("title") & (tops != 1), _found(name, "source-no-title", F.lit("no title in its metadata, and not one heading of level 1"))),
        F.when(markdown & ~language, _found(name, "source-no-language", F.lit("neither the document nor its project says a language"))),
    ]
    last = lambda i: F.get(F.col("headings"), i - 1)["level"]
    me = lambda x, i: name
    return [
        F.array_compact(F.array(*one)),
        _each("headings", lambda h, i: (i > 0) & (h["level"] > last(i) + 1), me, "source-heading-skips-level", lambda h, i: F.format_string("h%d to h%d: %s", last(i), h["level"], F.substring(h["text"], 1, 60))),
        _each("raw_html", lambda x, i: F.lit(True), me, "source-raw-html", lambda x, i: x),
        _each("formulas", lambda x, i: x.rlike(r"\\\s*$"), me, "source-math-trailing-space", lambda x, i: F.right(x, F.lit(40))),
    ]


def link_rules() -> list[Column]:
    bare = lambda t: F.regexp_replace(t, "/+$", "")
    said = lambda x, i: (F.lower(x["target"]).rlike("^https?://")) & ~x["named"] & (bare(x["label"]) == bare(x["target"]))
    return [_each("links", said, lambda x, i: F.col("name"), "source-link-bare-url", lambda x, i: F.substring(x["target"], 1, 80))]


def table_rules() -> list[Column]:
    which = lambda x, i: F.format_string("table %d", i + 1)
    return [
        _each("tables", lambda x, i: ~x["has_header"] & ~x["marked"] & ~x["keyed"], which, "source-table-no-headers", lambda x, i: F.lit("no header row and no marker, and the first column does not key the rows")),
        _each("tables", lambda x, i: ~x["has_caption"] & (F.col("kind") == "source-md"), which, "source-table-no-caption", lambda x, i: F.lit("no caption")),
    ]


def image_rules() -> list[Column]:
    def judged(x: Column, i: Column) -> Column:
        where, leaf = F.format_string("image %d", i + 1), _leaf(x["src"])
        quoted = F.concat(leaf, F.lit(": '"), x["alt"], F.lit("'"))
        says = lambda p: F.when(p.isNotNull(), _found(where, F.concat(F.lit("source-image-alt-"), p["kind"]), F.when(p["kind"] == "placeholder", F.concat(quoted, F.lit(" ("), p["rule"], F.lit(")"))).otherwise(quoted))).when(x["is_caption"], _found(where, "source-image-alt-is-caption", quoted))
        return F.when(x["decorative"], F.lit(None)).when(x["alt"] == "", _found(where, "source-image-no-alt", leaf)).otherwise(let(alttext.problem(x["alt"], limit=None), says))

    return [F.array_compact(F.transform("images", judged))]


def check_sources(facts: DataFrame, has_language: Column | None = None) -> DataFrame:
    """All rules of single documents as (file, where, check, detail)."""
    every = F.concat(*document_rules(has_language), *link_rules(), *table_rules(), *image_rules())
    return facts.select(F.col("name").alias("file"), F.inline(every))


def table_keys(facts: DataFrame) -> DataFrame:
    """name, table (from 1) and key of every table: the same as a grid's."""
    return facts.select("name", F.posexplode("tables").alias("i", "t")).select("name", (F.col("i") + 1).alias("table"), table_digest(F.col("t.cells")).alias("key"))
