"""Rules over one page's facts.

Each rule is a Column that gives an array of (check, detail); all arrays of a page are joined and exploded once, so
pages are parsed and scanned once however many rules there are, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import EXTERNAL, let, squeeze
from folioquarry.operators import alttext
from folioquarry.sources.pages import LAYOUT_ROLES


def _found(check: str | Column, detail: str | Column) -> Column:
    return F.struct((F.lit(check) if isinstance(check, str) else check).alias("check"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _each(array: str, keep, check: str | Column, detail) -> Column:
    """A finding for each element (with its place) that ``keep`` holds for."""
    return F.array_compact(F.transform(array, lambda x, i: F.when(F.coalesce(keep(x, i), F.lit(False)), _found(check, detail(x, i)))))


def _cut(x: Column) -> Column:
    return F.when(F.length(x) <= 80, x).otherwise(F.concat(F.substring(x, 1, 79), F.lit("…")))


def document_rules() -> list[Column]:
    """Language, title, formulas and well-formedness."""
    stem = F.regexp_replace(F.regexp_extract("name", "([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    named = F.exists("headings", lambda h: (h["level"] == 1) & (h["text"] == F.col("title")))
    one = [
        F.when(F.coalesce("lang", F.lit("")) == "", _found("no-lang", "the html element declares no language")),
        F.when(F.coalesce("title", F.lit("")) == "", _found("no-title", "the page has no title")),
        F.when((F.col("title") == stem) & (F.instr(stem, " ") == 0) & stem.rlike("[_.-]|[a-z][A-Z]") & ~named, _found("title-is-file-name", F.col("title"))),
        F.when(F.col("lost_formulas") > 0, _found("formula-lost", F.format_string("%d formula(s)", "lost_formulas"))),
        F.when(F.col("parse_error").isNotNull(), _found("not-well-formed", F.col("parse_error"))),
    ]
    bare = F.col("scripts") == 0
    dropped = _each("dropped_files", lambda x, i: x != "", "link-to-file-dropped", lambda x, i: x)
    return [F.array_compact(F.array(*one)), dropped, _each("tex_formulas", lambda x, i: bare, "formula-shown-as-tex", lambda x, i: _cut(x)), _each("text_formulas", lambda x, i: bare, "formula-kept-as-text", lambda x, i: _cut(x))]


def id_rules() -> list[Column]:
    """Each further occurrence of an id, which stand together once sorted, and ids with white space."""
    ordered = F.array_sort(F.transform("ids", lambda x, i: F.struct(x.alias("id"), i.alias("i"))))
    again = let(ordered, lambda s: F.array_compact(F.transform(s, lambda e, k: F.when((k > 0) & (F.get(s, k - 1)["id"] == e["id"]), _found("duplicate-id", e["id"])))))
    return [again, _each("ids", lambda x, i: x.rlike(r"(?U)[\s\x1c-\x1f]"), "invalid-id", lambda x, i: x)]


def image_rules() -> list[Column]:
    """The first of: no alt, empty alt, the file's name, the cascade of problems."""

    def judged(x: Column) -> Column:
        alt, src = x["alt"], x["src"]
        quoted = F.concat(src, F.lit(": '"), alt, F.lit("'"))
        says = lambda p: F.when(p.isNotNull(), _found(F.concat(F.lit("image-alt-"), p["kind"]), F.when(p["kind"] == "placeholder", F.concat(quoted, F.lit(" ("), p["rule"], F.lit(")"))).otherwise(quoted)))
        return (
            F.when(~x["has_alt"], _found("image-without-alt", src)).when((squeeze(alt) == "") & ~x["decorative"], _found("image-empty-alt-not-decorative", src))
            .when(alttext.is_file_name(alt, src), _found("image-alt-is-file-name", quoted)).when(~x["decorative"], let(alttext.problem(alt, limit=None), says))
        )

    return [F.array_compact(F.transform("images", judged))]


def link_label_rules() -> list[Column]:
    shown = lambda x, i: x["text"].rlike(r"[\p{L}\p{N}]") & ~F.contains(F.lower(squeeze(x["label"])), F.lower(x["text"]))
    return [_each("labeled_links", shown, "link-label-without-text", lambda x, i: F.concat(F.lit("'"), F.substring(x["text"], 1, 60), F.lit("' named '"), F.substring(x["label"], 1, 80), F.lit("'")))]


def heading_rules() -> list[Column]:
    """Empty headings, and levels skipped against the heading just before."""
    h = F.col("headings")
    last = lambda i: F.get(h, i - 1)["level"]
    return [
        _each("headings", lambda x, i: x["text"] == "", "empty-heading", lambda x, i: F.format_string("h%d", x["level"])),
        _each("headings", lambda x, i: (i > 0) & (x["level"] > last(i) + 1), "heading-skips-level", lambda x, i: F.format_string("h%d to h%d: %s", last(i), x["level"], x["text"])),
    ]


def table_rules() -> list[Column]:
    """Layout tables are passed over but counted."""
    data = lambda x: ~F.coalesce(x["role"].isin(*LAYOUT_ROLES), F.lit(False))
    which = lambda x, i: F.format_string("table %d", i + 1)
    return [
        _each("tables", lambda x, i: data(x) & ~x["has_th"] & ~x["has_caption"], "table-without-headers-or-caption", which),
        _each("tables", lambda x, i: data(x) & x["has_th"] & ~x["has_td"], "table-without-data-cells", which),
        _each("tables", lambda x, i: data(x) & (x["wrapped"] == F.lit(False)), "table-not-in-scroll-region", which),
        _each("formula_headers", lambda x, i: F.lit(True), "table-header-is-formula", lambda x, i: F.when(x["tex"] != "", F.format_string("table %d: %s", x["tbl"], x["tex"])).otherwise(F.format_string("table %d", x["tbl"]))),
    ]


RULES = (document_rules, id_rules, image_rules, link_label_rules, heading_rules, table_rules)


def check_pages(facts: DataFrame) -> DataFrame:
    """All rules of single pages as (where, check, detail)."""
    every = F.concat(*[part for rule in RULES for part in rule()])
    return facts.select(F.col("name").alias("where"), F.inline(every))


def check_shared_alt(facts: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One note for each (page, src) whose otherwise good text another picture has; digests: (src, digest) of local files."""
    images = facts.select("name", F.inline("images"))
    good = images.filter("has_alt and not decorative").filter((squeeze("alt") != "") & ~alttext.is_file_name(F.col("alt"), F.col("src")) & alttext.problem(F.col("alt"), limit=None).isNull())
    good = good.join(digests, "src", "left").withColumn("identity", F.coalesce("digest", "src")) if digests is not None else good.withColumn("identity", F.col("src"))
    found = alttext.shared(good, "alt", "identity").groupBy("name", "src").agg(F.min("alt").alias("alt"), F.max("others").alias("others"))
    text = F.format_string("%s: '%s' (shared with %d other image%s)", "src", "alt", "others", F.when(F.col("others") == 1, "").otherwise("s"))
    return found.select(F.col("name").alias("where"), F.lit("image-alt-shared").alias("check"), text.alias("detail"))


def is_external(href: Column) -> Column:
    out = F.lit(False)
    for p in EXTERNAL:
        out = out | F.lower(href).startswith(p)
    return out
