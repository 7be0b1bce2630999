"""Content looked up in people's tables and in other pages: alt texts, captions, links, references, embeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import address_form, safe_stem, same_language, squeeze, tag

SOURCE_SUFFIXES = r"(?i)\.(docx|md|html|adoc|asciidoc|pptx|tex)$"


def keys_of(source: Column) -> Column:
    """The names by which a row's source may give a page: as written, without suffix, and each made safe."""
    bare = F.regexp_replace(source, SOURCE_SUFFIXES, "")
    leaf = lambda x: safe_stem(F.regexp_extract(x, "([^/]*)$", 1))
    return F.array_distinct(F.array(source, leaf(source), bare, leaf(bare)))


def match_pages(rows: DataFrame, pages: DataFrame, source: str = "source", row_no: str = "row_no") -> DataFrame:
    """The rows with the page that the first of their keys names (null if none), the last row of a page alone kept; pages: page and name."""
    ways = rows.select("*", F.posexplode(keys_of(F.col(source))).alias("__rank", "__key"))
    met = ways.join(pages.select(F.col("name").alias("__key"), "page"), "__key", "left")
    first = met.groupBy(row_no).agg(F.min_by("page", F.when(F.col("page").isNotNull(), F.col("__rank"))).alias("page"))
    out = rows.join(first, row_no, "left")
    last = F.row_number().over(Window.partitionBy("page").orderBy(F.desc(row_no)))
    return out.filter("page is not null").withColumn("__n", last).filter("__n = 1").drop("__n").unionByName(out.filter("page is null"))


def media_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def alt_for(images: DataFrame, sidecar: DataFrame, files: DataFrame) -> DataFrame:
    """images(src, ...) with alt: that of its exact path, else of its path without suffix where one file alone has that stem.

    A row that is there but blank gives "", a missing one null; of rows that differ in suffix one with text wins, the first of those by path.
    """
    exact = sidecar.select(F.col("path").alias("src"), F.col("alt").alias("__exact"), F.lit(True).alias("__row"))
    by_stem = sidecar.groupBy(media_stem(F.col("path")).alias("__stem")).agg(F.min_by("alt", F.struct((F.col("alt") == "").alias("blank"), "path")).alias("__near"))
    twins = files.select(F.col("path")).distinct().groupBy(media_stem(F.col("path")).alias("__stem")).agg((F.count("*") > 1).alias("__shared"))
    at = images.withColumn("__stem", media_stem(F.col("src"))).join(exact, "src", "left").join(by_stem, "__stem", "left").join(twins, "__stem", "left")
    alt = F.when(F.col("__row").isNotNull(), F.col("__exact")).when(~F.coalesce("__shared", F.lit(False)), F.col("__near"))
    return at.select(*images.columns, alt.alias("alt_in_effect"))


def description_for(tables: DataFrame, sidecar: DataFrame, label: str = "label", fallback: str = "fallback") -> DataFrame:
    """tables with caption: that of the label, else of the fallback key; blank and missing stay apart."""
    side = lambda k, n: sidecar.select(F.col("key").alias(k), F.col("caption").alias(n), F.lit(True).alias(n + "_row"))
    at = tables.join(side(label, "__a"), label, "left").join(side(fallback, "__b"), fallback, "left")
    return at.select(*tables.columns, F.when(F.col("__a_row").isNotNull(), F.col("__a")).otherwise(F.col("__b")).alias("caption"))


def resolved_for(tables: DataFrame, entries: DataFrame, key: list[str], shape: list[str]) -> DataFrame:
    """tables with the entry's value at their place, and mismatched where the entry's shape is another; then the value is null."""
    e = entries.select(*key, *[F.col(c).alias(f"__{c}") for c in shape], F.col("value").alias("__value"), F.lit(True).alias("__there"))
    same = F.lit(True)
    for c in shape:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    there = F.coalesce("__there", F.lit(False))
    return tables.join(e, key, "left").select(*tables.columns, F.when(there & same, F.col("__value")).alias("value"), (there & ~same).alias("mismatched"))


def retarget_links(links: DataFrame, homes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """links(href, ...) with target: source.html#id goes to the piece that holds the id, source.html to the first piece.

    homes: source, id (null where none), piece, part.  A piece named as its source moves nothing.
    """
    form = r"^([^/#?:]+)\.html(?:#(.*))?$"
    at = links.withColumn("__source", F.nullif(F.regexp_extract("href", form, 1), F.lit(""))).withColumn("__id", F.nullif(F.regexp_extract("href", form, 2), F.lit("")))
    by_id = homes.filter("id is not null").groupBy(F.col("source").alias("__source"), F.col("id").alias("__id")).agg(F.min_by("piece", "part").alias("__home"))
    firsts = homes.groupBy(F.col("source").alias("__source")).agg(F.min_by("piece", "part").alias("__first"))
    at = at.join(by_id, ["__source", "__id"], "left").join(firsts, "__source", "left")
    where = F.when(F.col("__id").isNull(), F.col("__first")).otherwise(F.col("__home"))
    moved = where.isNotNull() & (where != F.col("__source"))
    target = F.concat(where, F.lit(".html"), F.coalesce(F.concat(F.lit("#"), F.col("__id")), F.lit("")))
    return at.select(*links.columns, F.when(moved, target).otherwise(F.col("href")).alias("target"), F.coalesce(moved, F.lit(False)).alias("moved"))


PUBLISHER_PAGE = r"^https?://[^/]+/books/[^/]+/pages/([^#?/]+)([#?].*)?$"
MARKDOWN_PAGE = r"^([^/#?:]+)\.md(#.*)?$"


def local_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with target: a publisher's address or a Markdown source of one of the pages (stem) as the page here."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("href", PUBLISHER_PAGE, k), F.lit("")), F.nullif(F.regexp_extract("href", MARKDOWN_PAGE, k), F.lit("")))
    at = links.withColumn("__stem", safe_stem(part(1))).withColumn("__tail", F.coalesce(part(2), F.lit("")))
    at = at.join(pages.select(F.col("stem").alias("__stem"), F.lit(True).alias("__mine")).distinct(), "__stem", "left")
    return at.select(*links.columns, F.when(F.col("__mine"), F.concat("__stem", F.lit(".html"), "__tail")).otherwise(F.col("href")).alias("target"))


def resolve_ids(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """refs(id, page, ...) with home: the page that has the id, the reference's own first; ambiguous where several others have it.

    ids: id, page, title.  title is that of the id in its home.
    """
    known = ids.groupBy("id", F.col("page").alias("__page")).agg(F.min("title").alias("__title"))
    own = known.select("id", F.col("__page").alias("page"), F.col("__title").alias("__own"), F.lit(True).alias("__here"))
    others = known.groupBy("id").agg(F.count("*").alias("__n"), F.min_by("__page", "__page").alias("__there"), F.min_by("__title", "__page").alias("__their"))
    at = refs.join(own, ["id", "page"], "left").join(others, "id", "left")
    here, one = F.col("__here").isNotNull(), F.col("__n") == 1
    home = F.when(here, F.col("page")).when(one, F.col("__there"))
    return at.select(*refs.columns, home.alias("home"), F.when(here, F.col("__own")).when(one, F.col("__their")).alias("title"), (~here & F.coalesce(F.col("__n") > 1, F.lit(False))).alias("ambiguous"))


def for_copy(source: Column, language: Column, marks: Column, declared: Column) -> Column:
    """struct(language, replacing): what a source's copy says where it says none, and the marks to be rewritten as it (null: none)."""
    alike = marks.isNotNull() & F.coalesce(F.lower(marks) == F.lower(language), F.lit(False))
    none = F.lit(None).cast("string")
    foreign = marks.isNotNull() & (marks != "") & ~same_language(marks, language)
    out = lambda a, b: F.struct(a.alias("language"), b.alias("replacing"))
    return (
        F.when(source == "sidecar", out(language, F.when(~alike, F.coalesce(marks, F.lit(""))))).when(source.isin("producer", "project") & foreign, out(language, marks))
        .when((source == "project") & ~declared, out(none, none)).otherwise(out(language, none))
    )


def bare_uses(links: DataFrame) -> DataFrame:
    """The links (text, href, ...) whose text is their address."""
    return links.filter((F.trim("text") != "") & (address_form("text") == address_form("href")))


def bare_texts(links: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Bare links with replacement: the row (url, replacement) of their target, else that of their text."""
    uses = bare_uses(links)
    rows = sidecar.groupBy(address_form("url").alias("__k")).agg(F.max("replacement").alias("__r"))
    by_href = rows.select(F.col("__k").alias("__h"), F.col("__r").alias("__a"))
    return uses.join(by_href, address_form("href") == F.col("__h"), "left").select(*links.columns, F.col("__a").alias("replacement"))


def wanted(embeds: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys of a book's embeds."""
    return embeds.select(*key).distinct()


def inject(embeds: DataFrame, bank: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """Embeds with their bank item's body, or a placeholder and missing where the bank has none."""
    at = embeds.join(bank.select(*key, F.col(body).alias("__body"), F.lit(True).alias("__there")), key, "left")
    hole = F.concat(F.lit("[missing: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]), F.lit("]"))
    return at.select(*embeds.columns, F.when(F.col("__there"), F.col("__body")).otherwise(hole).alias(body), F.col("__there").isNull().alias("missing"))


def media_gate(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct media references without a usable file (one with bytes)."""
    return refs.select("path").distinct().join(files.filter("size > 0").select("path"), "path", "left_anti")


def copies(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each distinct local file that a page names, to be copied beside it: page, path."""
    local = ~F.col("path").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#)")
    return refs.filter(local).join(pages.select("page"), "page", "left_semi").select("page", "path").distinct()


def unlinked_bookmarks(bookmarks: DataFrame, links: DataFrame, doc: list[str]) -> DataFrame:
    """Bookmarks (name) that no link (target) of their document names."""
    return bookmarks.join(links.select(*doc, F.col("target").alias("name")), [*doc, "name"], "left_anti")


def screentips(links: DataFrame, tips: DataFrame, target: str = "target", order: str = "pos") -> DataFrame:
    """Links with the tooltip that stands at their place among the links of their target."""
    number = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(target).orderBy(order)))
    return number(links).join(number(tips).select(target, "__n", "tip"), [target, "__n"], "left").drop("__n")


def language_rows(pages: DataFrame, sidecar: DataFrame, project: str) -> DataFrame:
    """Pages (page, language, source) in another language than the project's, said by file or producer, that no row names."""
    other = F.col("source").isin("file", "producer") & tag("language").isNotNull() & ~same_language("language", F.lit(project))
    return pages.filter(other).join(sidecar.select("page"), "page", "left_anti").select("page", tag("language").alias("language"))


def judged_alts(seen: DataFrame, decided: DataFrame, problem: Column, reason: Column) -> DataFrame:
    """path, alt and reasons of each undecided picture: its text's problem, else that others share it."""
    from folioquarry.operators.alttext import shared

    rows = seen.select("path", F.col("alt")).distinct().join(decided.select("path"), "path", "left_anti").withColumn("__p", problem).withColumn("__r", reason)
    good = shared(rows.filter("__p is null"), "alt", "path").select("path", F.format_string("shared with %d other image%s", "others", F.when(F.col("others") == 1, "").otherwise("s")).alias("why"))
    bad = rows.filter("__p is not null").select("path", F.col("__r").alias("why"))
    return bad.unionByName(good).groupBy("path").agg(F.concat_ws("; ", F.array_sort(F.collect_set("why"))).alias("reasons"))


def plain_words(text: Column) -> Column:
    """A text's words."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def textual_links(text: Column) -> Column:
    """Addresses that stand in a text as text, without the punctuation that closes them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:!?)\]]+$", ""))
