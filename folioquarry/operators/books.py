"""Books put together: trees from outlines, groups of pieces, merged files, moved ids, levels and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(entries: DataFrame, book: list[str], deepest: int = 12) -> DataFrame:
    """parent: pos of the entry that an entry (book, pos, depth from 0) stands under, the nearest before it that is less deep.

    One window by book; ``deepest`` bounds the columns that the window makes, and an entry below it is an error.
    """
    before = Window.partitionBy(*book).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("pos")), ignorenulls=True).over(before) for d in range(deepest)]
    nearest = F.array_max(F.filter(F.array(*[F.when(F.col("depth") > d, x) for d, x in enumerate(last)]), lambda x: x.isNotNull()))
    checked = F.when(F.col("depth") > deepest, F.raise_error(F.lit(f"an outline is deeper than {deepest}"))).otherwise(nearest)
    return entries.withColumn("parent", checked)


def contents_tree(outline: DataFrame, names: DataFrame, book: list[str], deepest: int = 12) -> DataFrame:
    """pos, parent, title, page of an outline's entries (pos, depth, title, path): a path's first entry is its page (names: path, page).

    Later entries of a path are titles alone; entries without a page and without one below them are left out.
    """
    at = outline.join(names, [*book, "path"], "left")
    nth = F.row_number().over(Window.partitionBy(*book, "path").orderBy("pos"))
    at = parents(at.withColumn("page", F.when(F.col("page").isNotNull() & (nth == 1), F.col("page"))), book, deepest)
    w = Window.partitionBy(*book).orderBy("pos")
    # an entry's subtree ends before the next entry that is no deeper
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    nxt = F.array_min(F.filter(F.array(*[F.when(F.col("depth") >= d, F.first(F.when(F.col("depth") == d, F.col("pos")), ignorenulls=True).over(ahead)) for d in range(deepest + 1)]), lambda x: x.isNotNull()))
    paged = F.sum(F.col("page").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("__next", nxt).withColumn("__paged", paged)
    total = at.groupBy(*book).agg(F.sum(F.col("page").isNotNull().cast("int")).alias("__all"))
    before = at.select(*book, F.col("pos").alias("__next"), (F.col("__paged") - F.col("page").isNotNull().cast("int")).alias("__upto"))
    at = at.join(total, book).join(before, [*book, "__next"], "left")
    below = F.coalesce("__upto", "__all") - F.col("__paged") + F.col("page").isNotNull().cast("int")
    return at.filter(below > 0).select(*book, "pos", "parent", "title", "page")


def nested_pieces(pieces: DataFrame, book: list[str], levels: int = 6) -> DataFrame:
    """path and title of each group over the pieces (stem, parents, position, seq): one for each prefix of a position, once, at its first piece."""
    steps = F.split("position", r"\.")
    each = pieces.select(*book, "seq", F.posexplode("parents").alias("depth", "title"), steps.alias("steps"))
    path = F.array_join(F.slice("steps", F.lit(1), F.col("depth") + 1), ".")
    return each.groupBy(*book, path.alias("path"), (F.col("depth") + 1).alias("depth")).agg(F.min_by("title", "seq").alias("title"), F.min("seq").alias("seq"), F.count("*").alias("n_pieces"))


def reading_groups(pages: DataFrame, book: list[str]) -> DataFrame:
    """group of each page (pos, depth, title) for notes: the title of the top entry that it stands under."""
    w = Window.partitionBy(*book).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("group", F.last(F.when(F.col("depth") == 0, F.col("title")), ignorenulls=True).over(w))


def place_notes(pages: DataFrame, book: list[str], numbering: str = "page", placement: str = "page") -> DataFrame:
    """first (number of a page's first note) and home (where its notes stand) for numbering and placement by page, group or book.

    pages: pos, page, group, n_notes.  Notes of a group or book stand on its last page.
    """
    by = {"page": [*book, "page"], "group": [*book, "group"], "book": book}
    before = Window.partitionBy(*by[numbering]).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*by[placement]).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pages.select(*pages.columns, (F.coalesce(F.sum("n_notes").over(before), F.lit(0)) + 1).alias("first"), F.last("page").over(last).alias("home"))


def stale_pages(report: DataFrame, pages: DataFrame) -> DataFrame:
    """Names that an earlier run wrote and this one does not."""
    return report.select("name").distinct().join(pages.select("name"), "name", "left_anti")


def prefix_ids(rows: DataFrame, prefix: Column, ids: str = "ids", links: str = "links") -> DataFrame:
    """Every id with a prefix, and every link within the page likewise."""
    moved = lambda x: F.when(x.startswith("#") & (F.length(x) > 1), F.concat(F.lit("#"), prefix, F.substr(x, F.lit(2)))).otherwise(x)
    return rows.withColumn(ids, F.transform(ids, lambda x: F.concat(prefix, x))).withColumn(links, F.transform(links, moved))


def shift_levels(level: Column, by: Column | int) -> Column:
    """A heading's level moved up, to 1 at most."""
    return F.greatest(F.lit(1), level - by)


def lift_headings(blocks: DataFrame, doc: list[str], level: int) -> DataFrame:
    """depth of each block once the boxes that hold a heading to cut at are open: blocks: pos, box (null for none), level."""
    w = Window.partitionBy(*doc, "box")
    opens = F.max(F.col("level").isNotNull() & (F.col("level") <= level)).over(w)
    return blocks.withColumn("box", F.when(F.col("box").isNotNull() & ~opens, F.col("box")))


def merge_plan(pages: DataFrame, book: list[str]) -> DataFrame:
    """Each page (pos, depth, stem, title) with the file that it goes to (the stem of the first page of its top group) and its place there."""
    w = Window.partitionBy(*book).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = pages.withColumn("__top", F.sum((F.col("depth") == 0).cast("int")).over(w))
    inside = Window.partitionBy(*book, "__top").orderBy("pos")
    return at.withColumn("file", F.first("stem").over(inside)).withColumn("place", F.row_number().over(inside)).drop("__top")


def rename_used(ids: DataFrame, file: list[str], order: list[str], name: str = "id") -> DataFrame:
    """new_id of ids that several pages merged into one file have: the first stays, the n-th gets -n.

    A made name that another id has already is not looked for here; sequences.unique_names does that.
    """
    n = F.row_number().over(Window.partitionBy(*file, name).orderBy(*order))
    return ids.withColumn("new_id", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def book_outline(commands: DataFrame, book: list[str]) -> DataFrame:
    """stem and role of a master file's includes (pos, command, argument): a matter command holds until the next."""
    w = Window.partitionBy(*book).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("command") == "frontmatter", "front").when(F.col("command") == "mainmatter", "main").when(F.col("command") == "appendix", "appendix").when(F.col("command") == "backmatter", "back")
    rows = commands.withColumn("role", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit("main")))
    return rows.filter(F.col("command").isin("include", "input")).select(*book, "pos", F.regexp_replace(F.trim("argument"), r"\.tex$", "").alias("stem"), "role")


def outline_pages(outline: DataFrame, pages: DataFrame, book: list[str]) -> DataFrame:
    """The page of each outline entry (pos, slug, title_slug): by slug, else by title; a page serves once, the entry first in order getting it.

    pages: page, slug, title_slug, seq.  Entries are matched by slug for the whole book before titles are tried.
    """

    def turn(entries: DataFrame, free: DataFrame, by: str) -> DataFrame:
        e = entries.withColumn("__n", F.row_number().over(Window.partitionBy(*book, by).orderBy("pos")))
        p = free.withColumn("__n", F.row_number().over(Window.partitionBy(*book, by).orderBy("seq", "page")))
        return e.join(p.select(*book, by, "__n", "page"), [*book, by, "__n"]).select(*book, "pos", "page")

    first = turn(outline, pages, "slug")
    second = turn(outline.join(first, [*book, "pos"], "left_anti"), pages.join(first.select(*book, "page"), [*book, "page"], "left_anti"), "title_slug")
    return outline.join(first.unionByName(second), [*book, "pos"], "left").select(*book, "pos", "page")


def chapter_numbers(pages: DataFrame, book: list[str]) -> DataFrame:
    """chapter_number: the place of a page's chapter (chapter_pos) among the book's chapters; page_number: its place in the chapter, introductions not counted."""
    number = F.dense_rank().over(Window.partitionBy(*book).orderBy("chapter_pos"))
    counted = F.sum((~F.col("is_intro")).cast("int")).over(Window.partitionBy(*book, "chapter_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("chapter_number", number).withColumn("page_number", F.when(~F.col("is_intro"), counted))



def course_pages(links: DataFrame, chapters: DataFrame, book: list[str], deepest: int = 12) -> DataFrame:
    """pos, parent, title, address, body and note of a course's entries: links(pos, id, short_name, title, depth, root), chapters(id, title, text).

    An entry whose chapter was not captured, or that has neither text nor entries under it, has a note and no body;
    one without text of its own lists what stands under it.
    """
    at = parents(links.join(chapters.select(*book, "id", F.col("title").alias("__title"), "text", F.lit(True).alias("__there")), [*book, "id"], "left"), book, deepest)
    title = F.trim(F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), "__title", F.lit("")), r"\s+", " "))
    at = at.withColumn("title", title).withColumn("address", F.concat("root", F.lit("/"), F.coalesce(F.nullif("short_name", F.lit("")), F.col("id").cast("string"))))
    item = F.concat(F.lit('<li><a href="'), "address", F.lit('">'), "title", F.lit("</a></li>"))
    below = at.filter("parent is not null").groupBy(*book, F.col("parent").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda e: e["x"]), "").alias("__list"))
    at = at.join(below, [*book, "pos"], "left")
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"<[^>]+>|\s|&nbsp;", "") != ""
    note = F.when(F.col("__there").isNull(), "chapter-not-captured").when(~own & F.col("__list").isNull(), "chapter-empty")
    body = F.when(note.isNull(), F.when(own, F.col("text")).otherwise(F.concat(F.lit("<ul>"), "__list", F.lit("</ul>"))))
    return at.select(*book, "pos", "parent", "title", "address", body.alias("body"), note.alias("note"))
