"""Books baked: numbered figures, tables, examples, equations and exercises, gathered sections, glossaries, notes, labels of links."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters that no decomposition takes apart, as they are spelled without marks.
SPELLED = {"Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "Th", "þ": "th", "ß": "ss", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "Ŋ": "NG", "ŋ": "ng"}
#: Letters that count as such in a language, the letter that each follows, and their turn after it.
OWN_LETTERS = {"pl": [("ą", "a", 0), ("ć", "c", 0), ("ę", "e", 0), ("ł", "l", 0), ("ń", "n", 0), ("ó", "o", 0), ("ś", "s", 0), ("ź", "z", 0), ("ż", "z", 1)], "es": [("ñ", "n", 0)]}


def _marked() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by decomposition."""
    pairs = [(chr(n), unicodedata.normalize("NFKD", chr(n))) for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, b[0]) for c, b in pairs if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def unmarked(text: Column) -> Column:
    """Latin letters without their marks, ligatures and the like spelled out."""
    marked, bare = _marked()
    text = F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), marked, bare)
    for c, spelled in SPELLED.items():
        text = F.replace(text, F.lit(c), F.lit(spelled))
    return text


def collation_key(text: Column, language: str = "en") -> Column:
    """struct(primary, accents, upper): sorts signs before digits before letters without case and marks, then by marks, then small before capital.

    Letters of their own in Polish and Spanish come after the letter that they look like.
    """
    low, given = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(text, F.lit(""))
    for own, after, turn in OWN_LETTERS.get(language, ()):
        low = F.replace(low, F.lit(own), F.lit(after + chr(0x10FFF0 + turn)))
    # digits and letters go behind all signs, in their own order
    primary = F.regexp_replace(F.regexp_replace(unmarked(low), r"(\p{Nd})", "\uf8f0$1"), r"(\p{L})", "\uf8f1$1")
    accents = F.rtrim(F.regexp_replace(low, r"[\x00-\x7f]", " "))
    upper = F.regexp_replace(F.regexp_replace(given, r"\P{Lu}", "0"), r"\p{Lu}", "1")
    return F.struct(primary.alias("primary"), accents.alias("accents"), upper.alias("upper"))


def index_letter(term: Column) -> Column:
    """The letter that a term stands under, Symbols if it starts with none of A to Z once marks are off."""
    first = F.upper(F.substring(unmarked(F.substring(F.trim(term), 1, 1)), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("Symbols")


def numbered(rows: DataFrame, chapter: list[str], order: list[str], label: str, chapter_number: str, counted: Column | None = None) -> DataFrame:
    """number and label ("Figure 3.2") of the counted rows within their chapter; the others have none."""
    yes = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    n = F.sum(yes.cast("int")).over(Window.partitionBy(*chapter).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("number", F.when(yes, n))
    return out.withColumn("label", F.when(yes, F.concat(F.lit(label + " "), F.col(chapter_number).cast("string"), F.lit("."), F.col("number").cast("string"))))


def numbered_exercises(rows: DataFrame, chapter: list[str], order: list[str], suppress: str | None = None) -> DataFrame:
    """number of each exercise, and has_solution once those of "even" or "odd" numbers (or "all") are dropped."""
    n = F.row_number().over(Window.partitionBy(*chapter).orderBy(*order))
    drop = {"even": F.col("number") % 2 == 0, "odd": F.col("number") % 2 == 1, "all": F.lit(True), None: F.lit(False)}[suppress]
    return rows.withColumn("number", n).withColumn("has_solution", F.col("has_solution") & ~drop)


def end_sections(sections: DataFrame, chapter: list[str], wanted: str) -> DataFrame:
    """place of each section of a class on its chapter's closing page, in the order of the book."""
    return sections.filter(F.col("class") == wanted).withColumn("place", F.row_number().over(Window.partitionBy(*chapter).orderBy("pos")))


def sorted_section(paragraphs: DataFrame, chapter: list[str], text: str, language: str = "en", then: tuple[str, ...] = ()) -> DataFrame:
    """place of each paragraph in its chapter by collated text, then by ``then``."""
    order = [collation_key(F.col(text), language), *[F.col(c) for c in then]]
    return paragraphs.withColumn("place", F.row_number().over(Window.partitionBy(*chapter).orderBy(*order)))


def glossary(definitions: DataFrame, chapter: list[str], language: str = "en") -> DataFrame:
    """Definitions (term, meaning) once each, in order of term and meaning within the chapter."""
    each = definitions.groupBy(*chapter, "term", "meaning").agg(F.count("*").alias("n"))
    return sorted_section(each, chapter, "term", language, ("term", "meaning"))


def solutions(exercises: DataFrame, chapter: list[str], classes: tuple[str, ...]) -> DataFrame:
    """place of the solutions of the named sections' exercises among those of their chapter."""
    return exercises.filter(F.col("class").isin(*classes) & F.col("has_solution")).withColumn("place", F.row_number().over(Window.partitionBy(*chapter).orderBy("pos")))


def footnotes(notes: DataFrame, page: list[str]) -> DataFrame:
    """number of each note of a page in order."""
    return notes.withColumn("number", F.row_number().over(Window.partitionBy(*page).orderBy("pos")))


def target_labels(*labelled: DataFrame) -> DataFrame:
    """id and label of everything numbered; an id that is labelled twice keeps the label first in order."""
    every = None
    for i, df in enumerate(labelled):
        part = df.filter("label is not null").select("id", "label", F.lit(i).alias("turn"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.min_by("label", F.struct("turn", "label")).alias("label"))


def link_texts(links: DataFrame, labels: DataFrame, placeholder: str = "[link]") -> DataFrame:
    """text of each link (target, text): the label of its target where the text is the placeholder; unlabelled ones keep it."""
    at = links.join(labels.select(F.col("id").alias("target"), F.col("label").alias("__label")), "target", "left")
    return at.select(*[F.coalesce(F.when(F.trim("text") == placeholder, F.col("__label")), F.col("text")).alias(c) if c == "text" else F.col(c) for c in links.columns])


def resolve_links(ids: DataFrame, links: DataFrame) -> DataFrame:
    """own_id of every baked id (page, id, own) where that is unambiguous on its page, and target (page#id) of every link to one."""
    n = F.count("*").over(Window.partitionBy("page", "own"))
    named = ids.withColumn("name", F.when(n == 1, F.col("own")).otherwise(F.col("id")))
    return links.join(named.select(F.col("id").alias("href"), F.col("page").alias("__page"), F.col("name").alias("__name")), "href", "left").withColumn("target", F.concat("__page", F.lit("#"), "__name")).drop("__page", "__name")


def collected(pages: DataFrame, book: list[str]) -> DataFrame:
    """outline row and name of each page (pos, depth, title, slug): the slug, or slug-2, -3, ... for pages whose slug came before."""
    n = F.row_number().over(Window.partitionBy(*book, "slug").orderBy("pos"))
    place = F.row_number().over(Window.partitionBy(*book).orderBy("pos"))
    return pages.withColumn("name", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n.cast("string")))).withColumn("row", place)


def assembled(outline: DataFrame, modules: DataFrame, book: list[str]) -> DataFrame:
    """Each outline row that names a module (pos, module) with the module's title and body; a module may be placed often; missing ones are marked."""
    at = outline.join(modules.withColumn("__there", F.lit(True)), "module", "left")
    return at.withColumn("missing", F.col("__there").isNull()).drop("__there")
