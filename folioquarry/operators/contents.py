"""Book order and numbering from names and outlines."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import chapter_of, letter, matter_role, natural_key, piece_source

# Fixed value: the order of a chapter's closing pages.
BACK_MATTER = (
    "key-terms", "chapter-review", "key-concepts-and-summary", "formula-review", "practice", "self-check-questions", "review-questions", "critical-thinking-questions",
    "bringing-it-together-practice", "homework", "bringing-it-together-homework", "problems", "references", "solutions",
)


def within_chapter(stem: str, back_matter: tuple[str, ...] = BACK_MATTER) -> F.Column:
    """struct(rank, number, name): opener, introduction, numbered sections, known back matter, the rest."""
    s = F.col(stem)
    tail = F.regexp_replace(s, r"^\d+-", "")
    number = F.regexp_extract(tail, r"^(\d+)-", 1).try_cast("int")
    place = F.array_position(F.array(*[F.lit(b) for b in back_matter]), tail).cast("int") - 1
    key = lambda a, b, c: F.struct(F.lit(a).alias("rank"), F.coalesce(b, F.lit(0)).cast("int").alias("number"), c.alias("name"))
    none, zero = F.lit(""), F.lit(0)
    return F.when(s.rlike(r"^chapter-\d+$"), key(0, zero, none)).when((tail == "introduction") | tail.startswith("introduction-to-"), key(1, zero, none)).when(number.isNotNull(), key(2, number, none)).when(place >= 0, key(3, place, none)).otherwise(key(4, zero, tail))


def unknown_roles(pages: DataFrame, stem: str = "stem") -> DataFrame:
    rows = pages.filter(chapter_of(stem).isNotNull() & (within_chapter(stem)["rank"] == 4))
    return rows.select(F.regexp_replace(stem, r"^\d+-", "").alias("role")).distinct().orderBy("role")


def book_order(pages: DataFrame, book: list[str], stem: str = "stem") -> DataFrame:
    """position of each page: front, chapters in order, middle, appendices, back; chapters only if two at least hold a quarter of the pages."""
    rows = pages.withColumn("__chapter", chapter_of(stem)).withColumn("__role", F.when(F.col(stem).rlike("(?i)appendix"), "appendix").otherwise(matter_role(stem)))
    tally = rows.groupBy(*book).agg(F.countDistinct("__chapter").alias("__c"), F.count("__chapter").alias("__in"), F.count("*").alias("__n"))
    rows = rows.join(tally, book) if book else rows.crossJoin(F.broadcast(tally))
    grouped = (F.col("__c") >= 2) & (F.col("__in") >= F.greatest(F.lit(3), F.col("__n") / 4)) & F.col("__chapter").isNotNull()
    place = F.when(F.col("__role") == "front", 0).when(grouped, 1).when(F.col("__role") == "middle", 2).when(F.col("__role") == "appendix", 3).otherwise(4)
    w = Window.partitionBy(*book).orderBy(place, F.when(grouped, F.col("__chapter")), F.when(grouped, within_chapter(stem)), natural_key(stem), stem)
    return rows.withColumn("position", F.row_number().over(w)).withColumn("chapter", F.when(grouped, F.col("__chapter"))).drop("__chapter", "__role", "__c", "__in", "__n")


def numbered(nodes: DataFrame, book: list[str]) -> DataFrame:
    """number of top nodes (1, 2, ... and A, B for appendices; none for front and back) and of their pages (N.1, N.2).

    nodes: pos, parent (null at the top), title, role; a group's opening page, titled as the group, takes its number.
    """
    top = nodes.filter("parent is null")
    w = Window.partitionBy(*book, "role").orderBy("pos")
    counted = F.row_number().over(w)
    top = top.withColumn("number", F.when(F.col("role") == "appendix", letter(counted)).when(F.col("role") == "main", counted.cast("string")))
    above = top.select(*book, F.col("pos").alias("parent"), F.col("title").alias("__t"), F.col("number").alias("__n"))
    kids = nodes.filter("parent is not null").join(above, [*book, "parent"])
    order = Window.partitionBy(*book, "parent").orderBy("pos")
    opening = (F.row_number().over(order) == 1) & F.col("title").eqNullSafe(F.col("__t"))
    kids = kids.withColumn("__open", opening).withColumn("__k", F.sum((~F.col("__open")).cast("int")).over(order))
    kids = kids.withColumn("number", F.when(F.col("__open"), F.col("__n")).when(F.col("__n").isNotNull(), F.concat("__n", F.lit("."), F.col("__k").cast("string"))))
    return top.unionByName(kids.select(*top.columns))


def pieces_by_source(pages: DataFrame, stem: str = "stem", part: str = "part") -> DataFrame:
    """Each source with its pieces in order, and whether it was cut at all."""
    source = F.coalesce(piece_source(stem), F.col(stem))
    return pages.groupBy(source.alias("source")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(stem).alias("s")))), lambda x: x["s"]).alias("pieces"), F.max(F.instr(stem, "--") > 0).alias("cut"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """file and depth of all that the roots reach by (file, includes) edges, each at its least depth."""
    seen = roots.select("file", F.lit(0).alias("depth"))
    front = seen
    for depth in count(1):  # ends, as each round reads only files not seen before
        nxt = front.join(edges, "file").select(F.col("includes").alias("file")).distinct().join(seen.select("file"), "file", "left_anti").withColumn("depth", F.lit(depth))
        nxt = nxt.checkpoint() if nxt.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else nxt.persist()
        if nxt.isEmpty():
            return seen
        seen, front = seen.unionByName(nxt), nxt
