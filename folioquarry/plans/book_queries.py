"""Queries for criteria, table surgery, books, baking, comparison of decks and incremental state, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as t
from folioquarry.operators import baking, books, compare, contents, criteria, decks, findings, sequences, surgery, tables
from folioquarry.plans.queries import query, table
from folioquarry.streaming import incremental

_NUMBERS = ["1.1.1", "1.4.10", "2.4.11", "4.1.1", "9.9.9", "3.3.8", "1.4.6"]
_KNOWN = """(VALUES (0, '1.1.1', true, 'WCAG 2.0 SC 1.1.1 (A)', '1.1.1 Non-text Content (A)', 'https://www.w3.org/WAI/WCAG22/Understanding/non-text-content.html'),
(1, '1.4.10', true, 'WCAG 2.1 SC 1.4.10 (AA)', '1.4.10 Reflow (AA, WCAG 2.1)', 'https://www.w3.org/WAI/WCAG22/Understanding/reflow.html'), (2, '2.4.11', false, 'WCAG 2.2 SC 2.4.11 (AA)', '2.4.11 Focus Not Obscured (Minimum) (AA, WCAG 2.2)', 'https://www.w3.org/WAI/WCAG22/Understanding/focus-not-obscured-minimum.html'),
(3, '4.1.1', false, 'WCAG 2.0 SC 4.1.1', '4.1.1 Parsing (Obsolete and removed)', 'https://www.w3.org/WAI/WCAG22/Understanding/parsing.html'), (4, '9.9.9', false, 'WCAG 2.2 SC 9.9.9', '9.9.9', 'https://www.w3.org/TR/WCAG22/'),
(5, '3.3.8', false, 'WCAG 2.2 SC 3.3.8 (AA)', '3.3.8 Accessible Authentication (Minimum) (AA, WCAG 2.2)', 'https://www.w3.org/WAI/WCAG22/Understanding/accessible-authentication-minimum.html'), (6, '1.4.6', false, 'WCAG 2.0 SC 1.4.6 (AAA)', '1.4.6 Contrast (Enhanced) (AAA)', 'https://www.w3.org/WAI/WCAG22/Understanding/contrast-enhanced.html')) k(i, number, "within", standard, named, url)"""


@query(f"""SELECT event_id, k.number, k."within", standard, named, url FROM events JOIN {_KNOWN} ON i = event_id % 7""")
def criteria_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get(F.array(*[F.lit(n) for n in _NUMBERS]), (F.col("event_id") % 7).cast("int"))
    return criteria.judged(table(spark, sf_dir, "events").select("event_id", number.alias("number")), "number")


# Each order is a table of two columns; lines of over 40 pieces are bands, and the first line of an order of even key is its head.
_ROWS = """r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS row FROM (SELECT l_orderkey AS k, * FROM lineitem)),
x AS (SELECT k, row, l_quantity > 40 AS band, k % 2 = 0 AND row = 1 AS head, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM r),
y AS (SELECT *, band AND coalesce(max(CASE WHEN NOT band THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY row ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS cut FROM x WHERE NOT head),
z AS (SELECT *, sum(CASE WHEN cut AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY row) AS part FROM (SELECT *, lag(cut) OVER (PARTITION BY k ORDER BY row) AS before FROM y)),
c AS (SELECT k, part, string_agg(a, ': ' ORDER BY row) AS caption FROM z WHERE cut GROUP BY 1, 2)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cell = lambda i, c: F.struct(F.lit(i).alias("cell_id"), F.col(c).cast("string").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("shaded"), F.lit(False).alias("image"))
    band = F.col("l_quantity") > 40
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    cells = F.when(band, F.array(cell(1, "l_partkey"), cell(1, "l_partkey"))).otherwise(F.array(cell(1, "l_partkey"), cell(2, "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("row"), cells.alias("cells"), band.alias("band"), F.lit(False).alias("foot"))
    return rows.withColumn("head", (F.col("k") % 2 == 0) & (F.col("row") == 1))


@query(f"""WITH {_ROWS}, b AS (SELECT z.k, z.part, row, false AS head, coalesce(caption, '') AS caption FROM z LEFT JOIN c USING (k, part) WHERE NOT cut)
SELECT k, CAST(part AS BIGINT) AS part, row, head, caption FROM b UNION ALL SELECT x.k, CAST(p.part AS BIGINT), x.row, true, p.caption FROM x JOIN (SELECT DISTINCT k, part, caption FROM b) p USING (k) WHERE x.head""")
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surgery.split_rows(_rows(spark, sf_dir), ["k"]).select("k", F.col("part").cast("long").alias("part"), "row", "head", "caption")


@query(f"""WITH {_ROWS}, b AS (SELECT DISTINCT z.k, z.part, coalesce(caption, '') AS caption FROM z LEFT JOIN c USING (k, part) WHERE NOT cut)
SELECT k, CAST(part AS BIGINT) AS part, CASE WHEN o_orderstatus = 'F' THEN caption WHEN caption = '' THEN o_orderpriority ELSE o_orderpriority || ': ' || caption END AS caption FROM b JOIN orders ON o_orderkey = k""")
def part_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("title"))
    return surgery.part_captions(surgery.split_rows(_rows(spark, sf_dir), ["k"]), ["k"], titles).withColumn("part", F.col("part").cast("long"))


@query(f"""WITH {_ROWS}, b AS (SELECT z.k, z.part, row, coalesce(caption, '') AS caption FROM z LEFT JOIN c USING (k, part) WHERE NOT cut)
SELECT k, row, caption AS "group", count(*) OVER (PARTITION BY k, part) AS span FROM b WHERE k IN (SELECT k FROM b GROUP BY k HAVING min(part) > 0)""")
def band_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surgery.column_rows(_rows(spark, sf_dir), ["k"]).drop("cells")


@query(f"""WITH {_ROWS}, b AS (SELECT z.k, z.part, row, coalesce(caption, '') AS caption FROM z LEFT JOIN c USING (k, part) WHERE NOT cut)
SELECT k, row, CAST(dense_rank() OVER (PARTITION BY k ORDER BY part) AS INT) AS body, caption AS "group" FROM b""")
def band_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surgery.group_rows(_rows(spark, sf_dir), ["k"]).drop("cells")


@query(f"""WITH {_ROWS}, s AS (SELECT k, string_agg(a, ' ' ORDER BY row) AS said FROM x WHERE band AND row <= 2 GROUP BY k)
SELECT o_orderkey AS k, CASE WHEN said IS NULL THEN title WHEN title = '' THEN said WHEN contains(title, said) THEN title ELSE title || CASE WHEN title LIKE '%.' THEN ' ' ELSE '. ' END || said END AS title
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderstatus = 'O' THEN o_orderpriority || '.' ELSE o_orderpriority END AS title FROM orders) LEFT JOIN s ON k = o_orderkey
UNION ALL SELECT k, said FROM s WHERE k NOT IN (SELECT o_orderkey FROM orders)""")
def folded_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    status = F.col("o_orderstatus")
    title = F.when(status == "F", "").when(status == "O", F.concat("o_orderpriority", F.lit("."))).otherwise(F.col("o_orderpriority"))
    captions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), title.alias("title"))
    return surgery.fold_caption_rows(rows, ["k"], captions, rows.filter("band and row <= 2").select("k", "row"))


@query(f"""WITH {_ROWS}, v AS (SELECT *, CASE k % 5 WHEN 0 THEN 'first-row' WHEN 1 THEN 'first-column' WHEN 2 THEN 'both' WHEN 3 THEN 'none' ELSE '' END AS value FROM x), h AS (SELECT *, CASE WHEN value = 'none' THEN false WHEN head THEN true ELSE value IN ('first-row', 'both') AND k % 2 = 1 AND row = 1 END AS top FROM v)
SELECT k, row, top AS head, CASE WHEN top THEN 'col,col' WHEN value IN ('first-column', 'both') THEN 'row,' ELSE ',' END AS scopes FROM h""")
def applied_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    names = F.array(*[F.lit(v) for v in ("first-row", "first-column", "both", "none")])
    values = rows.select("k").distinct().select("k", F.get(names, (F.col("k") % 5).cast("int")).alias("value"))
    return surgery.apply_headers(rows, ["k"], values).select("k", "row", "head", F.array_join("scopes", ",").alias("scopes"))


@query(f"""WITH {_ROWS} SELECT k, row, row = 1 AS head FROM x""")
def promoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surgery.promote_first_row(_rows(spark, sf_dir), ["k"]).select("k", "row", "head")


@query(f"""WITH {_ROWS} SELECT k, row FROM x WHERE NOT band""")
def rows_without_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return surgery.without_rows(rows, ["k"], rows.filter("band").select("k", "row")).select("k", "row")


@query("""SELECT l_orderkey AS k, max(CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END) AS columns FROM lineitem GROUP BY l_orderkey""")
def closed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda i, c: F.struct(F.lit(i).alias("cell_id"), F.col(c).cast("string").alias("text"))
    wide = F.array(cell(1, "l_partkey"), cell(1, "l_partkey"), cell(2, "l_suppkey"))
    row = F.when(F.col("l_linenumber") % 2 == 0, F.array(cell(1, "l_partkey"), cell(3, "l_tax"), cell(2, "l_suppkey"))).otherwise(wide)
    # cells of different rows are different cells
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(row).alias("g"))
    apart = F.transform("g", lambda r, i: F.transform(r, lambda c: F.struct((i * 10 + c["cell_id"]).alias("cell_id"), c["text"].alias("text"))))
    return made.select("k", F.size(F.get(surgery.close_empty_columns(apart), F.lit(0))).alias("columns"))


_NOTES = """n AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS row, l_partkey % 3 = 0 AS note FROM lineitem), m AS (SELECT *, lag(note) OVER (PARTITION BY k ORDER BY row) AS before, max(row) OVER (PARTITION BY k) AS last FROM n),
f AS (SELECT k, list(row ORDER BY row) FILTER (row > 1 AND note AND NOT before) AS places, bool_or(row = 1 AND note) AS opens, max(last) AS last, bool_or(row = last AND row > 1 AND note AND NOT before) AS closes FROM m GROUP BY k)"""


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda i, text: F.struct(F.lit(i).alias("cell_id"), text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("shaded"), F.lit(False).alias("image"))
    word = lambda c: F.concat(F.lit("w"), F.col(c))
    said = F.concat(F.lit("It is "), F.col("l_partkey"), F.lit("."))
    row = F.when(F.col("l_partkey") % 3 == 0, F.array(cell(1, said), cell(1, said))).otherwise(F.array(cell(1, word("l_partkey")), cell(2, word("l_suppkey"))))
    each = F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["r"]).alias("grid"))


@query(f"""WITH {_NOTES} SELECT k, CASE WHEN closes AND NOT opens THEN array_to_string(places, ',') ELSE '' END AS notes FROM f""")
def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noted(spark, sf_dir).select("k", F.array_join(tables.note_rows(F.col("grid")).cast("array<string>"), ",").alias("notes"))


@query(f"""WITH {_NOTES} SELECT k, CASE WHEN closes AND NOT opens AND len(places) > 1 THEN CASE k % 3 WHEN 0 THEN 'first-row' WHEN 1 THEN 'none' ELSE 'first-row' END ELSE CASE k % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'first-column' ELSE 'first-column' END END AS guess FROM f""")
def guesses_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    guess = tables.without_header_column(F.when(k == 0, "both").otherwise("first-column"), F.lit("first-row"), F.col("grid"), k == 2)
    return _noted(spark, sf_dir).select("k", guess.alias("guess"))


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'table' WHEN length(text) % 2 = 0 THEN 'title' ELSE 'other' END AS kind FROM conversations),
n AS (SELECT *, coalesce(lag(kind) OVER w = 'table', false) AS before, coalesce(lead(kind) OVER w = 'table', false) AS after FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT conv_id, count(*) FILTER (kind = 'title' AND after AND NOT before) AS above, count(*) FILTER (kind = 'title' AND before AND NOT after) AS below FROM n GROUP BY conv_id)
SELECT conv_id, turn AS pos, CASE WHEN below > above THEN 'before' ELSE 'after' END AS goes_to FROM n JOIN h USING (conv_id) WHERE kind = 'title' AND before AND after""")
def caption_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "table").when(F.length("text") % 2 == 0, "title").otherwise("other")
    return surgery.caption_side(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), kind.alias("kind")), ["conv_id"])


_TREE = """e AS (SELECT user_id AS book, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 4 AS INT) END AS depth, event_type AS title FROM events)"""


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), k.alias("pos"), F.when(k % 7 == 0, 0).otherwise((k % 4).cast("int")).alias("depth"), F.col("event_type").alias("title"))


@query(f"""WITH {_TREE}, w AS (SELECT *, max(CASE WHEN depth = 0 THEN pos END) OVER w AS p0, max(CASE WHEN depth = 1 THEN pos END) OVER w AS p1, max(CASE WHEN depth = 2 THEN pos END) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT book, pos, CASE depth WHEN 1 THEN p0 WHEN 2 THEN greatest(p0, p1) WHEN 3 THEN greatest(p0, p1, p2) END AS parent FROM w""")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.parents(_outline(spark, sf_dir), ["book"]).select("book", "pos", "parent")


@query(f"""WITH {_TREE}, p AS (SELECT *, CASE WHEN title = 'click' AND row_number() OVER (PARTITION BY book, title ORDER BY pos) = 1 OR title <> 'click' AND pos % 3 = 0 THEN pos END AS page FROM e),
q AS (SELECT *, (SELECT min(n.pos) FROM p n WHERE n.book = p.book AND n.pos > p.pos AND n.depth <= p.depth) AS upto FROM p)
SELECT book, pos, page FROM q WHERE EXISTS (SELECT 1 FROM p b WHERE b.book = q.book AND b.page IS NOT NULL AND b.pos >= q.pos AND (q.upto IS NULL OR b.pos < q.upto))""")
def contents_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outline(spark, sf_dir)
    path = F.when(F.col("title") == "click", F.lit("click")).otherwise(F.col("pos").cast("string"))
    rows = rows.withColumn("path", path)
    names = rows.filter("path = 'click' or pos % 3 = 0").groupBy("book", "path").agg(F.min("pos").alias("page"))
    return books.contents_tree(rows, names, ["book"]).select("book", "pos", "page")


@query("""SELECT l_orderkey, l_linenumber || '.' || (l_partkey % 3) AS path, 2 AS depth, 'r' || l_partkey % 3 AS title, min(l_partkey * 1000 + l_suppkey) AS seq, count(*) AS n_pieces FROM lineitem GROUP BY ALL
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS VARCHAR), 1, 's' || l_linenumber, min(l_partkey * 1000 + l_suppkey), count(*) FROM lineitem GROUP BY ALL""")
def piece_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.concat(F.lit("s"), "l_linenumber"), F.concat(F.lit("r"), F.col("l_partkey") % 3)).alias("parents"), F.concat_ws(".", F.col("l_linenumber"), F.col("l_partkey") % 3, F.col("l_suppkey")).alias("position"), seq.alias("seq"))
    return books.nested_pieces(rows, ["l_orderkey"])


_PAGES = """p AS (SELECT conv_id AS book, turn AS pos, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS depth, role || turn AS title, length(text) % 4 AS n FROM conversations), g AS (SELECT *, last_value(CASE WHEN depth = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos) AS grp FROM p)"""


@query(f"""WITH {_PAGES} SELECT book, pos, CAST(coalesce(sum(n) OVER (PARTITION BY book, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first, last_value(title) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS home, grp AS "group" FROM g""")
def placed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, 0).otherwise(1).alias("depth"), F.concat("role", F.col("turn")).alias("title"), (F.length("text") % 4).cast("long").alias("n_notes"))
    grouped = books.reading_groups(rows, ["book"]).withColumn("page", F.col("title"))
    return books.place_notes(grouped, ["book"], "group", "book").select("book", "pos", "first", "home", "group")


@query(f"""WITH {_PAGES}, s AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY pos) AS top FROM p)
SELECT book, pos, first_value(title) OVER (PARTITION BY book, top ORDER BY pos) AS file, CAST(row_number() OVER (PARTITION BY book, top ORDER BY pos) AS INT) AS place FROM s""")
def merge_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, 0).otherwise(1).alias("depth"), F.concat("role", F.col("turn")).alias("stem"))
    return books.merge_plan(rows, ["book"]).select("book", "pos", "file", "place")


@query("SELECT DISTINCT c_mktsegment || c_nationkey AS name FROM customer WHERE c_mktsegment || c_nationkey NOT IN (SELECT c_mktsegment || c_nationkey FROM customer WHERE c_custkey % 3 = 0)")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey")).alias("name"))
    return books.stale_pages(rows, rows.filter("c_custkey % 3 = 0"))


@query("""SELECT conv_id, string_agg('p' || conv_id || '-t' || turn, ',' ORDER BY turn) AS ids, string_agg('#p' || conv_id || '-t' || turn, ',' ORDER BY turn) || ',#,x.html#t1' AS links, CAST(greatest(1, count(*) - 2) AS INT) AS level FROM conversations GROUP BY conv_id""")
def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("t"), x))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at.alias("ids"), F.count("*").alias("n"))
    rows = rows.withColumn("links", F.concat(F.transform("ids", lambda x: F.concat(F.lit("#"), x)), F.array(F.lit("#"), F.lit("x.html#t1"))))
    out = books.prefix_ids(rows, F.concat(F.lit("p"), F.col("conv_id"), F.lit("-")))
    return out.select("conv_id", F.array_join("ids", ",").alias("ids"), F.array_join("links", ",").alias("links"), books.shift_levels(F.col("n"), 2).cast("int").alias("level"))


@query("""SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN event_type ELSE event_type || '-' || row_number() OVER w END AS new_id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def renamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.rename_used(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "new_id")


@query("""WITH c AS (SELECT user_id, event_id, CASE event_id % 9 WHEN 0 THEN 'frontmatter' WHEN 3 THEN 'appendix' WHEN 5 THEN 'mainmatter' ELSE 'include' END AS command, event_type FROM events),
r AS (SELECT *, coalesce(last_value(CASE command WHEN 'frontmatter' THEN 'front' WHEN 'appendix' THEN 'appendix' WHEN 'mainmatter' THEN 'main' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'main') AS role FROM c) SELECT user_id, event_id AS pos, event_type AS stem, role FROM r WHERE command = 'include'""")
def master_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 9
    command = F.when(k == 0, "frontmatter").when(k == 3, "appendix").when(k == 5, "mainmatter").otherwise("include")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), command.alias("command"), F.concat(F.lit(" "), "event_type", F.lit(".tex ")).alias("argument"))
    return books.book_outline(rows, ["user_id"])


@query("""WITH e AS (SELECT conv_id, turn, role AS slug, length(text) % 5 AS title, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations), p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'other' || turn END AS slug, length(text) % 5 AS title FROM conversations),
pn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, slug ORDER BY turn) AS n FROM p), f AS (SELECT e.conv_id, e.turn, pn.turn AS page FROM e JOIN pn USING (conv_id, slug, n)),
e2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, title ORDER BY turn) AS m FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = e.conv_id AND f.turn = e.turn)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, title ORDER BY turn) AS m FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = p.conv_id AND f.page = p.turn)),
s AS (SELECT e2.conv_id, e2.turn, p2.turn AS page FROM e2 JOIN p2 USING (conv_id, title, m))
SELECT e.conv_id, e.turn AS pos, coalesce(f.page, s.page) AS page FROM e LEFT JOIN f USING (conv_id, turn) LEFT JOIN s ON s.conv_id = e.conv_id AND s.turn = e.turn""")
def outline_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    title = (F.length("text") % 5).alias("title_slug")
    pages = rows.select("conv_id", F.col("turn").alias("page"), F.when(F.col("turn") % 2 == 0, "user").otherwise(F.concat(F.lit("other"), "turn")).alias("slug"), title, F.col("turn").alias("seq"))
    return books.outline_pages(rows.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("slug"), title), pages, ["conv_id"])


_CHAPTERS = """l AS (SELECT l_orderkey AS book, l_linenumber AS chapter, l_partkey * 1000 + l_suppkey AS pos, l_returnflag, l_quantity FROM lineitem)"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("chapter_pos"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), "l_returnflag", "l_quantity", "l_partkey")


@query(f"""WITH {_CHAPTERS} SELECT DISTINCT book, pos, chapter, CAST(dense_rank() OVER (PARTITION BY book ORDER BY chapter) AS INT) AS chapter_number FROM l""")
def chapter_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chapters(spark, sf_dir).withColumn("is_intro", F.col("l_returnflag") == "R")
    return books.chapter_numbers(rows, ["book"]).select("book", "pos", F.col("chapter_pos").alias("chapter"), "chapter_number").distinct()


_BAKED = """b AS (SELECT p_partkey, p_brand, p_size, p_type, p_name, p_partkey % 3 = 0 AS plain FROM part)"""


@query(f"""WITH {_BAKED}, n AS (SELECT *, CAST(sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS n FROM b)
SELECT p_partkey, CASE WHEN NOT plain THEN n END AS number, CASE WHEN NOT plain THEN 'Equation ' || substr(p_brand, 7) || '.' || n END AS label FROM n""")
def equation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("chapter", F.substring("p_brand", 7, 9))
    return baking.numbered(rows, ["p_brand"], ["p_partkey"], "Equation", "chapter", F.col("p_partkey") % 3 != 0).select("p_partkey", "number", "label")


@query("""SELECT l_orderkey, l_partkey, CAST(row_number() OVER w AS INT) AS number, row_number() OVER w % 2 = 1 AND l_linestatus = 'O' AS has_solution FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_quantity FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus, l_quantity)""")
def exercise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_quantity").distinct().withColumn("has_solution", F.col("l_linestatus") == "O")
    return baking.numbered_exercises(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity"], "even").select("l_orderkey", "l_partkey", "number", "has_solution")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place FROM part WHERE p_type = 'ECONOMY'")
def end_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("class"), F.col("p_partkey").alias("pos"))
    return baking.end_sections(rows, ["p_brand"], "ECONOMY").select("p_partkey", "place")


@query("SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY term, meaning) AS INT) AS place FROM (SELECT p_brand, p_name AS term, p_type AS meaning, count(*) AS n FROM part GROUP BY ALL)")
def glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baking.glossary(table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("term"), F.col("p_type").alias("meaning")), ["p_brand"])


@query(r"""WITH w AS (SELECT DISTINCT regexp_extract(coalesce(text, ''), '^[^ .,\n]+') AS w FROM documents), k AS (SELECT w, lower(strip_accents(w)) AS p FROM w WHERE regexp_full_match(strip_accents(w), '[A-Za-z]+') AND NOT contains(w, 'ß'))
SELECT w AS term, upper(substr(p, 1, 1)) AS letter, dense_rank() OVER (PARTITION BY substr(p, 1, 1) ORDER BY p) AS place FROM k""")
def collated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^ .,\n]+", 0)
    rows = table(spark, sf_dir, "documents").select(word.alias("term")).distinct().filter(baking.unmarked(F.col("term")).rlike("^[A-Za-z]+$") & (F.instr("term", "ß") == 0))
    key = baking.collation_key(F.col("term"))["primary"]
    return rows.withColumn("letter", baking.index_letter(F.col("term"))).withColumn("place", F.dense_rank().over(Window.partitionBy("letter").orderBy(key)).cast("long"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS number FROM events")
def footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baking.footnotes(table(spark, sf_dir, "events").withColumn("pos", F.col("event_id")), ["user_id"]).select("event_id", "number")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 AND p_partkey IS NOT NULL THEN CASE WHEN p_size > 25 THEN p_name ELSE p_type END WHEN l_linenumber % 2 = 0 THEN '[link]' ELSE 'here' END AS text FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def placeholder_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = baking.target_labels(part.filter("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "[link]").otherwise("here").alias("text"))
    return baking.link_texts(rows, labels).drop("target")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment || '#' || CASE WHEN (SELECT count(*) FROM customer d WHERE d.c_mktsegment = c.c_mktsegment AND d.c_custkey // 10 = c.c_custkey // 10) = 1 THEN CAST(c_custkey // 10 AS VARCHAR) ELSE 'auto' || c_custkey END END AS target FROM orders LEFT JOIN customer c ON c_custkey = o_custkey""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("page"), F.concat(F.lit("auto"), "c_custkey").alias("id"), F.floor(F.col("c_custkey") / 10).cast("string").alias("own"))
    return baking.resolve_links(ids, table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("auto"), "o_custkey").alias("href"))).select("o_orderkey", "target")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS name, row FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS row FROM part)""")
def collected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("pos"), t.slugify("p_name").alias("slug"))
    return baking.collected(rows, ["p_brand"]).select("p_partkey", "name", "row")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS module, p_name AS title, p_partkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON p_partkey = l_partkey")
def assembled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("module"), F.col("p_name").alias("title"))
    return baking.assembled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("module")), modules, ["l_orderkey"])


@query("""SELECT p_name AS source, string_agg(p_name || '--' || p_partkey % 3 || '/' || p_partkey, ',' ORDER BY p_partkey) AS pieces FROM part GROUP BY p_name""")
def pieces_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("--"), F.col("p_partkey") % 3, F.lit("/"), "p_partkey").alias("stem"), F.col("p_partkey").alias("part"))
    return contents.pieces_by_source(rows).select("source", F.array_join("pieces", ",").alias("pieces"))


@query("SELECT DISTINCT replace(p_name, ' ', '-') AS role FROM part WHERE p_partkey % 2 = 0")
def unknown_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat("p_size", F.lit("-key-terms")))
    return contents.unknown_roles(table(spark, sf_dir, "part").select(stem.alias("stem")))


@query("""WITH g AS (SELECT l_orderkey, l_returnflag AS guess, count(*) AS n, min(l_partkey * 100 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_min(guess, (-n, CASE WHEN guess <> 'N' THEN 1 ELSE 0 END, first)) AS value FROM g GROUP BY l_orderkey""")
def part_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("guess"), F.lit("N").alias("whole"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("part"))
    return tables.vote(rows, ["l_orderkey"], "whole")


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 6 = 0 THEN 'a,b' WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS changed FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    old = table(spark, sf_dir, "documents").select(k.alias("key"), F.md5("text").alias("a"), F.col("lang").alias("b"))
    new = table(spark, sf_dir, "documents").select(k.alias("key"), F.when(k % 2 == 0, "x").otherwise(F.md5("text")).alias("a"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("lang")).alias("b"))
    return incremental.changed(old, new, "key", ["a", "b"]).select("key", F.array_join("changed", ",").alias("changed"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS result FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'again' FROM documents WHERE doc_id % 8 = 0""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("result"), "doc_id")
    fresh = rows.filter("doc_id % 4 = 0").select("path", F.lit("new").alias("result")).unionByName(rows.filter("doc_id % 8 = 0").select("path", F.lit("again").alias("result")))
    return incremental.store(rows.drop("doc_id"), fresh)


@query("""SELECT doc_id AS path, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS current FROM documents""")
def current_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("sha"), F.lit("o").alias("options"))
    states = rows.filter("path % 3 <> 0").withColumn("options", F.when(F.col("path") % 2 == 0, "o").otherwise("p"))
    return incremental.report_current(states, rows, ["path"], ["sha", "options"])


@query("""SELECT c_nationkey, sha256(string_agg(DISTINCT c_mktsegment || '=' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 3 AS VARCHAR) END, chr(10) ORDER BY c_mktsegment || '=' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 3 AS VARCHAR) END)) AS digest FROM customer GROUP BY c_nationkey""")
def settings_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 3).alias("value"))
    return incremental.settings_digest(rows, ["c_nationkey"])


@query("""SELECT user_id AS "where", 'axe:' || event_type AS "check", min(event_type || '!') || CASE WHEN count(*) > 1 THEN ' (' || count(*) || ' elements, first: ' ELSE ' (' END || min(props) || ')' AS detail FROM events GROUP BY user_id, event_type""")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("rule"), F.col("props").alias("element"), F.concat("event_type", F.lit("!")).alias("summary"))
    return findings.rule_findings(rows, "axe:")


@query("""SELECT event_type AS rule, CAST(floor(value / 20) AS BIGINT) AS reason, count(*) AS n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(floor(value / 20) AS BIGINT)) AS INT) AS place FROM events GROUP BY 1, 2""")
def undecided_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.undecided_reasons(table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.floor(F.col("value") / 20).cast("long").alias("reason")))


@query("""SELECT lang AS target, source AS kind, count(*) AS n, count(DISTINCT doc_id // 2) AS n_pages, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS INT) AS place FROM documents GROUP BY 1, 2""")
def fidelity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.fidelity(table(spark, sf_dir, "documents").select(F.col("lang").alias("target"), F.col("source").alias("kind"), F.floor(F.col("doc_id") / 2).alias("page")))


@query("""SELECT page_id, regexp_replace(array_to_string(list_filter(string_split(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/'), lambda x: x <> '')[2:], '/'), '([^./])\\.[^./]*$', '\\1') AS key FROM pages""")
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(compare.reference_key(F.concat(F.lit("./"), path), F.lit("index.html")), F.lit("")).alias("key"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN CASE WHEN c_custkey % 100 <= 50 THEN CAST(c_custkey % 100 AS VARCHAR) END WHEN 2 THEN c_mktsegment WHEN 3 THEN '2024-02-29' WHEN 5 THEN 'en-US' END AS value,
CASE WHEN c_custkey % 6 = 1 AND c_custkey % 100 > 50 THEN 'is not a number in range' WHEN c_custkey % 6 = 4 THEN 'is not a date' END AS problem FROM customer""")
def coerced_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    kinds = [t.coerced(F.lit(" Yes "), "bool"), t.coerced((k % 100).cast("string"), "int", 0, 50), t.coerced(F.lower("c_mktsegment"), "enum", allowed=segments), t.coerced(F.lit("2024-02-29"), "date"), t.coerced(F.lit("2023-02-29"), "date"), t.coerced(F.lit("EN_us"), "language")]
    x = F.get(F.array(*kinds), (k % 6).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", x["value"].alias("value"), x["problem"].alias("problem"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'is no file''s name' WHEN 1 THEN 'names a device' WHEN 2 THEN 'is no file''s name' END AS problem FROM customer""")
def file_name_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select("c_custkey", t.filename_problem(F.when(k == 0, F.col("c_name")).when(k == 1, "con.a.b").when(k == 2, "a..b").otherwise(F.col("c_mktsegment"))).alias("problem"))
