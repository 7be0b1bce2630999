"""Queries for findings, links, decks, decisions, lookups, surgery, books and baking, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as t
from folioquarry.operators import alttext, baking, books, compare, contents, criteria, decisions, decks, findings, links, lookups, page_rules, sequences, surgery, tables
from folioquarry.plans.queries import _grids, query, table
from folioquarry.streaming import incremental

_CHECKS = "(VALUES ('click', 'image-without-alt', 'error', 'WCAG 2.0 SC 1.1.1 (A)', 'sidecar'), ('view', 'heading-skips-level', 'warning', 'WCAG 2.0 SC 1.3.1 (A)', 'source'), ('error', 'axe:other', 'note', '', 'manual')) k(kind, \"Check\", \"Severity\", \"Standard\", \"Fix\")"
_FOUND = f"""f AS (SELECT CAST(user_id AS VARCHAR) AS "Where", coalesce(k."Check", 'made-up') AS "Check", props AS "Detail", coalesce("Severity", 'warning') AS "Severity", coalesce("Standard", '') AS "Standard", coalesce("Fix", 'manual') AS "Fix" FROM events LEFT JOIN {_CHECKS} ON event_type = k.kind)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    check = F.when(kind == "click", "image-without-alt").when(kind == "view", "heading-skips-level").when(kind == "error", "axe:other").otherwise("made-up")
    return findings.finalize(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("where"), check.alias("check"), F.col("props").alias("detail")))


@query(f"""WITH {_FOUND} SELECT "Where", "Check", "Detail", '' AS "File", 'HTML' AS "Kind", "Severity", "Standard", '' AS "Tool", "Fix" FROM f""")
def findings_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"""WITH {_FOUND} SELECT "Check" AS "check", count(*) AS n FROM f GROUP BY 1""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summarize(_findings(spark, sf_dir))


@query(f"""WITH {_FOUND} SELECT 'severity' AS "by", "Severity" AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'check', "Check", count(*) FROM f GROUP BY 2""")
def findings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary_lines(_findings(spark, sf_dir))


@query(f"""WITH {_FOUND} SELECT "Where", "Check", count(*) AS n, min("Detail") AS "Detail" FROM f GROUP BY 1, 2""")
def findings_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.folded(_findings(spark, sf_dir))


@query(f"""WITH {_FOUND}, c AS (SELECT "Severity", count(*) AS n FROM f GROUP BY 1)
SELECT '## ' || "Where" AS line, "Where" AS file, 0 AS place FROM f GROUP BY "Where" UNION ALL
SELECT '- ' || "Severity" || ': ' || "Check" || ' (' || count(*) || ')', "Where", CAST(row_number() OVER (PARTITION BY "Where" ORDER BY "Check", "Severity") AS INT) FROM f GROUP BY "Where", "Check", "Severity" """)
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.report_lines(_findings(spark, sf_dir))


_FACTS = """f AS (SELECT CAST(conv_id AS VARCHAR) AS name, list('t' || turn ORDER BY turn) AS ids, list('#t' || (turn + 1) ORDER BY turn) AS links FROM conversations GROUP BY conv_id)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("name"))
    near = F.array(F.concat(F.lit("#t"), (F.col("turn") + 1).cast("string")), F.concat((F.col("conv_id") + 1).cast("string"), F.lit("#t%30")), F.concat(F.lit("x/../"), F.col("conv_id").cast("string"), F.lit("?q#/t0")))
    return rows.agg(F.array_sort(F.collect_list(F.concat(F.lit("t"), turn))).alias("ids"), F.flatten(F.collect_list(near)).alias("links")).withColumn("presentation", F.lit(False))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), t AS (SELECT conv_id, turn FROM conversations),
l AS (SELECT conv_id, conv_id AS target, turn + 1 AS wanted, '#t' || (turn + 1) AS href FROM t UNION ALL SELECT conv_id, conv_id + 1, 0, (conv_id + 1) || '#t%30' FROM t)
SELECT CAST(l.conv_id AS VARCHAR) AS "where", 'link-to-missing-fragment' AS "check", href AS detail FROM l JOIN c ON c.conv_id = l.target WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = l.target AND t.turn = l.wanted)
UNION ALL SELECT CAST(l.conv_id AS VARCHAR), 'link-to-missing-file', href FROM l WHERE l.target NOT IN (SELECT conv_id FROM c)
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'link-to-missing-file', 'x/../' || conv_id || '?q#/t0' FROM t""")
def fragment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.check_links(_facts(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, turn, role FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS name, '#/' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE role || '/2' END AS href, CAST(conv_id AS VARCHAR) AS target,
CASE WHEN conv_id % 2 = 1 THEN '/' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE role || '/2' END WHEN turn % 2 = 0 THEN '' ELSE role END AS fragment FROM t""")
def deck_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("#/"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.concat("role", F.lit("/2"))))
    facts = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name"), F.array(href).alias("links"), (F.col("conv_id") % 2 == 0).alias("presentation"))
    return links.internal_links(facts).select("name", "href", "target", "fragment")


@query("""WITH p AS (SELECT page_id, CASE WHEN split_part(url, '?', 1) LIKE '%/' THEN split_part(url, '?', 1) || 'index.html' ELSE split_part(url, '?', 1) END AS bare, CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?')) ELSE '' END AS q, url FROM (SELECT page_id, split_part(url, '#', 1) AS url FROM pages)),
known AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN bare ELSE bare || q END AS page FROM p), r AS (SELECT page_id, bare || CASE WHEN page_id % 3 = 0 THEN '?none=1' ELSE q END AS full_, bare FROM p)
SELECT page_id, coalesce(a.page, b.page) AS page FROM r LEFT JOIN known a ON a.page = full_ LEFT JOIN known b ON b.page = bare""")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", t.canonical("url").alias("full"))
    bare = F.split_part("full", F.lit("?"), F.lit(1))
    known = pages.select(F.when(F.col("page_id") % 2 == 0, bare).otherwise(F.col("full")).alias("url"))
    refs = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(bare, F.lit("?none=1#x"))).otherwise(F.col("full")).alias("url"))
    return links.page_key(refs, known).select("page_id", "page")


@query("""WITH u AS (SELECT 'kept' AS bucket, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 3 = 0), a AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS key, l_linenumber % 2 = 0 AS page FROM lineitem)
SELECT 'missing-file' AS bucket, key FROM (SELECT DISTINCT key FROM a WHERE NOT page EXCEPT SELECT key FROM u) UNION ALL SELECT 'missing-page', key FROM (SELECT DISTINCT key FROM a WHERE page EXCEPT SELECT key FROM u) UNION ALL SELECT 'orphan', key FROM (SELECT key FROM u EXCEPT SELECT key FROM a)""")
def reference_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.when(F.col("l_linenumber") % 2 == 0, "page").otherwise("asset").alias("kind"))
    have = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key"))
    return compare.references(refs, have, have)


@query("""WITH i AS (SELECT p_brand AS name, p_partkey || '.png' AS src, p_name AS alt FROM part), g AS (SELECT alt, count(DISTINCT src) - 1 AS others FROM i GROUP BY alt HAVING count(DISTINCT src) > 1)
SELECT name AS "where", 'image-alt-shared' AS "check", src || ': ''' || alt || ''' (shared with ' || others || ' other image' || CASE WHEN others = 1 THEN '' ELSE 's' END || ')' AS detail FROM i JOIN g USING (alt)""")
def shared_alts(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.struct(F.lit(True).alias("has_alt"), F.col("p_name").alias("alt"), F.lit(False).alias("decorative"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("src"))
    facts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.array(image).alias("images"))
    return page_rules.check_shared_alt(facts)


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber % 2 = 0 AS th, l_partkey % 3 = 0 AS td, l_suppkey % 4 = 0 AS caption, CASE WHEN l_quantity > 45 THEN 'presentation' END AS role, l_discount > 0.05 AS wrapped, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS INT) AS n FROM lineitem)
SELECT CAST(k AS VARCHAR) AS "where", c AS "check", 'table ' || n AS detail FROM (SELECT k, n, unnest([CASE WHEN NOT th AND NOT caption THEN 'table-without-headers-or-caption' END, CASE WHEN th AND NOT td THEN 'table-without-data-cells' END, CASE WHEN NOT wrapped THEN 'table-not-in-scroll-region' END]) AS c FROM x WHERE role IS NULL) WHERE c IS NOT NULL""")
def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    fact = F.struct((F.col("l_linenumber") % 2 == 0).alias("has_th"), (F.col("l_suppkey") % 4 == 0).alias("has_caption"), F.when(F.col("l_quantity") > 45, "presentation").alias("role"), (F.col("l_discount") > 0.05).alias("wrapped"), (F.col("l_partkey") % 3 == 0).alias("has_td"))
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), fact.alias("f")))), lambda x: x["f"]).alias("tables"))
    facts = each.withColumn("formula_headers", F.expr("cast(array() as array<struct<tbl:int,tex:string>>)"))
    return facts.select(F.col("name").alias("where"), F.inline(F.concat(*page_rules.table_rules())))


_BOXES = """b AS (SELECT l_orderkey AS slide, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq, l_partkey % 97 AS x, l_suppkey % 89 AS y, 5 + l_partkey % 7 AS w, 4 + l_suppkey % 5 AS h, l_linenumber = 7 AS title FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    number = p * 1000000 + s * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("d").alias("deck"), F.col("l_orderkey").alias("slide"), number.alias("seq"), (p % 97).alias("x"), (s % 89).alias("y"), (5 + p % 7).alias("w"), (4 + s % 5).alias("h"),
        (F.col("l_linenumber") == 7).alias("is_title"), F.lit(False).alias("decorative"), number.alias("shape_id"),
    )


@query(f"""WITH {_BOXES}, p AS (SELECT a.slide, a.title AS ta, b.title AS tb, (b.y + b.h <= a.y OR (b.y < a.y + a.h AND a.y < b.y + b.h AND b.x + b.w / 2.0 < a.x + a.w / 2.0)) AS flips FROM b a JOIN b ON a.slide = b.slide AND a.seq < b.seq)
SELECT slide, count(*) AS inversions FROM p WHERE flips AND NOT ta OR tb GROUP BY slide""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks.reading_order(_boxes(spark, sf_dir)).drop("deck")


@query(f"""WITH {_BOXES}, o AS (SELECT a.slide, a.seq AS first, b.seq AS second FROM b a JOIN b ON a.slide = b.slide AND a.seq < b.seq WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
r AS (SELECT slide, seq, row_number() OVER (PARTITION BY slide ORDER BY y, x, seq) AS rank FROM (SELECT DISTINCT slide, seq, x, y FROM b))
SELECT DISTINCT o.slide, first, second FROM o JOIN r a ON a.slide = o.slide AND a.seq = first JOIN r b ON b.slide = o.slide AND b.seq = second WHERE a.rank > b.rank""")
def draw_order_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    boxes = _boxes(spark, sf_dir).dropDuplicates(["slide", "seq"])
    order = boxes.select("deck", "slide", "shape_id", F.row_number().over(Window.partitionBy("deck", "slide").orderBy("y", "x", "seq")).alias("rank"))
    return decks.violations(boxes, order).drop("deck")


_SHAPES = """s AS (SELECT conv_id AS slide, turn AS shape_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, CASE length(text) % 4 WHEN 0 THEN 'picture' WHEN 1 THEN 'shape' WHEN 2 THEN 'group' ELSE 'text' END AS kind,
CASE WHEN length(text) % 8 = 1 THEN '' ELSE text END AS text, CASE WHEN length(text) % 5 = 0 THEN 'told' ELSE '' END AS descr FROM conversations)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.length("text"), F.col("turn")
    kind = F.when(n % 4 == 0, "picture").when(n % 4 == 1, "shape").when(n % 4 == 2, "group").otherwise("text")
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.lit("d").alias("deck"), F.col("conv_id").alias("slide"), turn.alias("shape_id"), F.when(turn > 0, turn - 1).alias("parent_id"), kind.alias("kind"), F.when(n % 8 == 1, "").otherwise(F.col("text")).alias("text"), F.when(n % 5 == 0, "told").otherwise("").alias("descr"), F.lit(False).alias("decorative"))


@query(f"""WITH {_SHAPES} SELECT slide, shape_id, CASE WHEN kind IN ('picture', 'group') THEN 'object' ELSE 'shape' END AS needs FROM s a WHERE (kind IN ('picture', 'group') OR kind = 'shape' AND trim(text) = '') AND descr = ''
AND NOT EXISTS (SELECT 1 FROM s b WHERE b.slide = a.slide AND b.shape_id < a.shape_id AND b.descr <> '')""")
def missing_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks.missing_alt(_shapes(spark, sf_dir)).select("slide", "shape_id", decks.needs_alt().alias("needs"))


@query("""SELECT conv_id AS slide, turn AS shape_id FROM conversations WHERE length(text) - length(replace(text, ' ', '')) >= 3""")
def tab_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("slide"), F.col("turn").alias("shape_id"), F.concat(F.lit("a"), F.regexp_replace("text", r"[^ ]", ""), F.lit("b")).alias("text"))
    return decks.tab_tables(rows.withColumn("text", F.replace("text", F.lit(" "), F.lit("\t")))).drop("text")


@query("""WITH w AS (SELECT user_id % 50 AS slide, list_filter(regexp_split_to_array(event_type, '\\s+'), lambda x: x <> '') AS words FROM events) SELECT slide, count(*) AS n FROM w WHERE len(words) <= 2 GROUP BY slide HAVING count(*) >= 8""")
def drawn_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("d").alias("deck"), (F.col("user_id") % 50).alias("slide"), F.lit("shape").alias("kind"), F.col("event_type").alias("text"), F.lit(None).cast("int").alias("parent_id"))
    return decks.drawn_diagrams(rows).drop("deck")


@query("SELECT p_name AS image, count(DISTINCT p_size) AS crops FROM part GROUP BY p_name HAVING count(DISTINCT p_size) > 1")
def cropped_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks.cropped_apart(table(spark, sf_dir, "part").select(F.col("p_name").alias("image"), F.col("p_partkey").alias("slide"), F.col("p_size").alias("crop")))


@query("""WITH r AS (SELECT p_name AS image, p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END AS alt, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT image, array_to_string(list(p_brand ORDER BY p_partkey) FILTER (k <= 12), ',') AS places, array_to_string(list_sort(list(DISTINCT coalesce(alt, '<absent>'))), ',') AS states FROM r GROUP BY image""")
def alt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("image"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("place"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("alt"))
    return decks.alt_rows(rows).select("image", F.array_join("places", ",").alias("places"), F.array_join("states", ",").alias("states"))


@query("""WITH w AS (SELECT c_custkey, c_custkey % 10 AS a, c_custkey // 10 % 10 AS b, c_custkey // 100 % 10 AS c FROM customer), f AS (SELECT n_name AS face, n_nationkey % 10 AS a, n_nationkey // 3 AS b, n_regionkey AS c FROM nation)
SELECT c_custkey, first(face ORDER BY d, face) AS nearest, min(d) AS distance FROM (SELECT c_custkey, face, CAST(abs(w.a - f.a) + abs(w.b - f.b) + abs(w.c - f.c) AS DOUBLE) AS d FROM w, f) GROUP BY c_custkey""")
def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    digit = lambda x, by: (F.floor(x / by) % 10).cast("int")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.array(digit(k, 1), digit(k, 10), digit(k, 100)).alias("panose"))
    fonts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("face"), F.array((n % 10).cast("int"), F.floor(n / 3).cast("int"), F.col("n_regionkey").cast("int")).alias("panose"))
    return decks.nearest(wanted, fonts).drop("panose")


@query("""SELECT user_id, arg_max(event_type, event_id) AS said, max(event_id) AS row_no, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id""")
def sidecar_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("said"), F.col("event_id").alias("row_no"))
    return decisions.last_rows(rows, ["user_id"])


@query("""WITH r AS (SELECT c_custkey AS row_no, 'books/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '.docx' ELSE '.zip' END AS source FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 5 = 0),
m AS (SELECT row_no, source, CASE WHEN row_no >= 1000000 THEN row_no - 1000000 WHEN row_no % 2 = 0 THEN row_no END AS page FROM r) SELECT row_no, source, page FROM (SELECT *, max(row_no) OVER (PARTITION BY page) AS last FROM m) WHERE page IS NULL OR row_no = last""")
def rows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = c.select(F.col("c_custkey").alias("row_no"), F.concat(F.lit("books/"), "c_name", F.when(F.col("c_custkey") % 2 == 0, ".docx").otherwise(".zip")).alias("source"))
    rows = first.unionByName(c.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("row_no"), F.col("c_name").alias("source")))
    pages = c.select(F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"), F.col("c_custkey").alias("page"))
    return lookups.match_pages(rows, pages).select("row_no", "source", "page")


@query("""WITH u AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'http://a.org/' || user_id ELSE 'b' || user_id END AS url, 'http://a.org/' || user_id AS href, event_type AS source, event_id AS seq, props AS context FROM events WHERE event_id % 3 = 0),
o AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM labels WHERE 'http://a.org/' || doc_id = url AND quality = 1)), s AS (SELECT url, source, min(seq) AS seq FROM o GROUP BY 1, 2)
SELECT url, string_agg(source, '; ' ORDER BY seq) AS sources, (SELECT arg_min(context, seq) FROM o WHERE o.url = s.url) AS context FROM s GROUP BY url""")
def bare_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    href = F.concat(F.lit("http://a.org/"), user)
    uses = lookups.bare_uses(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a.org/"), user, F.lit("/"))).otherwise(F.concat(F.lit("b"), user)).alias("text"), href.alias("href"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.col("props").alias("context")))
    sidecar = table(spark, sf_dir, "labels").select(F.concat(F.lit("http://a.org/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("quality") == 1, "x").alias("replacement"))
    return decisions.bare_links(uses.withColumnRenamed("href", "url"), sidecar)


@query("""WITH i AS (SELECT p_partkey, 'm/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.png' ELSE '.jpg' END AS src FROM part), s AS (SELECT 'm/' || p_partkey || '.png' AS path, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS alt, p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT i.p_partkey, CASE WHEN i.p_partkey % 3 = 0 OR i.p_partkey % 7 <> 0 THEN alt END AS alt_in_effect FROM i LEFT JOIN s USING (p_partkey)""")
def alt_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("m/"), k.cast("string"))
    images = part.select("p_partkey", F.concat(stem, F.when(k % 3 == 0, ".png").otherwise(".jpg")).alias("src"))
    sidecar = part.filter("p_partkey % 5 <> 0").select(F.concat(stem, F.lit(".png")).alias("path"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("alt"))
    files = images.select(F.col("src").alias("path")).unionByName(part.filter("p_partkey % 7 = 0").select(F.concat(stem, F.lit(".svg")).alias("path")))
    return lookups.alt_for(images, sidecar, files).drop("src")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN a.c_mktsegment ELSE b.c_mktsegment END AS caption FROM part LEFT JOIN customer a ON a.c_custkey = p_partkey LEFT JOIN customer b ON b.c_custkey = p_partkey + 1""")
def captions_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("label"), F.concat(F.lit("t"), k + F.when(k % 2 == 0, 0).otherwise(1)).alias("fallback"))
    sidecar = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), "c_custkey").alias("key"), F.col("c_mktsegment").alias("caption"))
    return lookups.description_for(rows, sidecar).select("p_partkey", "caption")


@query("""SELECT o_orderkey, CASE WHEN n = o_orderkey % 5 THEN 'both' END AS value, coalesce(n <> o_orderkey % 5, false) AS mismatched FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def resolved_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("stem"), (F.col("o_orderkey") % 5).alias("rows"))
    entries = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stem")).agg(F.count("*").alias("rows")).withColumn("value", F.lit("both"))
    return lookups.resolved_for(rows, entries, ["stem"], ["rows"]).select("o_orderkey", "value", "mismatched")


@query("""WITH h AS (SELECT l_orderkey AS source, min(l_linenumber) AS first FROM lineitem GROUP BY 1), i AS (SELECT DISTINCT l_orderkey AS source, l_linenumber AS n FROM lineitem)
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN h.source IS NULL THEN o_orderkey || '.html' ELSE o_orderkey || '--' || first || '.html' END ELSE CASE WHEN i.source IS NULL THEN o_orderkey || '.html#i3' ELSE o_orderkey || '--3.html#i3' END END AS target
FROM orders LEFT JOIN h ON h.source = o_orderkey LEFT JOIN i ON i.source = o_orderkey AND i.n = 3""")
def retargeted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey").cast("string")
    homes = table(spark, sf_dir, "lineitem").select(key.alias("source"), F.concat(F.lit("i"), "l_linenumber").alias("id"), F.concat(key, F.lit("--"), "l_linenumber").alias("piece"), F.col("l_linenumber").alias("part"))
    order = F.col("o_orderkey").cast("string")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(order, F.when(F.col("o_custkey") % 2 == 0, ".html").otherwise(".html#i3")).alias("href"))
    return lookups.retarget_links(refs, homes).select("o_orderkey", "target")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey < (SELECT count(*) FROM part) THEN c_custkey || '.html#x' WHEN c_custkey % 2 = 0 THEN 'https://p.org/books/b/pages/' || c_custkey || '#x' WHEN c_custkey < (SELECT count(*) FROM part) THEN c_custkey || '.html' ELSE c_custkey || '.md' END AS target FROM customer""")
def publisher_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    refs = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://p.org/books/b/pages/"), k, F.lit("#x"))).otherwise(F.concat(k, F.lit(".md"))).alias("href"))
    return lookups.local_pages(refs, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stem"))).select("c_custkey", "target")


@query("""WITH i AS (SELECT DISTINCT p_name AS id, p_brand AS page FROM part), g AS (SELECT id, count(*) AS n, min(page) AS there FROM i GROUP BY id)
SELECT p_partkey, CASE WHEN i.id IS NOT NULL THEN 'Brand#11' WHEN n = 1 THEN there END AS home, i.id IS NULL AND n > 1 AS ambiguous FROM part JOIN g ON g.id = p_name LEFT JOIN i ON i.id = p_name AND i.page = 'Brand#11'""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    refs = part.select("p_partkey", F.col("p_name").alias("id"), F.lit("Brand#11").alias("page"))
    return lookups.resolve_ids(refs, part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("page"), F.col("p_type").alias("title"))).select("p_partkey", "home", "ambiguous")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang ELSE NULL END AS language, CASE doc_id % 3 WHEN 0 THEN CASE WHEN lang <> 'en' THEN 'en' END WHEN 1 THEN CASE WHEN lang <> 'de' THEN 'de' END END AS replacing FROM documents""")
def copy_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    source = F.when(k == 0, "sidecar").when(k == 1, "producer").otherwise("project")
    marks = F.when(k == 0, "en").when(k == 1, "de").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", lookups.for_copy(source, F.col("lang"), marks, F.lit(False)).alias("x")).select("doc_id", "x.language", "x.replacing")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN '[missing: ' || l_partkey || ']' ELSE p_name END AS body, p_partkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""")
def injected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("body"))
    return lookups.inject(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), bank, ["l_partkey"])


@query("SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def wanted_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.wanted(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"])


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS path FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def media_without_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"))
    return lookups.media_gate(refs, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.greatest(F.col("p_size") - 25, F.lit(0)).alias("size")))


@query("SELECT conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def unlinked_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    marks = rows.select("conv_id", "turn", F.concat(F.lit("b"), "turn").alias("name"))
    return lookups.unlinked_bookmarks(marks, rows.select("conv_id", F.concat(F.lit("b"), F.col("turn") - 1).alias("target")), ["conv_id"]).select("conv_id", "turn")


@query("""WITH l AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), t AS (SELECT user_id, props AS tip, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0) SELECT event_id, tip FROM l LEFT JOIN t USING (user_id, n)""")
def screentips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), F.col("event_id").alias("pos"), F.col("props").alias("tip"))
    return lookups.screentips(rows.drop("tip"), rows.filter("event_id % 2 = 0")).select("event_id", "tip")


@query("SELECT doc_id AS page, lang AS language FROM documents WHERE lang <> 'en' AND doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "file").otherwise("project").alias("source"))
    return lookups.language_rows(pages, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")), "en-US")
