"""Queries for configuration, sites, repairs and the remaining book operators, each over a whole table."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import repairs
from folioquarry.operators import alttext, baking, books, compare, config, lookups, sites
from folioquarry.plans.book_queries import _outline
from folioquarry.plans.queries import query, table

_SETTINGS = [("limit", "int", "10", 0.0, 50.0, None, False, False), ("kind", "enum", "none", None, None, ["click", "view", "purchase"], False, False), ("flag", "bool", "false", None, None, None, False, False), ("note", "string", "x", None, None, None, False, False)]
_SAID = """s AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'limit' WHEN 1 THEN 'kind' WHEN 2 THEN 'flag' ELSE 'odd' END AS key, event_type, event_id % 80 AS n FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY event_id DESC) AS k FROM s) WHERE k = 1), u AS (SELECT DISTINCT user_id FROM events),
w AS (SELECT user_id, k.key, k.dflt FROM u, (VALUES ('limit', '10'), ('kind', 'none'), ('flag', 'false'), ('note', 'x')) k(key, dflt))"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, quoted = F.col("event_id"), F.concat(F.lit('"'), F.upper("event_type"), F.lit('"'))
    key = F.when(k % 4 == 0, "limit").when(k % 4 == 1, "kind").when(k % 4 == 2, "flag").otherwise("odd")
    value = F.when(k % 4 == 0, (k % 80).cast("string")).when(k % 4 == 1, quoted).when(k % 4 == 2, F.when(k % 80 >= 40, '"Yes"').when(k % 80 >= 20, "true")).otherwise(quoted)
    return table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("s"), k.cast("string")).alias("source"), k.alias("layer"), key.alias("key"), value.alias("value"))


@query(f"""WITH {_SAID} SELECT w.user_id, w.key, CASE WHEN l.key IS NULL THEN dflt WHEN w.key = 'limit' THEN CASE WHEN n <= 50 THEN CAST(n AS VARCHAR) ELSE dflt END WHEN w.key = 'kind' THEN CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE dflt END
WHEN n >= 20 THEN 'true' ELSE dflt END AS value, 's' || event_id AS source, CASE WHEN w.key = 'limit' AND n > 50 THEN 'is not a whole number in range' WHEN w.key = 'kind' AND event_type NOT IN ('click', 'view', 'purchase') THEN 'is not one of the choices' END AS problem
FROM w LEFT JOIN l USING (user_id, key) UNION ALL SELECT user_id, key, '"' || upper(event_type) || '"', 's' || event_id, 'is no setting' FROM l WHERE key = 'odd'""")
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.createDataFrame(_SETTINGS, config.SCHEMA)
    return config.resolve(_settings(spark, sf_dir), schema, ["user_id"])


@query("""SELECT 's' || event_id AS source, CASE WHEN event_id % 2 = 0 THEN 'defaults' ELSE 'target' END AS block, CASE WHEN event_id % 3 = 0 THEN 'file' ELSE 'title' END AS key, CASE WHEN event_id % 2 = 0 THEN 'belongs to a target' ELSE 'belongs to defaults' END AS problem
FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 OR event_id % 3 <> 0 AND event_id % 2 = 1""")
def misplaced_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.createDataFrame([("file", "path", "", None, None, None, True, False), ("title", "text", "", None, None, None, False, True)], config.SCHEMA)
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), k).alias("source"), F.when(k % 2 == 0, "defaults").otherwise("target").alias("block"), F.when(k % 3 == 0, "file").otherwise("title").alias("key"), F.lit('"v"').alias("value"))
    return config.misplaced(rows, schema)


@query("""SELECT 'c' || c_custkey AS source, 1 AS layer, unnest(['title', 'page.size', 'page.tags']) AS key, unnest(['"' || c_name || '"', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END, '["' || c_mktsegment || '"]']) AS value, CAST(NULL AS VARCHAR) AS problem FROM customer""")
def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("c_custkey") % 3 == 0, "null").otherwise(F.col("c_custkey").cast("string"))
    text = F.concat(F.lit('{"title": "'), "c_name", F.lit('", "page": {"size": '), size, F.lit(', "tags": ["'), "c_mktsegment", F.lit('"]}}'))
    return config.read_settings(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit(1).alias("layer"), text.alias("value")))


@query("""WITH e AS (SELECT user_id AS book, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 4 AS INT) END AS depth, event_type AS title FROM events)
SELECT book, pos, CASE WHEN pos % 2 = 0 THEN repeat('    ', depth) || '- title: "' || title || '"' || chr(10) || repeat('    ', depth) || '  items:' ELSE repeat('    ', depth) || '- page: p' || pos || chr(10) || repeat('    ', depth) || '  title: "' || title || '"' END AS line FROM e""")
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _outline(spark, sf_dir).withColumn("page", F.when(F.col("pos") % 2 == 1, F.concat(F.lit("p"), "pos")))
    return sites.contents_lines(tree, ["book"])


@query("""WITH e AS (SELECT user_id AS book, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 4 AS INT) END AS depth, event_type AS title FROM events), n AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY book ORDER BY pos), 0) AS nxt FROM e)
SELECT book, pos, '<item identifier="I' || pos || '"' || CASE WHEN pos % 2 = 1 THEN ' identifierref="p' || pos || '"' ELSE '' END || '><title>' || title || '</title>' || repeat('</item>', greatest(depth - nxt + 1, 0)) AS line FROM n""")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _outline(spark, sf_dir).withColumn("page", F.when(F.col("pos") % 2 == 1, F.concat(F.lit("p"), "pos")))
    return sites.manifest_lines(tree, ["book"])


@query("""WITH r AS (SELECT p_partkey, p_brand, 'sha1:' || sha1(CAST(p_partkey AS VARCHAR)) AS key, replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '' ELSE '.PDF' END AS name FROM part),
f AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN replace(name, '.jpg', '.png') WHEN 1 THEN name || '.png' ELSE replace(name, '.PDF', '.pdf') END AS file FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, file ORDER BY key) AS n FROM f)
SELECT p_partkey, CASE WHEN n = 1 THEN file ELSE regexp_replace(file, '\\.[a-z]+$', '') || '-' || substr(key, 6, 8) || regexp_extract(file, '\\.[a-z]+$') END AS file FROM n""")
def resource_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 3 == 0, ".jpg").when(k % 3 == 1, "").otherwise(".PDF"))
    head = F.when(k % 3 == 2, F.unhex(F.lit("255044462D"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("sha1:"), F.sha1(k.cast("string").cast("binary"))).alias("key"), name.alias("name"), F.lit(None).cast("string").alias("asked"), head.alias("head"))
    return sites.resource_names(rows, ["p_brand"]).select("p_partkey", "file")


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 100 = 0 THEN '/other/' || p_type || '/' || replace(p_name, ' ', '%20') || '.html' ELSE '/book/' || replace(p_name, ' ', '-') || '.xhtml' END AS path FROM part),
n AS (SELECT *, CASE WHEN p_partkey % 100 = 0 THEN trim(regexp_replace(replace(regexp_replace(substr(path, 2), '\\.html$', ''), '/', '-'), '[^A-Za-z0-9._/-]+', '-', 'g'), '-') ELSE regexp_replace(substr(path, 7), '\\.xhtml$', '') END AS stem FROM p)
SELECT p_brand, stem, count(*) AS n FROM n GROUP BY 1, 2""")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 100 == 0, F.concat(F.lit("/other/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit(".html"))).otherwise(F.concat(F.lit("/book/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".xhtml")))
    pages = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("http://a.org"), path, F.lit("#x"), k.cast("string")).alias("url"))
    named = sites.page_names(pages, ["p_brand"])
    return named.groupBy("p_brand", F.regexp_replace("name", r"-[0-9]+$", "").alias("stem")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment || ' Abc ' || CASE WHEN c_custkey % 2 = 0 THEN 'xyz' ELSE 'x' END || ' end' AS said FROM customer""")
def unspelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_mktsegment", F.lit("  italic upper a b c bold lower "), F.when(F.col("c_custkey") % 2 == 0, "X y z").otherwise("X"), F.lit(" end"))
    return table(spark, sf_dir, "customer").select("c_custkey", repairs.unspelled(text).alias("said"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '<table><thead><tr><td class="a"> </td><th>' || p_name || '</th></tr></thead><tbody><tr><td>' || p_type || '</td></tr></tbody></table>' ELSE '<table><tbody class="h"><tr><td>' || p_name || '</td></tr></tbody></table>' END AS markup FROM part""")
def repaired_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.concat(F.lit('<table><thead><tr><th class="a" scope="col"> </th><th>'), "p_name", F.lit("</th></tr><tr><td>"), "p_type", F.lit("</td></tr></thead></table>"))
    odd = F.concat(F.lit('<table><thead class="h"><tr><td>'), "p_name", F.lit("</td></tr></thead></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", repairs.bodies_out_of_heads(repairs.headers_as_data(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd))).alias("markup"))


@query("""SELECT p_partkey, length(p_name) + 3 || '-' || (length(p_name) + 4 + length(p_type)) || ',' || (length(p_name) + 7 + length(p_type)) || '-' || (length(p_name) + 17 + length(p_type)) AS spans FROM part""")
def skipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("\\% %"), "p_type", F.lit("\nx \\verb|a%b| y"))
    spans = table(spark, sf_dir, "part").select("p_partkey", repairs.spans_to_skip(text).alias("s"))
    return spans.select("p_partkey", F.array_join(F.transform("s", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",").alias("spans"))


@query("""SELECT p_partkey, p_name || ' & ' || p_type AS items FROM part""")
def selected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = F.concat(F.lit('<ul class="x menu"><li><b>'), "p_name", F.lit("</b> &amp; <li>no</ul><div><ul><li class='k' data-n=1>"), "p_type", F.lit("</ul></div>"))
    first, second = repairs.select(markup, "ul.menu b"), repairs.select(markup, "div li.k[data-n=1]")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" & ", first, second).alias("items"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n_words FROM documents""")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lookups.plain_words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))


@query("""SELECT page_id, regexp_replace(url, '[.,;:!?)\\]]+$', '') || ' ' || 'http://b.org/' || page_id AS found FROM pages""")
def textual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("See "), "url", F.lit(", or (http://b.org/"), "page_id", F.lit(")."))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(lookups.textual_links(text), " ").alias("found"))


@query("""WITH s AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 4 = 0 THEN 'image' ELSE p_name END AS alt FROM part WHERE p_partkey % 5 <> 0), g AS (SELECT alt, count(*) - 1 AS others FROM s WHERE alt <> 'image' GROUP BY alt HAVING count(*) > 1)
SELECT path, CASE WHEN alt = 'image' THEN 'says nothing' ELSE 'shared with ' || others || ' other image' || CASE WHEN others = 1 THEN '' ELSE 's' END END AS reasons FROM s LEFT JOIN g USING (alt) WHERE alt = 'image' OR others IS NOT NULL""")
def judged_alts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    seen = table(spark, sf_dir, "part").select(k.cast("string").alias("path"), F.when(k % 4 == 0, "image").otherwise(F.col("p_name")).alias("alt"))
    decided = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(k.cast("string").alias("path"))
    found = alttext.problem(F.col("alt"), limit=None)
    return lookups.judged_alts(seen, decided, found["kind"], alttext.reason(found))


@query("""WITH b AS (SELECT conv_id, turn, turn // 3 AS box, CASE WHEN length(text) % 3 = 0 THEN 1 + length(text) % 4 END AS level FROM conversations), o AS (SELECT *, bool_or(coalesce(level <= 2, false)) OVER (PARTITION BY conv_id, box) AS opens FROM b)
SELECT conv_id, turn AS pos, CASE WHEN NOT opens THEN box END AS box FROM o""")
def lifted_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.floor(F.col("turn") / 3).alias("box"), F.when(n % 3 == 0, 1 + n % 4).alias("level"))
    return books.lift_headings(rows, ["conv_id"], 2).drop("level")


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size % 2 = 0""")
def chapter_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("class"), (F.col("p_size") % 2 == 0).alias("has_solution"), F.col("p_partkey").alias("pos"))
    return baking.solutions(rows, ["p_brand"], ("ECONOMY", "PROMO")).select("p_partkey", "place")


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INT) AS place FROM part""")
def sorted_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baking.sorted_section(table(spark, sf_dir, "part"), ["p_brand"], "p_name", then=("p_partkey",)).select("p_partkey", "place")


@query("""WITH d AS (SELECT o_orderkey AS k, 'both' AS status, CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE 'p' END AS field FROM orders) SELECT status, field, k, example, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status, field ORDER BY k) AS INT) AS example, count(*) OVER (PARTITION BY status, field) AS n FROM d) WHERE example <= 3""")
def differing_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    diff = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit("both").alias("status"), F.when(k % 3 == 0, "s").otherwise("p").alias("field"))
    return compare.field_examples(diff, "k")


@query("""SELECT user_id AS page, CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 3 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def copied_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.when(F.col("event_id") % 3 == 0, "https://a.org/x.png").otherwise(F.col("event_id").cast("string")).alias("path"))
    return lookups.copies(refs, table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("page")))


@query("""SELECT p_partkey, 'x_' || CASE WHEN p_partkey < 10 THEN CAST(p_partkey AS VARCHAR) ELSE '{' || p_partkey || '}' END || '+\\frac{' || p_size || '}{\\mathrm{' || replace(p_name, ' ', '') || '}}' AS tex, '{' || p_size || '\\,\\mathrm{H}_{2}\\mathrm{O} \\rightarrow \\mathrm{Na}^{+}}' AS chemistry FROM part""")
def formulas_as_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.functions import mathml

    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    markup = F.concat(F.lit("<math><msub><mi>x</mi><mrow><mn>"), k, F.lit("</mn></mrow></msub><mo> + </mo><mfrac><mn>"), size, F.lit("</mn><mi>"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("</mi></mfrac></math>"))
    ce = F.concat(F.lit("\\ce{"), size, F.lit("H2O -> Na+}"))
    return table(spark, sf_dir, "part").select("p_partkey", mathml.mathml_as_tex(markup).alias("tex"), mathml.chemistry_as_tex(ce).alias("chemistry"))


@query("""SELECT p_partkey, 'a − ' || p_size || ' = −' || p_partkey AS said, 'x-' || p_size || ' μ' AS tex FROM part""")
def signs_and_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.concat(F.lit("a – "), size, F.lit(" = –"), k)
    return table(spark, sf_dir, "part").select("p_partkey", repairs.minus_signs(said).alias("said"), repairs.equations_repaired(F.concat(F.lit("x–"), size, F.lit(" µ"))).alias("tex"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS module, p_name AS title, '<p id="p' || p_partkey || '">' || p_type || ' <em>' || p_brand || '</em></p>' AS html FROM part""")
def converted_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import cnxml

    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit('<document xmlns="http://cnx.rice.edu/cnxml" id="'), k, F.lit('"><title>'), "p_name", F.lit('</title><content><para id="p'), k, F.lit('">'), "p_type", F.lit(' <emphasis effect="italics">'), "p_brand", F.lit("</emphasis></para></content></document>"))
    return cnxml.read_modules(table(spark, sf_dir, "part").select(k.alias("path"), content.cast("binary").alias("content"))).select("module", "title", "html")


@query("""WITH e AS (SELECT user_id AS book, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(event_id % 4 AS INT) END AS depth, event_type FROM events),
w AS (SELECT *, max(CASE WHEN depth = 0 THEN pos END) OVER w AS p0, max(CASE WHEN depth = 1 THEN pos END) OVER w AS p1, max(CASE WHEN depth = 2 THEN pos END) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, CASE depth WHEN 1 THEN p0 WHEN 2 THEN greatest(p0, p1) WHEN 3 THEN greatest(p0, p1, p2) END AS parent, 'http://a.org/' || book || '/' || CASE WHEN pos % 2 = 0 THEN 's' || pos ELSE CAST(pos AS VARCHAR) END AS address FROM w),
c AS (SELECT book, parent AS pos, string_agg('<li><a href="' || address || '">' || event_type || '</a></li>', '' ORDER BY pos) AS items FROM q WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT q.book, q.pos, q.parent, q.event_type AS title, address, CASE WHEN q.pos % 5 = 0 THEN NULL WHEN q.pos % 3 = 0 THEN '<p>' || q.event_type || '</p>' WHEN items IS NOT NULL THEN '<ul>' || items || '</ul>' END AS body,
CASE WHEN q.pos % 5 = 0 THEN 'chapter-not-captured' WHEN q.pos % 3 <> 0 AND items IS NULL THEN 'chapter-empty' END AS note FROM q LEFT JOIN c USING (book, pos)""")
def course_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outline(spark, sf_dir)
    entries = rows.select("book", "pos", F.col("pos").alias("id"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("s"), "pos")).otherwise("").alias("short_name"), F.concat(F.lit(" "), "title").alias("title"), "depth", F.concat(F.lit("http://a.org/"), "book").alias("root"))
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>"))).otherwise("<p>&nbsp;</p>")
    return books.course_pages(entries, rows.filter("pos % 5 <> 0").select("book", F.col("pos").alias("id"), "title", text.alias("text")), ["book"])


_VERSIONS = """a AS (SELECT conv_id, turn + 1 AS slide, 'T' || turn AS title, turn FROM conversations), p AS (SELECT conv_id, turn, unnest(CASE WHEN turn % 2 = 0 THEN [1, 2] ELSE [1] END) AS part FROM conversations WHERE turn % 5 <> 3 UNION ALL SELECT DISTINCT conv_id, -1, 1 FROM conversations),
b AS (SELECT conv_id, turn, part, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS slide FROM p)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decks of a slide a turn, and their second versions: a slide before all, even turns cut in two, some turns left out.

    A slide that is found further on takes one partner, so the second part of the first turn has none.
    """
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("deck"), "turn")
    items = lambda *x: F.array(*[F.concat(F.lit(c), F.col("turn").cast("string")) for c in x])
    none = F.expr("cast(array() as array<string>)")
    first = rows.select("deck", (F.col("turn") + 1).alias("slide"), F.concat(F.lit("T"), "turn").alias("title"), items("x", "y").alias("items"), none.alias("notes"))
    parts = rows.filter("turn % 5 <> 3").select("deck", "turn", F.explode(F.when(F.col("turn") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part"))
    parts = parts.unionByName(rows.select("deck").distinct().select("deck", F.lit(-1).cast("long").alias("turn"), F.lit(1).alias("part")))
    title = F.when(F.col("turn") < 0, "New").when(F.col("part") == 2, F.concat(F.lit("T"), "turn", F.lit(" (2)"))).otherwise(F.concat(F.lit("T"), "turn"))
    own = F.when(F.col("turn") % 2 == 1, items("x", "z")).when(F.col("part") == 1, items("x")).otherwise(items("y"))
    slide = F.row_number().over(Window.partitionBy("deck").orderBy("turn", "part")).cast("long")
    return first, parts.select("deck", slide.alias("slide"), title.alias("title"), own.alias("items"), none.alias("notes"))


@query(f"""WITH {_VERSIONS} SELECT CAST(a.conv_id AS VARCHAR) AS deck, a.slide AS first, b.slide AS second FROM a LEFT JOIN b ON b.conv_id = a.conv_id AND b.turn = a.turn AND (b.turn > 0 OR b.part = 1) UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, slide FROM b WHERE turn = -1 OR turn = 0 AND part = 2""")
def aligned_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.align_decks(*_versions(spark, sf_dir))


@query(f"""WITH {_VERSIONS} SELECT CAST(conv_id AS VARCHAR) AS deck, slide, CASE WHEN turn % 5 = 3 THEN 'only in the first' ELSE 'content' END AS what FROM a WHERE turn % 5 = 3 OR turn % 2 = 1 OR turn = 0 UNION ALL SELECT CAST(conv_id AS VARCHAR), slide, 'only in the second' FROM b WHERE turn = -1 OR turn = 0 AND part = 2""")
def compared_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_decks(*_versions(spark, sf_dir))


@query("""SELECT l_orderkey AS slide, CAST(count(*) AS INT) AS n, true AS whole FROM lineitem GROUP BY 1""")
def drafted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.operators import decks
    from folioquarry.plans.operator_queries import _boxes

    order = decks.drafted_order(_boxes(spark, sf_dir))
    return order.groupBy("slide").agg(F.count("*").cast("int").alias("n"), (F.count_distinct("rank") == F.count("*")).alias("whole"))


@query("""SELECT 'http://a.org/' || page_id AS url, md5(CASE WHEN page_id % 3 = 2 THEN '<!-- saved from url=(0020)http://a.org/' || page_id || ' -->' ELSE '' END || coalesce(html, '')) AS digest, CAST(0 AS BIGINT) AS n_more FROM pages""")
def loaded_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a file of its own: a crawl archive, a MIME page, or one that a browser saved."""
    from folioquarry.sources import archives

    k, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    url = F.concat(F.lit("http://a.org/"), k.cast("string"))
    message = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), body)
    crawl = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(message).cast("string"), F.lit("\r\n\r\n"), message, F.lit("\r\n\r\n"))
    mime = F.concat(F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="=B="\r\n\r\n--=B=\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\nContent-Location: '), url, F.lit("\r\n\r\n"), body, F.lit("\r\n--=B=--\r\n"))
    saved = F.concat(F.lit("<!-- saved from url=(0020)"), url, F.lit(" -->"), body)
    content = F.when(k % 3 == 0, crawl).when(k % 3 == 1, mime).otherwise(saved).cast("binary")
    found = archives.load_site(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), content.alias("content")))
    return found.select("url", F.md5("html").alias("digest"), "n_more")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts dealt out to all cores, as a small file of them makes many packages: Spark would read it in one task."""
    return table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([0, 1, 2]) AS pos, unnest([0, 0, 1]) AS depth, unnest(['Cover', p_type, p_name]) AS title, unnest([NULL, NULL, 'm' || p_partkey]) AS module FROM part""")
def collection_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    k = F.col("p_partkey").cast("string")
    book = F.concat(F.lit("<c:collection xmlns:c='u'><c:content><c:module><c:title>Cover</c:title></c:module><c:subcollection><c:title>"), "p_type", F.lit("</c:title><c:content><c:module document='m"), k, F.lit("'><c:title>"), "p_name", F.lit("</c:title></c:module></c:content></c:subcollection></c:content></c:collection>"))
    return archives.read_collections(_parts(spark, sf_dir).select(k.alias("path"), book.cast("binary").alias("content")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN lang END AS lang, md5(coalesce(text, '')) AS body FROM documents""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import markup

    text = F.coalesce("text", F.lit(""))
    value = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('---\ntitle: "Title '), F.col("doc_id").cast("string"), F.lit('"\nlang: '), "lang", F.lit("\n---\n"), text)).otherwise(text)
    rows = markup.front_matter(table(spark, sf_dir, "documents").select("doc_id", value.alias("value")))
    return rows.select("doc_id", F.try_element_at("meta", F.lit("title")).alias("title"), F.try_element_at("meta", F.lit("lang")).alias("lang"), F.md5("body").alias("body"))


@query("""SELECT p_partkey AS file, unnest(['a' || p_size || '.tex', 'b/' || p_partkey || '.tikz']) AS includes, unnest([0, 1]) AS seq FROM part""")
def latex_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import markup

    text = F.concat(F.lit("\\input{a"), "p_size", F.lit("} % \\input{no}\nx \\% \\include { b/"), "p_partkey", F.lit(".tikz }\n"))
    return markup.includes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), text.alias("value")))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents""")
def repaired_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import markup

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return markup.decoded(rows).select("doc_id", F.md5("text").alias("digest"))


#: What precedes a member of a zip archive, its entry in the directory, and the archive's end.
_LOCAL, _ENTRY, _END = (struct.Struct(f) for f in ("<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"))


def _stored(members: list[tuple[str, str]]) -> bytes:
    """A zip archive of members as they are, without zipfile's objects for each."""
    local, entries, at = [], [], 0
    for name, text in members:
        raw, data = name.encode(), text.encode()
        same = 20, 0 if raw.isascii() else 0x800, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(raw), 0  # the first of January 1980
        local += [_LOCAL.pack(b"PK\3\4", *same), raw, data]
        entries += [_ENTRY.pack(b"PK\1\2", 20, *same, 0, 0, 0, 0, at), raw]
        at += 30 + len(raw) + len(data)
    directory = b"".join(entries)
    return b"".join([*local, directory, _END.pack(b"PK\5\6", 0, 0, len(members), len(members), len(directory), at, 0)])


def _zipped(*texts):
    """A zip archive of the texts of some columns, their names being the first, third, ... of them."""
    given = [i for i, t in enumerate(texts) if not isinstance(t, str)]
    fixed = [t if isinstance(t, str) else None for t in texts]

    @F.pandas_udf("binary")
    def pack(*columns: pd.Series) -> pd.Series:
        def one(values) -> bytes:
            every = list(fixed)
            for i, v in zip(given, values, strict=True):
                every[i] = v
            return _stored(list(zip(every[::2], every[1::2], strict=True)))

        return pd.Series([one(values) for values in zip(*columns, strict=True)])

    return pack.asNondeterministic()(*[texts[i] for i in given])  # made once: a filter by kind would make all archives again, before the parts are dealt out


def _epubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    package = F.concat(
        F.lit("<package><metadata><title> "), "p_name", F.lit(" </title><language>en</language></metadata><manifest><item id='n' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/><item id='a' href='t/a"), k,
        F.lit(".xhtml' media-type='application/xhtml+xml'/><item id='i' href='lost.png' media-type='image/png'/></manifest><spine><itemref idref='a'/></spine></package>"),
    )
    nav = F.concat(F.lit("<html xmlns:e='u'><nav e:type='toc'><ol><li><a href='t/a"), k, F.lit(".xhtml#s'>"), "p_name", F.lit("</a><ol><li><span>"), "p_type", F.lit("</span></li></ol></li></ol></nav></html>"))
    page = F.concat(F.lit("<html><p>"), "p_brand", F.lit("</p></html>"))
    content = _zipped("META-INF/container.xml", "<c><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></c>", "O/p.opf", package, "O/nav.xhtml", nav, F.concat(F.lit("O/t/a"), k, F.lit(".xhtml")), page)
    return _parts(spark, sf_dir).select(k.alias("path"), content.alias("content"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([0, 1]) AS pos, unnest([0, 1]) AS depth, unnest([p_name, p_type]) AS title, unnest(['O/t/a' || p_partkey || '.xhtml', NULL]) AS member, unnest(['s', NULL]) AS fragment FROM part""")
def epub_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    return archives.read_epub_outline(_epubs(spark, sf_dir))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest(['a', 'i', 'n']) AS id, unnest([0, NULL, NULL]) AS spine, unnest([true, false, true]) AS held, unnest(['<html><p>' || p_brand || '</p></html>', NULL, 'nav']) AS html FROM part""")
def epub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    rows = archives.read_epub(_epubs(spark, sf_dir))
    return rows.select("path", "id", "spine", "held", F.when(F.col("id") == "n", "nav").otherwise(F.col("html")).alias("html"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([0, 1]) AS pos, unnest(['title', 'language']) AS name, unnest([p_name, 'en']) AS value FROM part""")
def epub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    return archives.read_epub_metadata(_epubs(spark, sf_dir))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([0, 1, 2]) AS pos, unnest([0, 1, 1]) AS depth, unnest([p_name, p_type, 'Quiz']) AS title, unnest(['heading', CASE WHEN p_partkey % 2 = 0 THEN 'page' ELSE 'file' END, 'activity']) AS kind FROM part""")
def cartridge_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    k = F.col("p_partkey")
    manifest = F.concat(
        F.lit("<manifest><organizations><organization><item><item><title>"), "p_name", F.lit("</title><item identifierref='r'><title>"), "p_type", F.lit("</title></item><item identifierref='q'><title>Quiz</title></item></item></item></organization></organizations><resources><resource identifier='r' type='webcontent' href='a."),
        F.when(k % 2 == 0, "html").otherwise("pdf"), F.lit("'/><resource identifier='q' type='imsqti_xmlv1p2/imscc_xmlv1p1/assessment'><file href='q.xml'/></resource></resources></manifest>"),
    )
    rows = _parts(spark, sf_dir).select(k.cast("string").alias("path"), _zipped("imsmanifest.xml", manifest).alias("content"))
    kept = archives.with_kind(rows).filter("kind = 'cartridge'")
    return archives.read_cartridge(kept.select("path", "content")).select("path", "pos", (F.col("depth") - 1).alias("depth"), "title", "kind")


@query("""SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.operators import decisions

    rows = table(spark, sf_dir, "documents")
    return decisions.report(rows.groupBy("lang", "source").agg(F.count("*").alias("n")).join(rows.select("lang").distinct(), "lang"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([1, 1, 2]) AS slide, unnest([2, 3, 9]) AS shape_id, unnest(['shape', 'picture', 'group']) AS kind, unnest([p_name, '', '']) AS text, unnest([NULL, p_type, NULL]) AS descr, unnest([true, false, false]) AS is_title, unnest([p_size, 7, 0]) AS x FROM part""")
def deck_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives

    shape = lambda name, number, more: F.concat(F.lit(f"<{name}><nv><cNvPr id='{number}' "), *more, F.lit(f"</{name}>"))
    title = shape("sp", 2, [F.lit("/><nvPr><ph type='title'/></nvPr></nv><off x='"), F.col("p_size").cast("string"), F.lit("' y='1'/><ext cx='3' cy='4'/><p><r><t>"), F.col("p_name"), F.lit("</t></r></p>")])
    picture = shape("pic", 3, [F.lit("descr='"), F.col("p_type"), F.lit("'/></nv><off x='7' y='2'/><ext cx='1' cy='1'/>")])
    first = F.concat(F.lit("<sld><spTree>"), title, picture, F.lit("</spTree></sld>"))
    second = F.lit("<sld><spTree><grpSp><nv><cNvPr id='9'/></nv></grpSp></spTree></sld>")
    content = _zipped("ppt/presentation.xml", "<p/>", "ppt/slides/slide1.xml", first, "ppt/slides/slide2.xml", second)
    rows = archives.with_kind(_parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))).filter("kind = 'deck'")
    return archives.read_decks(rows.select("path", "content")).select("path", "slide", "shape_id", "kind", "text", "descr", "is_title", F.col("x").cast("int").alias("x"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, unnest([1, 2]) AS tbl, unnest([CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END, 'below']) AS label, unnest([p_type || ',' || p_type || ',x,' || p_brand, 'only']) AS cells, unnest([p_partkey % 3 = 0, false]) AS marked FROM part""")
def word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioquarry.sources import archives, word

    k = F.col("p_partkey")
    para = lambda t: F.concat(F.lit("<w:p><w:r><w:t>"), t, F.lit("</w:t></w:r></w:p>"))
    cell = lambda t, more="": F.concat(F.lit(f"<w:tc><w:tcPr>{more}</w:tcPr>"), para(t), F.lit("</w:tc>"))
    head = F.when(k % 3 == 0, "<w:trPr><w:tblHeader/></w:trPr>").otherwise("")
    first = F.concat(F.lit("<w:tbl><w:tr>"), head, cell(F.col("p_type"), '<w:gridSpan w:val="2"/>'), F.lit("</w:tr><w:tr>"), cell(F.lit("x")), cell(F.col("p_brand")), F.lit("</w:tr></w:tbl>"))
    second = F.concat(F.lit("<w:tbl><w:tr>"), cell(F.lit("only")), F.lit("</w:tr></w:tbl>"))
    body = F.concat(F.lit('<w:document xmlns:w="w"><w:body>'), F.when(k % 2 == 0, para(F.col("p_name"))).otherwise(""), first, second, F.lit("<w:p/>"), para(F.lit("below")), F.lit("</w:body></w:document>"))
    rows = _parts(spark, sf_dir).select(k.cast("string").alias("path"), _zipped("word/document.xml", body).alias("content"))
    found = word.read_tables(archives.with_kind(rows).filter("kind = 'word'").select("path", "content"))
    return found.select("path", "tbl", "label", F.array_join(F.transform(F.flatten("grid"), lambda c: c["text"]), ",").alias("cells"), "marked")
