"""The library's own queries over the supplied tables: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as t
from folioquarry.operators import alttext, compare, contents, decisions, decks, findings, links, page_rules, sequences, tables
from folioquarry.sources.pages import html_language, read_pages
from folioquarry.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _titles(pages: DataFrame) -> DataFrame:
    return pages.withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))


@query("""WITH l AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT 'link-to-missing-file' AS "Check", 'error' AS "Severity", count(*) AS n FROM l WHERE href LIKE '/%' AND href NOT LIKE '//%' HAVING count(*) > 0
UNION ALL SELECT 'no-title', 'error', count(*) FROM pages WHERE trim(regexp_extract(html, '<title>([^<]*)', 1)) = '' HAVING count(*) > 0 UNION ALL SELECT 'no-lang', 'error', count(*) FROM pages WHERE NOT regexp_matches(html, '<(html|body)[^>]* lang="[^"]+"') HAVING count(*) > 0""")
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read_pages(table(spark, sf_dir, "pages")).persist()  # parsed once for the rules and the link joins
    found = findings.finalize(page_rules.check_pages(facts).unionByName(links.check_links(facts)))
    return found.groupBy("Check", "Severity").agg(F.count("*").alias("n"))


@query("""SELECT url AS name, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS n_links,
CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(html, '<script>')) AS BIGINT) AS n_scripts FROM pages""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read_pages(table(spark, sf_dir, "pages"))
    return facts.select("name", "lang", F.size("links").cast("long").alias("n_links"), F.size("headings").cast("long").alias("n_headings"), F.col("scripts").cast("long").alias("n_scripts"))


@query("""SELECT url AS "where", 'link-to-missing-file' AS "check", count(*) AS n FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
WHERE href LIKE '/%' AND href NOT LIKE '//%' GROUP BY url""")
def nav_links_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.check_links(read_pages(table(spark, sf_dir, "pages")))
    return found.groupBy("where", "check").agg(F.count("*").alias("n"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<body[^>]* lang="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '')) AS lang FROM pages""")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_language().alias("lang"))


@query("""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS bare FROM pages), q AS (SELECT page_id, split_part(bare, '?', 1) AS base, CASE WHEN contains(bare, '?') THEN substr(bare, instr(bare, '?')) ELSE '' END AS query FROM p)
SELECT page_id, CASE WHEN base LIKE '%/' THEN base || 'index.html' ELSE base END || CASE WHEN length(query) > 1 THEN query ELSE '' END AS canonical FROM q""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.canonical("url").alias("canonical"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(url, '/', '-'), '[^A-Za-z0-9._/-]+', '-', 'g'), '-+\\.', '.', 'g'), '-'), ''), '-') AS stem FROM pages""")
def safe_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.safe_stem("url").alias("stem"))


@query("""SELECT ' - ' AS separator, 'Parts' AS tail, count(*) FILTER (p_partkey % 10 <> 0) AS n, count(*) AS total FROM part HAVING count(*) FILTER (p_partkey % 10 <> 0) >= 0.8 * count(*)""")
def split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 10 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" | "), "p_brand", F.lit(" - Parts")))
    return links.split_titles(table(spark, sf_dir, "part").select(title.alias("title")), "title")


PROFILES = [("wiki", ['class="mw-', "<table"]), ("article", ["<article>", "<nav>"]), ("any", ["<html"])]


@query("""SELECT CASE WHEN 2 * count(*) FILTER (html LIKE '%class="mw-%' AND html LIKE '%<table%') > count(*) THEN 'wiki' WHEN 2 * count(*) FILTER (html LIKE '%<article>%' AND html LIKE '%<nav>%') > count(*) THEN 'article'
WHEN 2 * count(*) FILTER (html LIKE '%<html%') > count(*) THEN 'any' END AS profile, count(*) AS n_pages FROM pages""")
def detect_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.detect_profile(table(spark, sf_dir, "pages"), PROFILES)


@query("""WITH l AS (SELECT page_id, length(html) AS size, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS seq FROM pages),
r AS (SELECT *, CASE WHEN seq = 1 OR target <> lag(target) OVER (PARTITION BY page_id ORDER BY seq) THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT page_id AS container, count(DISTINCT target) AS reach, CAST(sum(new) AS BIGINT) AS runs, max(size) AS size, min(seq) AS first FROM r GROUP BY page_id),
k AS (SELECT container, row_number() OVER (ORDER BY reach DESC, size, first, container) AS rank FROM g WHERE reach >= 3 AND runs <= 1.25 * reach + 1)
SELECT g.container, reach, runs, size, CAST(rank AS BIGINT) AS rank FROM g LEFT JOIN k USING (container)""")
def menu_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("container"), F.length("html").cast("long").alias("size"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("seq", "target"))
    return links.menu_rank(rows).select("container", "reach", "runs", "size", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[''’‘`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.slugify("p_name").alias("slug"))


@query("""SELECT c_custkey, CAST(row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+$', ''), CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_custkey) AS BIGINT) AS place FROM customer ORDER BY place LIMIT 100""")
def natural_sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "customer").orderBy(t.natural_key("c_name"), "c_custkey").limit(100)
    return rows.select("c_custkey", F.row_number().over(Window.orderBy(t.natural_key("c_name"), "c_custkey")).cast("long").alias("place"))


@query("""SELECT doc_id, md5(lower(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '[\\s.!?;:,]+$', ''))) AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.clean("text")).alias("cleaned"))


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM conversations) SELECT conv_id, turn, CASE WHEN length(x) > 120 THEN 'too-long' END AS kind, CASE WHEN length(x) > 120 THEN length(x) || ' characters (limit 120)' END AS rule FROM c""")
def text_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", alttext.problem(F.col("text")).alias("p")).select("conv_id", "turn", F.col("p.kind").alias("kind"), F.col("p.rule").alias("rule"))


@query("""WITH c AS (SELECT doc_id, lower(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '[\\s.!?;:,]+$', '')) AS x FROM documents),
g AS (SELECT x, count(DISTINCT doc_id) - 1 AS others FROM c WHERE x <> '' GROUP BY x HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, others FROM c JOIN g USING (x)""")
def shared_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alttext.shared(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "others")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'mul' END AS said, CASE WHEN lang IS NOT NULL AND lang <> 'en' THEN lang ELSE 'en-US' END AS language FROM documents LEFT JOIN labels USING (doc_id)""")
def language_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    said = F.when(F.col("quality") == 0, "mul")  # a code of no language, so the row does not act
    return rows.select("doc_id", said.alias("said"), decisions.decide_language(said, F.col("lang"), F.lit("en_US")).alias("language"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM g) SELECT source, lang, n FROM r WHERE k = 1""")
def majority_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.majority(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""SELECT d.doc_id, CASE WHEN said IS NULL THEN lang WHEN said = 'manual' THEN '' ELSE said END AS value, CASE WHEN said IS NOT NULL THEN 'sidecar' ELSE 'guess' END AS supplier,
CASE WHEN l.doc_id IS NULL THEN 'new' WHEN said IS NULL THEN 'blank' WHEN said = 'manual' THEN 'manual' ELSE 'declared' END AS status
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'manual' WHEN quality = 0 THEN 'junk' END AS said FROM labels) l USING (doc_id)""")
def sidecar_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "manual").when(F.col("quality") == 0, "junk").alias("said"))
    return decisions.in_effect(table(spark, sf_dir, "documents").select("doc_id", "lang"), said, ["doc_id"], "said", "lang").drop("lang")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sidecar_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.new_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id + 1 AS doc_id, quality FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def sidecar_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("doc_id"), "quality")
    return decisions.stale_rows(table(spark, sf_dir, "documents"), rows, ["doc_id"])


@query("SELECT quality, count(*) FILTER (toxic = 0) AS n FROM labels GROUP BY quality")
def unreviewed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("drafted", F.lit("tool")).withColumn("reviewed", F.when(F.col("toxic") == 1, "yes"))
    return decisions.unreviewed(rows, "drafted", "reviewed", ["quality"])


@query("""SELECT l_orderkey, l_partkey, level, last FROM (SELECT *, lag(level) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS last FROM (SELECT *, CAST(l_linenumber AS INT) AS level FROM lineitem)) WHERE last IS NOT NULL AND level > last + 1""")
def heading_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("level", F.col("l_linenumber").cast("int"))
    return sequences.level_skips(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "level").select("l_orderkey", "l_partkey", "level", "last")


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS occurrence FROM lineitem) WHERE occurrence > 1""")
def duplicate_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.repeats(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) {_W} AS BIGINT) AS piece, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) {_W} AS role_in_effect FROM events")
def piece_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("said", F.when(F.col("value") > 50, F.col("event_type")))
    return sequences.pieces(rows, ["user_id"], ["ts", "event_id"], "event_type = 'purchase'", "said").select("event_id", "piece", "role_in_effect")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def note_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    return sequences.running_offset(rows, ["conv_id"], ["turn"], "n").select("conv_id", "turn", "offset")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS ordinal FROM conversations""")
def data_table_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.ordinals(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role = 'user'").select("conv_id", "turn", "ordinal")


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a grid of four columns, its lines in a full order."""
    cell = lambda i, c: F.struct(F.lit(i).alias("cell_id"), F.col(c).cast("bigint").cast("string").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("shaded"), F.lit(False).alias("image"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(cell(1, "l_linenumber"), cell(2, "l_partkey"), cell(3, "l_suppkey"), cell(4, "l_quantity")).alias("r")).alias("x"))
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("grid"))


@query("""SELECT l_orderkey, sha256(string_agg(l_linenumber || chr(31) || l_partkey || chr(31) || l_suppkey || chr(31) || CAST(trunc(l_quantity) AS BIGINT), chr(30) ORDER BY l_linenumber, l_partkey, l_suppkey, trunc(l_quantity)) || chr(29) || count(*) || 'x4') AS key FROM lineitem GROUP BY l_orderkey""")
def table_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("l_orderkey", tables.table_key(F.col("grid")).alias("key"))


@query("""SELECT l_orderkey, 'no-header-signal' AS kind, CAST(count(*) AS INT) AS n_rows, 4 AS n_columns, 'none' AS guess, '' AS caption_rows, '' AS split_at FROM lineitem GROUP BY l_orderkey""")
def table_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.structure(tables.explain(tables.classify(_grids(spark, sf_dir)))).drop("grid")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, true AS mostly_numeric, d = n AND n >= 3 AS keys_rows FROM g""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tables.column(F.col("grid"), 0)
    return _grids(spark, sf_dir).select("l_orderkey", tables.mostly_numeric(first).alias("mostly_numeric"), tables.keys_rows(first).alias("keys_rows"))


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'kind' WHEN grouping(source) = 0 THEN 'guess' ELSE 'book' END AS "by", coalesce(lang, source, book) AS value, count(*) AS n
FROM (SELECT lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS book FROM documents) GROUP BY GROUPING SETS ((lang), (source), (book))""")
def census_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("source").alias("guess"), F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("book"))
    return tables.census(rows)


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 100000 ELSE 2 END AS p FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT coalesce(b.k, a.k) AS k, b.k AS bk, a.k AS ak, b.s AS bs, a.s AS sa, b.p AS bp, a.p AS ap FROM b FULL JOIN a ON b.k = a.k)
SELECT k, 'both' AS status, 's' AS field, bs AS old, sa AS new FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND bs <> sa
UNION ALL SELECT k, 'both', 'p', CAST(bp AS VARCHAR), CAST(ap AS VARCHAR) FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND abs(ap - bp) > 5 AND abs(ap - bp) * 100.0 > 2.0 * greatest(abs(ap), abs(bp))
UNION ALL SELECT k, CASE WHEN ak IS NULL THEN 'only-before' ELSE 'only-after' END, NULL, NULL, NULL FROM j WHERE bk IS NULL OR ak IS NULL""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("bigint")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), price.alias("p"))
    before = rows.filter("k % 7 <> 0")
    after = rows.filter("k % 11 <> 0").select("k", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")).alias("s"), (F.col("p") + F.when(F.col("k") % 3 == 0, 100000).otherwise(2)).alias("p"))
    return compare.compare_runs(before, after, "k", ["s", "p"], tolerant=("p",))


@query("SELECT doc_id, abs(n_chars - strlen(text)) <= 5 OR abs(n_chars - strlen(text)) * 100.0 <= 2.0 * greatest(n_chars, strlen(text)) AS agrees FROM documents")
def word_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.within_tolerance(F.col("n_chars"), F.octet_length("text").cast("long")).alias("agrees"))


@query("""WITH l AS (SELECT trim(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS h FROM pages UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+:/', '') FROM pages),
x AS (SELECT h, split_part(split_part(h, '#', 1), '?', 1) AS p FROM l), y AS (SELECT *, lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '[^.](\\.[^.]*)$', 1)) AS e FROM x)
SELECT CASE WHEN h LIKE '#%' THEN 'fragment' WHEN regexp_matches(lower(h), '^(https?://|//|data:|mailto:|tel:)') THEN 'external' WHEN p = '' THEN 'fragment' WHEN e IN ('', '.html', '.htm', '.xhtml') THEN 'page' ELSE 'asset' END AS bucket, count(*) AS n
FROM y WHERE h <> '' GROUP BY 1""")
def link_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hrefs = [pages.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("h")), pages.select(F.col("url").alias("h")), pages.select(F.regexp_replace("url", "^[a-z]+:/", "").alias("h"))]
    return reduce(DataFrame.unionByName, hrefs).select(t.classify_link("h").alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT 'n' || c_custkey AS url, CASE WHEN c_custkey % 60 = 0 THEN 'r' || c_nationkey ELSE 'n' || (c_custkey - 1) END AS target FROM customer),
w AS (SELECT url, target AS e FROM r UNION ALL SELECT w.url, r.target FROM w JOIN r ON w.e = r.url)
SELECT url, e AS "end" FROM w WHERE e NOT IN (SELECT url FROM r)""")
def redirect_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), n).alias("url"), F.when(n % 60 == 0, F.concat(F.lit("r"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("n"), n - 1)).alias("target"))
    return links.follow(rows)


@query("""WITH t AS (SELECT user_id AS key, arg_max(CASE WHEN event_id % 2 = 0 THEN coalesce(event_type, '') ELSE '-' END, event_id) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN v IS NULL OR v = '-' THEN c_mktsegment ELSE v END AS value FROM customer LEFT JOIN t ON key = c_custkey UNION ALL SELECT key, CASE WHEN v <> '-' THEN v END FROM t WHERE key NOT IN (SELECT c_custkey FROM customer)""")
def config_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    layers = table(spark, sf_dir, "events").select(k.alias("layer"), F.col("user_id").alias("key"), (k % 3 != 0).alias("present"), F.when(k % 2 == 0, F.col("event_type")).alias("value"))
    return decisions.cascade(layers, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def project_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.conflicts(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0")
def incremental_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.with_digest(table(spark, sf_dir, "documents"), "text").select(F.col("doc_id").cast("string").alias("path"), "sha", "doc_id")
    cache = rows.filter("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha")).alias("sha"), F.lit("").alias("options"))
    return incremental.work(rows.drop("doc_id"), cache)


@query("""WITH e AS (SELECT source, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS bucket, doc_id || ' ' || sha256(coalesce(text, '')) AS line FROM documents), b AS (SELECT source, bucket || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line FROM e GROUP BY source, bucket)
SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM b GROUP BY source""")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.with_digest(table(spark, sf_dir, "documents"), "text", "digest").select("source", F.col("doc_id").cast("string").alias("path"), "digest")
    return incremental.tree_digest(rows, ["source"])


@query("""WITH b AS (SELECT o_custkey AS slide, o_orderkey AS id, o_orderkey % 97 AS x, o_orderkey % 89 AS y, 5 + o_orderkey % 7 AS w, 4 + o_orderkey % 5 AS h FROM orders)
SELECT a.slide, a.id AS first, b.id AS second FROM b a JOIN b ON a.slide = b.slide AND a.id < b.id WHERE a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.lit("d").alias("deck"), F.col("o_custkey").alias("slide"), k.alias("seq"), k.alias("shape_id"), (k % 97).alias("x"), (k % 89).alias("y"), (5 + k % 7).alias("w"), (4 + k % 5).alias("h"))
    return decks.overlapping(rows).drop("deck")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '''=' || p_name ELSE p_name END AS cell, CASE WHEN p_partkey % 4 = 0 THEN '=' || p_name ELSE p_name END AS back FROM part""")
def csv_guard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", t.guarded(value).alias("cell"), t.unguarded(t.guarded(value)).alias("back"))


@query("SELECT p_brand AS src, max(p_size) AS shown, max(CAST(floor(p_retailprice) AS INT)) AS pixels, max(CAST(floor(p_retailprice) AS INT)) > max(p_size) * 2.0 AS too_wide FROM part GROUP BY p_brand")
def downsample_widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks.widest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_size").alias("shown"), F.floor("p_retailprice").cast("int").alias("pixels")))



@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS ordinal, 'Figure ' || p_brand || '.' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS label FROM part""")
def figure_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.number_within(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "Figure").select("p_partkey", "ordinal", "label")


@query("""SELECT upper(substr(p_name, 1, 1)) AS letter, p_name AS term, string_agg(p_brand, ', ' ORDER BY p_brand) AS pages FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY p_name""")
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.book_index(table(spark, sf_dir, "part"), "p_name", "p_brand", "p_brand")


@query("""SELECT * FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS example, count(*) OVER (PARTITION BY source) AS n_rows FROM documents) WHERE example <= 3""")
def field_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.examples(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 3).select("source", "doc_id", "example", "n_rows")


@query("SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source")
def shape_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.one_of_each(table(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"]).select("doc_id", "lang", "source")


@query()
def level_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.close_level_gaps(table(spark, sf_dir, "conversations").withColumn("level", (F.length("text") % 6 + 1).cast("int")), ["conv_id"], "turn", "level")


@query()
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sequences.unique_names(rows, ["conv_id"], ["turn"], "role")


@query("""WITH b AS (SELECT doc_id AS key, lang AS e, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS e, CASE WHEN doc_id % 3 = 0 THEN md5(text || 'x') ELSE md5(text) END AS d FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(b.key, a.key) AS key, CASE WHEN a.key IS NULL THEN 'only-before' WHEN b.key IS NULL THEN 'only-after' WHEN b.e <> a.e THEN 'renamed' ELSE 'changed' END AS state FROM b FULL JOIN a ON b.key = a.key WHERE a.key IS NULL OR b.key IS NULL OR b.e <> a.e OR b.d <> a.d""")
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("ext"), F.md5("text").alias("digest"), "text")
    after = rows.filter("key % 4 <> 0").select("key", F.when(F.col("key") % 7 == 0, "xx").otherwise(F.col("ext")).alias("ext"), F.when(F.col("key") % 3 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.col("digest")).alias("digest"))
    return compare.compare_files(rows.filter("key % 5 <> 0"), after).select("key", "state")


@query("""(SELECT lang, source, 'before' AS side FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1)) UNION ALL
(SELECT lang, source, 'after' AS side FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0))""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return compare.compare_rows(rows.filter("doc_id % 2 = 0").select("lang", "source"), rows.filter("doc_id % 2 = 1").select("lang", "source"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 2 + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey * 2 + 2 FROM part), w AS (SELECT CAST(0 AS BIGINT) AS file, 0 AS depth UNION ALL SELECT b, depth + 1 FROM w JOIN e ON w.file = e.a)
SELECT file, min(depth) AS depth FROM w GROUP BY file""")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part")
    edges = reduce(DataFrame.unionByName, [n.select(F.col("p_partkey").alias("file"), (F.col("p_partkey") * 2 + i).alias("includes")) for i in (1, 2)])
    return contents.reached(edges, n.agg(F.min("p_partkey").alias("file")))


@query("""SELECT p_partkey, CAST(position AS INT) AS position FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN p_partkey % 2 = 1 THEN p_partkey END, p_partkey) AS position FROM part)""")
def book_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    stem = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-introduction-to-"), n)).otherwise(F.concat(F.lit("-"), n, F.lit("-section"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", stem.alias("stem"))
    return contents.book_order(rows, ["p_brand"]).select("p_partkey", "position")
