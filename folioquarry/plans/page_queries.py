"""Queries for page signatures and for documents kept as JSON trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.operators import source_rules
from folioquarry.plans.queries import query, table
from folioquarry.sources import ast, signature


@query(r"""WITH a AS (SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages), l AS (SELECT page_id, unnest(links) AS h FROM a),
b AS (SELECT page_id, count(*) FILTER (starts_with(h, '#')) AS fragment, count(*) FILTER (regexp_matches(lower(h), '^(https?://|//|data:|mailto:|tel:)')) AS external FROM l GROUP BY page_id),
f AS (SELECT page_id, html, CAST(len(links) AS VARCHAR) AS n, coalesce(fragment, 0) AS fragment, coalesce(external, 0) AS external FROM a LEFT JOIN b USING (page_id))
SELECT page_id, 'lang' AS field, regexp_extract(html, '<html lang="([^"]*)"', 1) AS value FROM f UNION ALL SELECT page_id, 'h1_count', CAST(len(regexp_extract_all(html, '<h1>')) AS VARCHAR) FROM f
UNION ALL SELECT page_id, 'img_count', CAST(len(regexp_extract_all(html, '<img')) AS VARCHAR) FROM f UNION ALL SELECT page_id, 'list_count', CAST(len(regexp_extract_all(html, '<ul|<ol')) AS VARCHAR) FROM f
UNION ALL SELECT page_id, 'link_external_count', CAST(external AS VARCHAR) FROM f UNION ALL SELECT page_id, 'link_fragment_count', CAST(fragment AS VARCHAR) FROM f
UNION ALL SELECT page_id, 'table_count', CAST(len(regexp_extract_all(html, '<table')) AS VARCHAR) FROM f""")
def page_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signature.signatures(table(spark, sf_dir, "pages"), "page_id")
    return found.filter(F.col("field").isin("lang", "h1_count", "img_count", "list_count", "link_external_count", "link_fragment_count", "table_count"))


@query(r"""SELECT page_id, 'lang' AS field, regexp_extract(html, '<html lang="([^"]*)"', 1) AS old, 'xx' AS new FROM pages WHERE page_id % 3 = 0""")
def signature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    later = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r'<html lang="[^"]*"', '<html lang="xx"')).otherwise(F.col("html")))
    return signature.compare_signatures(signature.signatures(pages, "page_id"), signature.signatures(later, "page_id"), "page_id")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a tree: for each turn a heading, and a paragraph with a link and a picture."""
    n = F.col("turn").cast("string")
    level = F.when(F.col("turn") % 2 == 0, "1").otherwise("3")
    alt = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit('{"t":"Str","c":"seen"},{"t":"Space"},{"t":"Str","c":"from'), n, F.lit('"}')))
    head = F.concat(F.lit('{"t":"Header","c":['), level, F.lit(',["h'), n, F.lit('",[],[]],[{"t":"Str","c":"x'), n, F.lit('"}]]},'))
    link = F.concat(F.lit('{"t":"Link","c":[["",[],[]],[{"t":"Str","c":"http://a.org/'), n, F.lit('"}],["http://a.org/'), n, F.lit('/",""]]},'))
    image = F.concat(F.lit('{"t":"Image","c":[["",[],[]],['), alt, F.lit('],["m/'), n, F.lit('.png",""]]}'))
    block = F.concat(head, F.lit('{"t":"Para","c":['), link, image, F.lit("]}"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), ",")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(blocks.alias("b"))
    return rows.select("conv_id", F.concat(F.lit('{"pandoc-api-version":[1,23],"meta":{},"blocks":['), "b", F.lit("]}")).alias("json"))


@query("""WITH t AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS i, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations), d AS (SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS tops FROM conversations GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS file, 'image ' || i AS "where", 'source-image-no-alt' AS "check", turn || '.png' AS detail FROM t WHERE turn % 3 = 0
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), 'source-link-bare-url', 'http://a.org/' || turn || '/' FROM t
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), 'source-heading-skips-level', 'h1 to h3: x' || turn FROM t WHERE turn % 2 = 1 AND last % 2 = 0
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), 'source-no-title', 'no title in its metadata, and not one heading of level 1' FROM d WHERE tops <> 1
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), 'source-no-language', 'neither the document nor its project says a language' FROM d""")
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rules.check_sources(ast.read_trees(_trees(spark, sf_dir), "conv_id", "json"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS name, string_agg('h' || turn, ',' ORDER BY turn) AS ids, string_agg('m/' || turn || '.png', ',' ORDER BY turn) AS media, string_agg('x' || turn || ' http://a.org/' || turn || CASE WHEN turn % 3 = 0 THEN '' ELSE 'seen from' || turn END, ' ' ORDER BY turn) AS text, count(*) FILTER (turn % 3 = 0) AS n_no_alt FROM conversations GROUP BY conv_id""")
def tree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ast.read_trees(_trees(spark, sf_dir), "conv_id", "json")
    return facts.select("name", F.array_join("ids", ",").alias("ids"), F.array_join("media", ",").alias("media"), "text", F.size(F.filter("images", lambda i: i["alt"] == "")).cast("long").alias("n_no_alt"))
