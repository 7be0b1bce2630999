"""Grids of many shapes, one an order: kind, guess and structure of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.operators import tables
from folioquarry.plans.queries import query, table


def _cell(text, i: int, bold: bool = False, image: bool = False):
    return F.struct(F.lit(i).alias("cell_id"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("shaded"), F.lit(image).alias("image"))


def shaped_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n (lines) and grid: by k modulo 11 a table with a marked head, a head in words, a blank corner, labels and values,
    a title over a head, a marked first column, numbers alone, a band within, pictures, one cell, or a list in columns."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("bigint"))).alias("q"), F.count("*").alias("n"))
    amount = lambda x: x.cast("string")
    labelled = lambda bold: F.transform("q", lambda x, i: F.array(_cell(F.concat(F.lit("label "), F.char(i + 97)), 1, bold), _cell(amount(x), 2)))
    numbered = F.transform("q", lambda x, i: F.array(_cell(amount(i + 1), 1), _cell(amount(x), 2)))
    head = lambda a, bold: F.array(F.array(_cell(a, 1, bold), _cell("Amount", 2, bold)))
    band = lambda text: F.array(F.array(_cell(text, 1), _cell(text, 1)))
    letters = F.transform("q", lambda x, i: F.array(_cell(F.char(i + 97), 1), _cell(F.concat(F.char(i + 97), F.lit("z")), 2)))
    listed = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(_cell(F.char(i + 97), 1), _cell(F.char(i + 107), 2)))
    k = F.col("k") % 11
    grid = (
        F.when(k == 0, F.concat(head("Name", True), labelled(False))).when(k == 1, F.concat(head("Name", False), labelled(False))).when(k == 2, F.concat(head("", False), labelled(False))).when(k == 3, labelled(False))
        .when(k == 4, F.concat(band("Title"), head("Name", True), labelled(False))).when(k == 5, labelled(True)).when(k == 6, numbered).when(k == 7, F.concat(F.slice(numbered, 1, 1), band("Part"), tables.after_first(numbered)))
        .when(k == 8, F.transform("q", lambda x, i: F.array(_cell("", 1, False, True), _cell("", 2)))).when(k == 9, F.array(F.array(_cell("alone", 1)))).otherwise(listed)
    )
    return lines.select("k", "n", grid.alias("grid"))


@query("""WITH g AS (SELECT l_orderkey AS k, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1)
SELECT k, CASE k % 11 WHEN 0 THEN 'first-row' WHEN 4 THEN 'title-row-then-headers' WHEN 5 THEN CASE WHEN n > 1 THEN 'first-column' ELSE 'no-header-signal' END WHEN 8 THEN 'layout(image-only)' WHEN 9 THEN 'layout(single-cell)' ELSE 'no-header-signal' END AS kind,
CASE k % 11 WHEN 0 THEN n + 1 WHEN 1 THEN n + 1 WHEN 2 THEN n + 1 WHEN 4 THEN n + 2 WHEN 7 THEN n + 1 WHEN 9 THEN 1 WHEN 10 THEN 4 ELSE n END AS n_rows, CASE WHEN k % 11 = 9 THEN 1 ELSE 2 END AS n_columns,
CASE k % 11 WHEN 2 THEN 'both' WHEN 3 THEN 'first-column' WHEN 5 THEN 'first-column' WHEN 6 THEN 'none' WHEN 7 THEN 'unknown' WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN 'none' ELSE CASE WHEN n < 2 THEN 'first-row' ELSE 'both' END END AS guess,
CASE WHEN k % 11 = 4 THEN '1' ELSE '' END AS caption_rows, CASE WHEN k % 11 = 7 AND n > 1 THEN '2' ELSE '' END AS split_at FROM g""")
def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.structure(tables.explain(tables.classify(shaped_grids(spark, sf_dir)))).drop("grid", "n")


@query("""WITH g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, k % 11 IN (0, 1, 2) AS words_over_numbers, k % 11 = 2 AS corner, k % 11 IN (0, 1, 3, 5) AS labels, k % 11 = 6 AS plain, k % 11 = 10 AS snaked, k % 11 = 4 AS title, k % 11 = 0 AS header FROM g""")
def grid_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("grid")
    found = {"words_over_numbers": tables.text_over_numbers(g), "corner": tables.blank_corner_matrix(g), "labels": tables.label_value(g), "plain": tables.plain_grid(g), "snaked": tables.snaked_list(g), "title": tables.is_full_width_band(tables.row(g, 0)), "header": tables.looks_like_header_band(tables.row(g, 0))}
    return shaped_grids(spark, sf_dir).select("k", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in found.items()])


@query("""SELECT DISTINCT l_orderkey AS k, CASE WHEN l_orderkey % 11 IN (0, 1) THEN NULL WHEN l_orderkey % 11 IN (8, 9) THEN 'shape' WHEN l_orderkey % 5 = 0 THEN 'page' WHEN l_orderkey % 3 = 0 AND l_orderkey % 2 = 1 THEN 'place' END AS reason FROM lineitem""")
def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    reason = tables.layout_reason(F.col("grid"), (k % 11).isin(0, 1), k % 5 == 0, k % 2 == 0, k % 3 == 0)
    return shaped_grids(spark, sf_dir).select("k", reason.alias("reason"))
