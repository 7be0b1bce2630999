"""Names for the pages and resources of a saved site, and archives taken apart."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.functions.text import media_type, percent_decoded, safe_stem
from folioquarry.operators.sequences import unique_names

#: Share of a site's pages that one directory must hold to be its root.
MOST = 0.8
SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}


def _path(url: Column) -> Column:
    return F.regexp_replace(F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def _common(paths: Column, other: Column) -> Column:
    """The whole leading segments that two paths share."""
    a, b = F.split(paths, "/"), F.split(other, "/")
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    n = F.coalesce(F.array_min(F.transform(same, lambda x, i: F.when(~x, i))), F.size(same))
    return F.array_join(F.slice(a, F.lit(1), n), "/")


def roots(pages: DataFrame, site: list[str]) -> DataFrame:
    """root of each site: the directory of four fifths of its pages, else what all directories share (from the least and greatest path alone)."""
    folders = pages.select(*site, F.regexp_replace(_path(F.col("url")), "/[^/]*$", "").alias("folder"))
    per = folders.groupBy(*site, "folder").agg(F.count("*").alias("n"))
    ends = per.groupBy(*site).agg(F.sum("n").alias("all"), F.max(F.struct("n", "folder")).alias("top"), F.min("folder").alias("low"), F.max("folder").alias("high"))
    return ends.select(*site, F.when(F.col("top.n") >= MOST * F.col("all"), F.col("top.folder")).otherwise(_common(F.col("low"), F.col("high"))).alias("root"))


def page_names(pages: DataFrame, site: list[str], leaf: bool = False) -> DataFrame:
    """name of each page (url): its path below the site's root, flat and safe, with the query where pages differ by it; -2, -3, ... for further owners.

    With ``leaf`` the last part of the path alone.  Later names depend on earlier ones, so a site's names are given in one call.
    """
    url = F.col("url")
    query = F.when(F.instr(url, "?") > 0, F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), r"^[^?]*\?", "")).otherwise("")
    if leaf:
        last = percent_decoded(F.regexp_extract(F.regexp_replace(_path(url), "/+$", ""), "([^/]*)$", 1))
        named = pages.withColumn("wanted", safe_stem(F.regexp_replace(last, "_*:_*", "-")))
    else:
        paths = pages.select(*site, _path(url).alias("p")).groupBy(*site).agg((F.count_distinct("p") == 1).alias("one_path"))
        at = pages.join(roots(pages, site), site).join(paths, site)
        below = F.when(_path(url).startswith(F.concat("root", F.lit("/"))), F.substr(_path(url), F.length("root") + 2)).otherwise(F.regexp_replace(_path(url), "^/+", ""))
        stem = F.replace(F.regexp_replace(below, r"\.x?html?$", ""), F.lit("/"), F.lit("-"))
        full = F.when(query == "", stem).when(F.col("one_path"), query).otherwise(F.concat(stem, F.lit("-"), query))
        named = at.select(*pages.columns, safe_stem(full).alias("wanted"))
    return unique_names(named, site, ["url"], "wanted").drop("wanted")


def resource_names(resources: DataFrame, site: list[str]) -> DataFrame:
    """file of each resource (key, name, asked, head): its own name with the suffix that its bytes have; the key's first digits where another has that name.

    The first by key keeps the name.  A name without a suffix gives way to one that the resource was asked for by.
    """
    from pyspark.sql import Window

    suffix = lambda c: F.regexp_extract(c, r"(?<=[^/.])(\.[^./]*)$", 1)
    own = F.when((suffix("name") == "") & (suffix(F.coalesce("asked", F.lit(""))) != ""), F.col("asked")).otherwise(F.col("name"))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    right = F.coalesce(F.try_element_at(kinds, media_type("head")), F.lit(""))
    low = F.lower(suffix("own"))
    fixed = F.when((right != "") & ((low == "") | (low.isin(*SUFFIXES.values()) & (low != right) & ~((right == ".jpg") & (low == ".jpeg")))), right).otherwise(low)
    at = resources.withColumn("own", own)
    stem = safe_stem(F.substr("own", F.lit(1), F.length("own") - F.length(suffix("own"))))
    at = at.withColumn("stem", stem).withColumn("end", fixed).withColumn("file", F.concat("stem", "end"))
    first = F.row_number().over(Window.partitionBy(*site, "file").orderBy("key")) == 1
    return at.withColumn("file", F.when(first, F.col("file")).otherwise(F.concat("stem", F.lit("-"), F.substring(F.regexp_replace("key", "^sha1:", ""), 1, 8), "end"))).select(*resources.columns, "file")


#: What systems leave in archives.
LEFTOVERS = ("__MACOSX/", ".DS_Store", "Thumbs.db", "desktop.ini")


def unpacked(rows: DataFrame) -> DataFrame:
    """path, name and content of each file in plain zip archives: folders that wrap everything are taken off, leftovers and unsafe names left out."""
    from posixpath import normpath

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    kept = [n for n in z.namelist() if not n.endswith("/") and not any(x in n for x in LEFTOVERS) and not normpath(n).startswith(("..", "/"))]
                    cut = 0
                    while kept and len({n.split("/")[cut] for n in kept}) == 1 and all(n.count("/") > cut for n in kept):
                        cut += 1
                    for n in kept:
                        yield pd.DataFrame([(path, "/".join(n.split("/")[cut:]), z.read(n))], columns=["path", "name", "content"])

    return rows.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def contents_lines(tree: DataFrame, book: list[str]) -> DataFrame:
    """line of a contents file for each entry (pos, depth, title, page) in order: a group, or a page with its title."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    pad = F.repeat(F.lit("    "), F.col("depth"))
    line = F.when(F.col("page").isNull(), F.concat(pad, F.lit("- title: "), quoted, F.lit("\n"), pad, F.lit("  items:"))).otherwise(F.concat(pad, F.lit("- page: "), "page", F.lit("\n"), pad, F.lit("  title: "), quoted))
    return tree.select(*book, "pos", line.alias("line"))


def manifest_lines(tree: DataFrame, book: list[str]) -> DataFrame:
    """line of a package's organization for each entry (pos, depth, title, page): its item, closed as far as the next entry's depth asks for."""
    from pyspark.sql import Window

    escaped = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    nxt = F.coalesce(F.lead("depth").over(Window.partitionBy(*book).orderBy("pos")), F.lit(0))
    start = F.concat(F.lit('<item identifier="I'), F.col("pos").cast("string"), F.lit('"'), F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit(' identifierref="'), "page", F.lit('"'))), F.lit("><title>"), escaped, F.lit("</title>"))
    return tree.select(*book, "pos", F.concat(start, F.repeat(F.lit("</item>"), F.greatest(F.col("depth") - nxt + 1, F.lit(0)))).alias("line"))
