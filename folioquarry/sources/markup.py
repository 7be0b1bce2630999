"""Plain-text sources: front matter, LaTeX includes, lines in a mixed code page, recorded page lists, checkers' reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def front_matter(rows: DataFrame, text: str = "value") -> DataFrame:
    """meta (a map of the top-level plain settings) and body of pages that begin with a block between --- lines."""
    head = F.regexp_extract(text, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"'](.*)[\"']$", "$1")
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, r"^([\w-]+)", 1))), lambda k: F.struct(k.alias("key"), bare(F.element_at(F.filter(lines, lambda x: F.regexp_extract(x, r"^([\w-]+)", 1) == k), -1)).alias("value"))))
    return rows.withColumn("meta", meta).withColumn("body", F.regexp_replace(text, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", ""))


def is_master(text: str = "value") -> Column:
    """Whether LaTeX text is a whole document: its class and its beginning stand outside comments."""
    bare = F.regexp_replace(F.col(text), r"(?m)(?<!\\)%.*$", "")
    return bare.rlike(r"\\documentclass\b") & bare.rlike(r"\\begin\s*\{document\}")


def includes(rows: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """file, includes and place of every include command outside comments; names without an extension get .tex."""
    bare = F.regexp_replace(F.col(text), r"(?m)(?<!\\)%.*$", "")
    found = rows.select(F.col(file).alias("file"), F.posexplode(F.regexp_extract_all(bare, F.lit(r"\\(?:include|input|subfile)\s*\{\s*([^}]+?)\s*\}"), F.lit(1))).alias("seq", "name"))
    return found.select("file", F.when(F.col("name").rlike(r"\.\w+$"), F.col("name")).otherwise(F.concat("name", F.lit(".tex"))).alias("includes"), "seq")


#: Characters that text rarely holds inside a word: a wrong code page shows as these.
_ODD = set("ÃÂ¢€™œž¤¦§¨ª¬¯°±²³´¶·¸¹º¼½¾√∂ƒ≈∆«»…ŒœŠšŸ†‡‰‹›")


def misplaced(text: str) -> int:
    """How many characters stand where text has none: marks of a wrong code page, and capitals right after small letters."""
    return sum(c in _ODD or c == "\ufffd" or (c > "\x7f" and c.isupper() and before.islower()) for before, c in zip(" " + text, text, strict=False))


def repaired(content: bytes) -> str:
    """Text of a file whose lines may be in UTF-8, Windows or Macintosh code: each line by what reads least odd."""
    out = []
    for line in content.removeprefix(b"\xef\xbb\xbf").split(b"\n"):
        try:
            out.append(line.decode("utf-8"))
        except UnicodeDecodeError:
            ways = [line.decode(c, "replace") for c in ("cp1252", "mac_roman")]
            out.append(min(ways, key=misplaced))
    return "\n".join(out)


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """text: the repaired text of a binary column."""

    @F.pandas_udf(T.StringType())
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else repaired(bytes(v)))

    return rows.withColumn("text", read(content))


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """url and title of a crawl's page list (JSON lines) in its recorded order; its first line is a header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return lines.select("seq", F.get_json_object("line", "$.url").alias("url"), F.get_json_object("line", "$.title").alias("title")).filter("url is not null")


def rule_report(rows: DataFrame, json: str = "value", prefix: str = "axe:") -> DataFrame:
    """(where, check, detail) of a browser checker's JSON: one row for each page and rule, with how many elements fail."""
    schema = "url string, violations array<struct<id:string,help:string,nodes:array<struct<html:string>>>>"
    one = rows.select(F.from_json(json, schema).alias("r")).select(F.col("r.url").alias("where"), F.inline("r.violations"))
    return one.groupBy("where", "id").agg(F.min("help").alias("help"), F.sum(F.size("nodes")).alias("n")).select("where", F.concat(F.lit(prefix), "id").alias("check"), F.format_string("%s (%d)", "help", "n").alias("detail"))
