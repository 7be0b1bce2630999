"""Decision tables: tolerant CSV in and out, blank kept apart from absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions.text import guarded, unguarded


def read_sidecar(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns as text by header name (null where the file lacks one, blank where a cell is), with row_no.

    Repeated header rows are dropped; the formula guard and marks at the start of the file or of a line are removed.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    raw = raw.withColumn(raw.columns[0], F.regexp_replace(F.col(f"`{raw.columns[0]}`"), "^\ufeff+", ""))
    first = F.col(f"`{raw.columns[0]}`")
    rows = raw.withColumn("__n", F.monotonically_increasing_id()).filter(~(F.lower(F.trim(first)).eqNullSafe(raw.columns[0].lstrip("﻿").strip().lower())))
    return rows.select(F.col("__n").alias("row_no"), *[(unguarded(F.coalesce(F.col(f"`{names[c.lower()]}`"), F.lit(""))) if c.lower() in names else F.lit(None).cast("string")).alias(c) for c in columns])


def write_report(rows: DataFrame, path: str) -> bool:
    """Whole rows once each, sorted, guarded; nothing is written for an empty report."""
    rows = rows.dropDuplicates()
    if rows.isEmpty():
        return False
    rows.orderBy(*rows.columns).select(*[guarded(F.col(c).cast("string")).alias(c) for c in rows.columns]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return True
