"""Recomputing only what changed: work lists by content digest, and a file-stream wrapper around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_digest(rows: DataFrame, content: str, name: str = "sha") -> DataFrame:
    return rows.withColumn(name, F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))


def work(inputs: DataFrame, cache: DataFrame, options: str = "") -> DataFrame:
    """Inputs (path, sha) for which the cache has no result of the same bytes and options."""
    known = cache.filter(F.col("options") == options).select("path", "sha").distinct()
    return inputs.join(known, ["path", "sha"], "left_anti")


def kept(inputs: DataFrame, cache: DataFrame, options: str = "") -> DataFrame:
    """Cached results that still hold."""
    return cache.filter(F.col("options") == options).join(inputs.select("path", "sha"), ["path", "sha"], "left_semi")


def store(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with each path's rows replaced by its new ones."""
    return cache.join(results.select("path").distinct(), "path", "left_anti").unionByName(results)


def changed(old: DataFrame, new: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """key and which of the named digests differ, if any does."""
    both = old.alias("o").join(new.alias("n"), key)
    which = F.array_compact(F.array(*[F.when(~F.col(f"o.{p}").eqNullSafe(F.col(f"n.{p}")), F.lit(p)) for p in parts]))
    return both.select(key, which.alias("changed")).filter("size(changed) > 0")


def tree_digest(entries: DataFrame, group: list[str]) -> DataFrame:
    """One digest of a group's (path, digest) entries, in two levels, so that no group meets in one row.

    Paths go to 4,096 buckets by the first three digits of their SHA-256; a bucket's digest is that of its sorted lines
    "path digest", the group's that of its buckets' lines in order.
    """
    bucket = F.substring(F.sha2(F.col("path"), 256), 1, 3)
    line = F.concat("path", F.lit(" "), "digest")
    low = entries.groupBy(*group, bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
    return low.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit(" "), "digest"))), "\n"), 256).alias("digest"))


def report_current(states: DataFrame, now: DataFrame, key: list[str], parts: list[str]) -> DataFrame:
    """key and current: whether a report's recorded state equals that of now in all parts; reports without a state are not."""
    same = F.lit(True)
    for p in parts:
        same = same & F.col(f"n.{p}").eqNullSafe(F.col(f"s.{p}"))
    at = now.alias("n").join(states.withColumn("__there", F.lit(True)).alias("s"), key, "left")
    return at.select(*key, (F.coalesce("__there", F.lit(False)) & same).alias("current"))


def settings_digest(rows: DataFrame, group: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One digest of what each group is set to: sorted "name=value" lines, a null value as nothing after the sign; a group's settings are few."""
    line = F.concat(F.col(name), F.lit("="), F.coalesce(F.col(value).cast("string"), F.lit("")))
    return rows.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("digest"))


def cached_digests(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, sha) whose outline digest the cache (sha, outline) has, with it; and the others, which have to be read."""
    known = files.join(cache.select("sha", "outline").dropDuplicates(["sha"]), "sha", "left")
    return known.filter("outline is not null"), known.filter("outline is null").drop("outline")


def watch(spark: SparkSession, folder: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Run ``check`` over each micro-batch of new parquet files and append to ``out``; batches written twice are told apart by number."""

    def each(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
