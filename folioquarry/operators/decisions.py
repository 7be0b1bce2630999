"""Content joined with people's decisions on stable keys: values in effect, new, stale, conflicting, unreviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import same_language, tag


def last_rows(sidecar: DataFrame, key: list[str], row_no: str = "row_no") -> DataFrame:
    """The last row of each key, and whether its rows differ (conflict)."""
    rest = [c for c in sidecar.columns if c not in (*key, row_no)]
    value = F.struct(*rest)
    out = sidecar.groupBy(*key).agg(F.max_by(value, row_no).alias("v"), F.max(row_no).alias(row_no), (F.countDistinct(F.to_json(value)) > 1).alias("conflict"))
    return out.select(*key, "v.*", row_no, "conflict")


def in_effect(content: DataFrame, sidecar: DataFrame, key: list[str], declared: str, guess: str, reserved: tuple[str, ...] = ("manual",)) -> DataFrame:
    """value, supplier and status of every row: declared if it acts, nothing if reserved, else the guess."""
    rows = content.join(sidecar.select(*key, F.col(declared).alias("__said"), F.lit(True).alias("__row")), key, "left")
    said = F.nullif(F.trim("__said"), F.lit(""))
    kept = said.isin(*reserved)
    value = F.when(said.isNull(), F.col(guess)).when(kept, F.lit("")).otherwise(said)
    status = F.when(F.col("__row").isNull(), "new").when(said.isNull(), "blank").when(kept, said).otherwise("declared")
    supplier = F.when(said.isNotNull(), "sidecar").when(F.col(guess).isNotNull() & (F.col(guess) != ""), "guess").otherwise("")
    return rows.select(*content.columns, value.alias("value"), supplier.alias("supplier"), status.alias("status"))


def new_rows(content: DataFrame, sidecar: DataFrame, key: list[str]) -> DataFrame:
    return content.join(sidecar.select(*key).distinct(), key, "left_anti")


def stale_rows(content: DataFrame, sidecar: DataFrame, key: list[str]) -> DataFrame:
    return sidecar.join(content.select(*key).distinct(), key, "left_anti")


def unreviewed(sidecar: DataFrame, drafted: str, reviewed: str, by: list[str] | None = None) -> DataFrame:
    """How many rows were drafted and not reviewed."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return sidecar.groupBy(*(by or [])).agg(F.count_if(~empty(drafted) & empty(reviewed)).alias("n"))


def by_candidates(rows: DataFrame, candidates: list[F.Column], names: DataFrame, name_col: str, row_no: str) -> DataFrame:
    """Each name with the row whose first matching key (in candidate order) names it; of equal ranks the last row wins."""
    ways = rows.select("*", F.posexplode(F.array(*candidates)).alias("__rank", "__way"))
    met = ways.join(names.select(F.col(name_col).alias("__way")).distinct(), "__way")
    first = met.withColumn("__best", F.row_number().over(Window.partitionBy(row_no).orderBy("__rank"))).filter("__best = 1")
    return first.withColumn("__last", F.row_number().over(Window.partitionBy("__way").orderBy(F.desc(row_no)))).filter("__last = 1").withColumnRenamed("__way", name_col).drop("__rank", "__best", "__last")


def report(rows: DataFrame) -> DataFrame:
    """Whole rows once each, sorted by all columns."""
    return rows.dropDuplicates().orderBy(*rows.columns)


def bare_links(uses: DataFrame, sidecar: DataFrame, key: str = "url") -> DataFrame:
    """One row for each undecided address: its sources by first use, and the context of the first."""
    open_ = uses.join(sidecar.filter("replacement is not null").select(key).distinct(), key, "left_anti")
    each = open_.groupBy(key, "source").agg(F.min("seq").alias("seq"), F.min_by("context", "seq").alias("context"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]), "; ").alias("sources"), F.min_by("context", "seq").alias("context"))


def decide_language(row: F.Column, own: F.Column, project: F.Column) -> F.Column:
    """A person's row, else the file's own unless it differs from the project's by region only, else the project's."""
    return F.coalesce(tag(row), F.when(tag(own).isNotNull() & ~same_language(own, project), tag(own)), tag(project))


def majority(rows: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The value of most weight in each group; of equals the smallest."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return per.withColumn("__r", best).filter("__r = 1").drop("__r")


def cascade(layers: DataFrame, defaults: DataFrame) -> DataFrame:
    """Settings in effect: layers(layer, key, present, value) over defaults(key, value); the highest present layer wins, null clears to the default."""
    top = layers.filter("present").groupBy("key").agg(F.max_by(F.struct("value"), "layer").alias("v"))
    return defaults.withColumnRenamed("value", "default_value").join(top, "key", "full").select("key", F.coalesce("v.value", "default_value").alias("value"))


def conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose rows do not agree on a value."""
    return rows.groupBy(*key).agg(F.countDistinct(F.coalesce(F.col(value).cast("string"), F.lit("\0"))).alias("n_values")).filter("n_values > 1")
