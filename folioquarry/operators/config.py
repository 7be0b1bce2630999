"""Configuration as rows: layered settings merged by dotted key, typed by a schema, problems beside values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import boolean_word, tag

SCHEMA = "key string, type string, default string, low double, high double, choices array<string>, target_only boolean, book_level boolean"


def _flat(value, prefix: str = "") -> list[tuple[str, str | None]]:
    """Dotted keys of nested settings, with lists and texts as JSON; a section that is null or empty says nothing."""
    if not isinstance(value, dict):
        raise ValueError(f"{prefix.rstrip('.') or 'the file'} is no block of settings")
    out: list[tuple[str, str | None]] = []
    for k, v in value.items():
        out += _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", None if v is None else json.dumps(v, default=str))]
    return out


def load_settings(text: str) -> list[tuple[str, str | None]]:
    """Dotted keys and JSON values of a YAML file (JSON where no YAML reader is installed); a key that stands twice is an error."""
    try:
        import yaml
    except ImportError:

        def once(pairs: list) -> dict:
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError("a key stands twice")
            return dict(pairs)

        return _flat(json.loads(text or "{}", object_pairs_hook=once))

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(str, keys))) < len(keys):
            raise ValueError(f"a key stands twice in line {node.start_mark.line + 1}")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return _flat(yaml.load(text or "{}", Loader=Strict) or {})


def read_settings(files: DataFrame, text: str = "value") -> DataFrame:
    """source, layer, key, value (JSON, null where the file clears it) and problem of every setting of configuration files."""
    schema = "source string, layer int, key string, value string, problem string"

    def run(batches):
        for batch in batches:
            rows = []
            for source, layer, body in zip(batch["source"], batch["layer"], batch["text"], strict=True):
                try:
                    rows += [(source, layer, k, v, None) for k, v in load_settings(body)]
                except Exception as e:  # a file that cannot be read is a problem of its own
                    rows.append((source, layer, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "layer", "key", "value", "problem"])

    return files.select("source", F.col("layer").cast("int").alias("layer"), F.col(text).cast("string").alias("text")).mapInPandas(run, schema)


def _said(value: Column) -> Column:
    """A JSON value as plain text: strings without their quotes."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def coerced(value: Column, kind: Column, low: Column, high: Column, choices: Column) -> Column:
    """struct(value, problem) of a JSON value by the type of its setting; what does not fit is null with a problem."""
    text, is_text, is_bool = F.trim(_said(value)), value.startswith('"'), value.isin("true", "false")
    number = text.try_cast("double")
    whole = text.rlike(r"^[+-]?[0-9]+(\.0*)?$")
    fits = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & F.coalesce(number >= low, F.lit(True)) & F.coalesce(number <= high, F.lit(True)) & ~is_bool
    word = F.when(is_bool, F.when(text == "true", "on").otherwise("off")).otherwise(F.lower(text))
    chosen = F.get(F.filter(choices, lambda c: F.lower(c) == word), F.lit(0))
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), text)
    out = lambda v, problem: F.struct(v.cast("string").alias("value"), F.when(v.isNull(), F.lit(problem)).cast("string").alias("problem"))
    listed = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
    return (
        F.when(kind == "opaque", out(value, "")).when(kind == "list", out(listed, "")).when(kind == "bool", out(boolean_word(text).cast("string"), "is not true or false"))
        .when(kind == "int", out(F.when(fits & whole, number.cast("bigint")), "is not a whole number in range")).when(kind == "float", out(F.when(fits, number), "is not a number in range"))
        .when(kind == "enum", out(chosen, "is not one of the choices")).when(kind == "date", out(date, "is not a date")).when(is_bool, out(F.lit(None).cast("string"), "was read as true or false; quote it"))
        .when(kind == "language", out(tag(text), "is not a language tag")).when(~is_text, out(F.lit(None).cast("string"), "is a number; quote it to keep it as written")).otherwise(out(_said(value), ""))
    )


def resolve(settings: DataFrame, schema: DataFrame, by: list[str] | None = None) -> DataFrame:
    """key, value, source and problem of every setting of a schema, for each group of ``by`` (a project, a target).

    The highest layer that says a key wins, whole; null there means the schema's default, as does a value that does
    not fit, with its problem.  Keys that the schema lacks come back with a problem and their value.
    """
    by = by or []
    top = F.row_number().over(Window.partitionBy(*by, "key").orderBy(F.desc("layer"), F.desc("source")))
    said = settings.filter("key is not null").withColumn("__n", top).filter("__n = 1").select(*by, "key", F.col("value").alias("__said"), "source", F.lit(True).alias("__there"))
    wanted = settings.select(*by).distinct().crossJoin(F.broadcast(schema)) if by else schema  # a schema has some hundred settings
    at = wanted.join(said, [*by, "key"], "full")
    known, given = F.col("type").isNotNull(), F.col("__there").isNotNull() & F.col("__said").isNotNull()
    at = at.withColumn("__x", F.when(known & given, coerced(F.col("__said"), F.col("type"), F.col("low"), F.col("high"), F.col("choices"))))
    value = F.when(~known, F.col("__said")).when(given & F.col("__x.problem").isNull(), F.col("__x.value")).otherwise(F.col("default"))
    problem = F.when(~known, "is no setting").otherwise(F.col("__x.problem"))
    return at.select(*by, "key", value.alias("value"), "source", problem.alias("problem"))


def misplaced(settings: DataFrame, schema: DataFrame) -> DataFrame:
    """Settings (block: defaults or target) that stand in a block they do not belong to."""
    at = settings.join(F.broadcast(schema.select("key", "target_only", "book_level")), "key")
    why = F.when(F.col("target_only") & (F.col("block") == "defaults"), "belongs to a target").when(F.col("book_level") & (F.col("block") == "target") & F.col("value").isNotNull(), "belongs to defaults")
    return at.withColumn("problem", why).filter("problem is not null").select("source", "block", "key", "problem")
