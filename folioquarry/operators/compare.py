"""Two runs compared: fields of pages, files, references, reports and decks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import percent_decoded, within_tolerance
from folioquarry.operators.links import normal_path
from folioquarry.operators.page_rules import is_external

ABSENT = "<absent>"


def unpivoted(run: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value: one row for each compared field, as text."""
    return run.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*")


def compare_runs(before: DataFrame, after: DataFrame, key: str, fields: list[str], tolerant: tuple[str, ...] = (), percent: float = 2.0) -> DataFrame:
    """key, field, old, new of what differs, and a row with field null for keys of one run only (status says which).

    One full outer join by key; fields are told apart within the row, so nothing is shuffled for each field.
    """
    b = before.groupBy(key).agg(F.min(F.struct(*fields)).alias("b"))  # of rows that share a key the least
    a = after.groupBy(key).agg(F.min(F.struct(*fields)).alias("a"))
    both = b.join(a, key, "full")
    diff = []
    for f in fields:
        old, new = F.col(f"b.{f}"), F.col(f"a.{f}")
        equal = old.eqNullSafe(new)
        if f in tolerant:
            equal = equal | within_tolerance(old, new, percent)
        diff.append(F.when(~equal, F.struct(F.lit(f).alias("field"), F.coalesce(old.cast("string"), F.lit(ABSENT)).alias("old"), F.coalesce(new.cast("string"), F.lit(ABSENT)).alias("new"))))
    status = F.when(F.col("a").isNull(), "only-before").when(F.col("b").isNull(), "only-after").otherwise("both")
    found = F.when(status == "both", F.array_compact(F.array(*diff))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))))
    return both.select(key, status.alias("status"), F.inline(found))


def field_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status", "field").agg(F.count("*").alias("n"))


def compare_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """key and what became of it: gone, new, another extension, other bytes."""
    b = before.select("key", F.col("ext").alias("old_ext"), F.col("digest").alias("old_digest"))
    a = after.select("key", F.col("ext").alias("new_ext"), F.col("digest").alias("new_digest"))
    state = F.when(F.col("new_digest").isNull(), "only-before").when(F.col("old_digest").isNull(), "only-after").when(F.col("old_ext") != F.col("new_ext"), "renamed").when(F.col("old_digest") != F.col("new_digest"), "changed")
    return b.join(a, "key", "full").withColumn("state", state).filter("state is not null")


def compare_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one report only, as often as they are more in it."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def references(refs: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """bucket and key: references without a file, links without a page, files that nothing names."""
    lost = refs.filter("kind = 'asset'").select("key").distinct().join(files.select("key"), "key", "left_anti").withColumn("bucket", F.lit("missing-file"))
    dead = refs.filter("kind = 'page'").select("key").distinct().join(pages.select("key"), "key", "left_anti").withColumn("bucket", F.lit("missing-page"))
    orphan = files.select("key").distinct().join(refs.select("key"), "key", "left_anti").withColumn("bucket", F.lit("orphan"))
    return lost.unionByName(dead).unionByName(orphan)


PART = r"^(.*) \((\d+)\)$"


def align_decks(first: DataFrame, second: DataFrame) -> DataFrame:
    """deck, first, second: each slide of a deck's first version with the slides of the second that make it, in order.

    Slides go together by title; "Title (2)" and on continue "Title", so one slide may have several partners, a row
    each.  A title that comes later in the second version leaves what stands before it without a partner.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import re
        from bisect import bisect_left

        a, b = a.sort_values("slide"), b.sort_values("slide")
        deck = (a if len(a) else b)["deck"].iloc[0]
        old, new = [t or "" for t in a["title"]], [t or "" for t in b["title"]]
        here, there = a["slide"].tolist(), b["slide"].tolist()
        places: dict[str, list[int]] = {}
        for k, title in enumerate(new):
            places.setdefault(title, []).append(k)
        out, done = [], 0
        for i, title in enumerate(old):
            at = places.get(title, [])
            k = bisect_left(at, done)
            if k == len(at):
                out.append((deck, here[i], None))
                continue
            out += [(deck, None, there[j]) for j in range(done, at[k])]
            end = at[k] + 1
            if at[k] == done:  # parts follow only where the slide stands in its place
                stop = old[i + 1] if i + 1 < len(old) else None
                while end < len(new) and new[end] != stop and (m := re.match(PART, new[end])) and m[1] == title and int(m[2]) >= 2:
                    end += 1
            out += [(deck, here[i], there[j]) for j in range(at[k], end)]
            done = end
        out += [(deck, None, there[j]) for j in range(done, len(new))]
        return pd.DataFrame(out, columns=["deck", "first", "second"]).astype({"first": "Int64", "second": "Int64"})

    return first.select("deck", "slide", "title").groupBy("deck").cogroup(second.select("deck", "slide", "title").groupBy("deck")).applyInPandas(run, "deck string, first long, second long")


def compare_decks(first: DataFrame, second: DataFrame) -> DataFrame:
    """deck, slide, what: slides of one version alone, and those whose items or notes (arrays) differ from their partners' together."""
    pairs = align_decks(first, second)
    items = second.select("deck", F.col("slide").alias("second"), "items", "notes")
    gathered = F.array_sort(F.collect_list(F.when(F.col("second").isNotNull(), F.struct("second", "items", "notes"))))
    made = pairs.join(items, ["deck", "second"], "left").filter("first is not null").groupBy("deck", "first").agg(gathered.alias("parts"))
    both = made.join(first.select("deck", F.col("slide").alias("first"), F.col("items").alias("own"), F.col("notes").alias("own_notes")), ["deck", "first"])
    joined = lambda n: F.flatten(F.transform("parts", lambda p: p[n]))
    what = F.when(F.size("parts") == 0, F.array(F.lit("only in the first"))).otherwise(F.array_compact(F.array(F.when(joined("items") != F.col("own"), "content"), F.when(joined("notes") != F.col("own_notes"), "notes"))))
    extra = pairs.filter("first is null").select("deck", F.col("second").alias("slide"), F.lit("only in the second").alias("what"))
    return both.select("deck", F.col("first").alias("slide"), F.explode(what).alias("what")).unionByName(extra)


def field_examples(diff: DataFrame, key: str, k: int = 3) -> DataFrame:
    """How many rows differ in each field, and the first k of them by key."""
    counts = diff.groupBy("status", "field").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("status", "field").orderBy(key))
    shown = diff.withColumn("example", nth).filter(F.col("example") <= k)
    same = F.col("c.status").eqNullSafe(F.col("s.status")) & F.col("c.field").eqNullSafe(F.col("s.field"))
    return shown.alias("s").join(counts.alias("c"), same).select("s.status", "s.field", key, "example", "n")


def reference_key(src: Column, page: Column) -> Column:
    """The path without suffix, from the root, of a local file that a page names; null for addresses and fragments."""
    bare = F.split_part(F.split_part(F.trim(src), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    folder = F.regexp_extract(page, "^(.*)/[^/]*$", 1)
    path = percent_decoded(bare)
    whole = normal_path(F.when(path.startswith("/") | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path)))
    return F.when((bare != "") & ~is_external(F.trim(src)), F.regexp_replace(whole, r"(?<=[^./])\.[^./]*$", ""))
