"""Ordered rows: skipped levels, repeated keys, ordinals, pieces, running offsets, sticky values, stacks, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def level_skips(rows: DataFrame, group: list[str], order: list[str], level: str) -> DataFrame:
    """Rows whose level is more than one below the row just before; the first of a group never is."""
    last = F.lag(level).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("last", last).filter(f"last is not null and {level} > last + 1")


def repeats(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every occurrence of a key after its first, with its number."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("occurrence > 1")


def ordinals(rows: DataFrame, group: list[str], order: list[str], counted: str) -> DataFrame:
    """ordinal: the running count of the rows for which ``counted`` (SQL) holds; null on the others."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ordinal", F.when(F.expr(counted), F.sum(F.expr(f"cast(({counted}) as int)")).over(w)))


def pieces(rows: DataFrame, group: list[str], order: list[str], is_cut: str, role: str | None = None) -> DataFrame:
    """piece: how many cuts stand at or before a row; role: the last one declared, kept until the next."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("piece", F.sum(F.expr(f"cast(({is_cut}) as int)")).over(w))
    return out.withColumn("role_in_effect", F.last(role, ignorenulls=True).over(w)) if role else out


def running_offset(rows: DataFrame, group: list[str], order: list[str], count: str) -> DataFrame:
    """offset: the sum of ``count`` over all rows before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rank (from 1) of all rows in one order, without one task that sees them all.

    Rows are dealt by ranges of the order and written down; each gets the rows of the ranges before its own, whose
    counts (one a partition) are broadcast, beside its place in its own.
    """
    dealt = rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else dealt.persist()
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = dealt.withColumn("__part", part).join(F.broadcast(before.select("__part", "__before")), "__part")
    return at.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def close_level_gaps(rows: DataFrame, group: list[str], pos: str, level: str) -> DataFrame:
    """Levels lifted to one below their new parent's: a stack folded over each group's array, within the JVM."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(level).alias("level"))))
    packed = rows.groupBy(*group).agg(arr.alias("h"))
    start = F.expr("named_struct('stack', cast(array() as array<struct<old:int,new:int>>), 'out', cast(array() as array<struct<pos:bigint,level:int,new_level:int>>))")
    folded = F.aggregate(
        F.transform("h", lambda x: F.struct(x["pos"].cast("bigint").alias("pos"), x["level"].cast("int").alias("level"))),
        start,
        lambda s, x: _lift(s, x),
        lambda s: s["out"],
    )
    return packed.select(*group, F.inline(folded))


def _lift(s, x):
    open_ = F.filter(s["stack"], lambda e: e["old"] < x["level"])
    new = F.when(F.size(open_) == 0, x["level"]).otherwise(F.element_at(open_, -1)["new"] + 1)
    new = F.least(new, x["level"])
    return F.struct(F.concat(open_, F.array(F.struct(x["level"].alias("old"), new.alias("new")))).alias("stack"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), x["level"].alias("level"), new.alias("new_level")))).alias("out"))


def unique_names(rows: DataFrame, group: list[str], order: list[str], wanted: str, auto: str | None = None) -> DataFrame:
    """name: the wanted one for its first owner (one not automatic before one that is), else wanted-2, -3, ... that is free.

    Later names depend on earlier picks, so each group runs in order in one Python call; groups are documents.
    """
    schema = T.StructType(list(rows.schema) + [T.StructField("name", T.StringType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        owners = part.sort_values(([auto] if auto else []) + order, kind="stable").drop_duplicates(wanted).index
        taken, out = set(part[wanted].dropna()), {}
        for i, want in part[wanted].items():
            if want is None or i in owners:
                out[i] = want
                continue
            n = 2
            while f"{want}-{n}" in taken:
                n += 1
            out[i] = f"{want}-{n}"
            taken.add(out[i])
        return part.assign(name=pd.Series(out, dtype=object))

    return rows.groupBy(*group).applyInPandas(run, schema)


def split_pieces(blocks: DataFrame, doc: str = "doc", level: int = 2) -> DataFrame:
    """Pieces of documents cut at headings: number, title, parents, dotted position and a unique name.

    blocks: doc, pos, kind, level, text.  A heading without a body before a deeper cut is a group, not a piece.
    """
    schema = f"{doc} string, piece int, title string, parents array<string>, position string, name string, n_blocks int"

    def slug(text: str) -> str:
        import re

        return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-") or "part"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        stem = str(part[doc].iloc[0])
        stack: list[tuple[int, str]] = []
        counts: dict[int, int] = {}
        out, taken, body, open_ = [], set(), 0, None

        def close() -> None:
            nonlocal open_
            if open_ is not None and (body or open_[4]):
                title, parents, where, _, _ = open_
                name = f"{stem}--{slug(title)}" if title else stem
                if name in taken and parents:
                    name = f"{stem}--{slug(parents[-1])}--{slug(title)}"
                base, n = name, 2
                while name in taken:
                    name, n = f"{base}-{n}", n + 1
                taken.add(name)
                out.append((stem, len(out) + 1, title, parents, where, name, body))
            open_ = None

        rows = part.sort_values("pos").to_dict("records")
        for i, row in enumerate(rows):
            if row["kind"] == "heading" and row["level"] <= level:
                deeper = i + 1 < len(rows) and rows[i + 1]["kind"] == "heading" and row["level"] < rows[i + 1]["level"] <= level
                close()
                body = 0
                while stack and stack[-1][0] >= row["level"]:
                    stack.pop()
                counts[row["level"]] = counts.get(row["level"], 0) + 1
                for k in [k for k in counts if k > row["level"]]:
                    del counts[k]
                where = ".".join(str(counts[k]) for k in sorted(counts))
                open_ = (row["text"], [t for _, t in stack], where, row["level"], not deeper)
                stack.append((row["level"], row["text"]))
            else:
                if open_ is None:
                    open_ = ("", [], "0", 0, True)
                body += 1
        close()
        return pd.DataFrame(out, columns=[doc, "piece", "title", "parents", "position", "name", "n_blocks"])

    return blocks.select(F.col(doc).cast("string").alias(doc), "pos", "kind", "level", "text").groupBy(doc).applyInPandas(run, schema)


def number_within(rows: DataFrame, group: list[str], order: list[str], label: str, counted: str = "true") -> DataFrame:
    """number and text ("Figure 3.2") of the counted rows within their chapter (the first column of ``group``)."""
    out = ordinals(rows, group, order, counted)
    return out.withColumn("label", F.when(F.col("ordinal").isNotNull(), F.concat(F.lit(label + " "), F.col(group[0]).cast("string"), F.lit("."), F.col("ordinal").cast("string"))))


def book_index(terms: DataFrame, term: str, page: str, order: str) -> DataFrame:
    """letter, term and its pages in order: an inverted index; what starts with no letter stands under Symbols."""
    first = F.upper(F.substring(F.translate(F.trim(term), "ÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜàáâäãåçèéêëìíîïñòóôöõùúûü", "AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuu"), 1, 1))
    each = terms.groupBy(F.when(first.rlike("[A-Z]"), first).otherwise("Symbols").alias("letter"), F.trim(term).alias("term"), F.col(page).alias("page")).agg(F.min(order).alias("seq"))
    return each.groupBy("letter", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("page").cast("string").alias("p")))), lambda x: x["p"]), ", ").alias("pages"))


def one_of_each(rows: DataFrame, shape: list[str], order: list[str]) -> DataFrame:
    """The first row of every shape."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*shape).orderBy(*order))).filter("__n = 1").drop("__n")


def examples(rows: DataFrame, field: list[str], order: list[str], k: int) -> DataFrame:
    """How many rows each field has and the first k of them: a top-k by group."""
    w = Window.partitionBy(*field).orderBy(*order)
    counted = rows.groupBy(*field).agg(F.count("*").alias("n_rows"))
    return rows.withColumn("example", F.row_number().over(w)).filter(F.col("example") <= k).join(counted, field)
