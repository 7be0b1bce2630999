"""Slides: overlaps, reading order, drawn diagrams, pictures, crops, fonts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: str, b: str, margin: int = 0) -> Column:
    """Whether the boxes of two aliases overlap by more than a margin."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") + margin < c(b, "x") + c(b, "w")) & (c(b, "x") + margin < c(a, "x") + c(a, "w")) & (c(a, "y") + margin < c(b, "y") + c(b, "h")) & (c(b, "y") + margin < c(a, "y") + c(a, "h"))


def before(a: str, b: str) -> Column:
    """Whether a box reads before another: wholly above it, or beside it and further left."""
    c = lambda t, n: F.col(f"{t}.{n}")
    above = c(a, "y") + c(a, "h") <= c(b, "y")
    beside = (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))
    return above | (beside & (c(a, "x") + c(a, "w") / 2 < c(b, "x") + c(b, "w") / 2))


def _pairs(shapes: DataFrame) -> DataFrame:
    """Pairs of one slide, the first earlier in the tree; a slide has tens of shapes."""
    a, b = shapes.alias("a"), shapes.alias("b")
    return a.join(b, (F.col("a.deck") == F.col("b.deck")) & (F.col("a.slide") == F.col("b.slide")) & (F.col("a.seq") < F.col("b.seq")))


def overlapping(shapes: DataFrame, margin: int = 0) -> DataFrame:
    """Pairs of one slide whose boxes overlap by more than a margin, the first earlier in the tree.

    A slide is cut into cells as large as its largest box, so a box touches four at most, and only boxes of one cell
    are compared; a pair counts in the cell that holds the corner where its overlap begins.
    """
    place = ["deck", "slide"]
    largest = shapes.groupBy(*place).agg(F.max(F.greatest("w", F.lit(1))).alias("cw"), F.max(F.greatest("h", F.lit(1))).alias("ch"))
    at = shapes.select(*place, "seq", "shape_id", "x", "y", "w", "h").join(largest, place)
    cell = lambda at, size: F.floor(F.col(at) / F.col(size))
    span = lambda p, d, size: F.sequence(cell(p, size), F.floor((F.col(p) + F.greatest(F.col(d), F.lit(0))) / F.col(size)))
    at = at.select("*", F.explode(span("x", "w", "cw")).alias("cx")).select("*", F.explode(span("y", "h", "ch")).alias("cy"))
    a, b = at.alias("a"), at.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*place, "cx", "cy")]
    begins = [F.col(f"a.{c}") == F.floor(F.greatest(f"a.{p}", f"b.{p}") / F.col(f"a.{size}")) for c, p, size in (("cx", "x", "cw"), ("cy", "y", "ch"))]
    met = a.join(b, reduce(and_, [*same, F.col("a.seq") < F.col("b.seq"), *begins, overlap("a", "b", margin)]))
    return met.select(F.col("a.deck").alias("deck"), F.col("a.slide").alias("slide"), F.col("a.shape_id").alias("first"), F.col("b.shape_id").alias("second"))


def reading_order(shapes: DataFrame) -> DataFrame:
    """deck, slide, inversions: slides whose tree order goes against their layout, or whose title is not first."""
    texts = shapes.filter("not coalesce(decorative, false)")
    wrong = _pairs(texts).filter(before("b", "a") & ~F.coalesce(F.col("a.is_title"), F.lit(False)) | F.coalesce(F.col("b.is_title"), F.lit(False)))
    return wrong.groupBy(F.col("a.deck").alias("deck"), F.col("a.slide").alias("slide")).agg(F.count("*").alias("inversions"))


def visual_order(shapes: DataFrame) -> DataFrame:
    """rank: each slide's shapes as they read.  Precedence is no total order, so a slide is sorted in one Python call."""
    schema = "deck string, slide int, shape_id int, rank int"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        from functools import cmp_to_key

        def first(a, b) -> int:
            if a.is_title != b.is_title:
                return -1 if a.is_title else 1
            if a.y + a.h <= b.y or b.y + b.h <= a.y:
                return -1 if a.y + a.h <= b.y else 1
            return (a.x + a.w / 2 > b.x + b.w / 2) - (a.x + a.w / 2 < b.x + b.w / 2)

        rows = sorted(part.sort_values("seq").itertuples(), key=cmp_to_key(first))
        return pd.DataFrame([(r.deck, r.slide, r.shape_id, i + 1) for i, r in enumerate(rows)], columns=["deck", "slide", "shape_id", "rank"])

    return shapes.groupBy("deck", "slide").applyInPandas(run, schema)


def drawn_diagrams(shapes: DataFrame, least: int = 8) -> DataFrame:
    """Slides with many loose shapes without text or with labels of a word or two."""
    loose = (F.col("kind") == "shape") & (F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")) <= 2)
    return shapes.filter(loose & F.col("parent_id").isNull()).groupBy("deck", "slide").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def needs_alt() -> Column:
    """object, shape or null by a shape's kind."""
    return F.when(F.col("kind").isin("picture", "chart", "diagram", "object", "media", "group"), "object").when((F.col("kind") == "shape") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "shape")


def tab_tables(shapes: DataFrame) -> DataFrame:
    """Shapes whose text makes a table with tabs: two lines with inner tabs, or one with three."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    inner = lambda p: F.regexp_count(F.trim(p), F.lit("\t"))
    return shapes.filter((F.size(F.filter(lines, lambda p: inner(p) >= 1)) >= 2) | F.exists(lines, lambda p: inner(p) >= 3))


def missing_alt(shapes: DataFrame) -> DataFrame:
    """Shapes that need a text and have none, but for those inside a group, at any depth, that has one."""
    place = ["deck", "slide"]
    need = shapes.filter(needs_alt().isNotNull() & (F.trim(F.coalesce("descr", F.lit(""))) == "") & ~F.coalesce("decorative", F.lit(False)))
    told = F.trim(F.coalesce("descr", F.lit(""))) != ""
    above = shapes.select(*place, F.col("shape_id").alias("up"), F.col("parent_id").alias("next"), told.alias("told"))
    at = need.select(*place, "shape_id", F.col("parent_id").alias("up"), F.array().cast(f"array<{dict(shapes.dtypes)['shape_id']}>").alias("seen")).filter("up is not null")
    covered = at.select(*place, "shape_id").limit(0)
    while True:  # ends, as a walk goes to no shape twice
        met = at.join(above, [*place, "up"]).select(*place, "shape_id", "told", "next", F.concat("seen", F.array("up")).alias("seen"))
        met = met.checkpoint() if met.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else met.persist()
        covered = covered.unionByName(met.filter("told").select(*place, "shape_id"))
        at = met.filter("not told and next is not null and not array_contains(seen, next)").select(*place, "shape_id", F.col("next").alias("up"), "seen")
        if at.isEmpty():
            return need.join(covered.distinct(), [*place, "shape_id"], "left_anti")


def violations(shapes: DataFrame, arrangement: DataFrame) -> DataFrame:
    """Overlapping pairs that an arrangement (deck, slide, shape_id, rank) would draw the other way round."""
    rank = lambda k, n: arrangement.select("deck", "slide", F.col("shape_id").alias(k), F.col("rank").alias(n))
    at = overlapping(shapes).join(rank("first", "__a"), ["deck", "slide", "first"]).join(rank("second", "__b"), ["deck", "slide", "second"])
    return at.filter("__a > __b").select("deck", "slide", "first", "second")


#: Shapes of a slide up to which its overlaps are sought together with those of other slides.
FEW_SHAPES = 32


def _drawn(title: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> list[int]:
    """Places of one slide's shapes, given as drawn: always the first by layout of those that no shape still waiting lies under."""
    n = len(x)
    waits, above = [0] * n, [[] for _ in range(n)]
    for i in range(1, n):
        under = np.flatnonzero((x[:i] < x[i] + w[i]) & (x[i] < x[:i] + w[:i]) & (y[:i] < y[i] + h[i]) & (y[i] < y[:i] + h[:i])).tolist()
        waits[i] = len(under)
        for j in under:
            above[j].append(i)
    last = lambda v: [math.inf if k != k else k for k in v.tolist()]
    keys = list(zip((~title).tolist(), last(y), last(x), range(n), strict=True))
    free, out = [keys[i] for i in range(n) if not waits[i]], []
    heapq.heapify(free)
    while free:
        pick = heapq.heappop(free)[-1]
        out.append(pick)
        for i in above[pick]:
            waits[i] -= 1
            if not waits[i]:
                heapq.heappush(free, keys[i])
    return out


def _drafted(slide: np.ndarray, title: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shapes of many slides, slide after slide, and their ranks.  Slides without overlaps are sorted all at once."""
    n = len(slide)
    start = np.flatnonzero(np.diff(slide, prepend=-1))
    size = np.diff(start, append=n)
    number = np.repeat(np.arange(len(start)), size)
    single = size > FEW_SHAPES
    for k in range(1, min(int(size.max()), FEW_SHAPES)):
        p, q = slice(None, n - k), slice(k, None)
        met = (number[p] == number[q]) & (x[p] < x[q] + w[q]) & (x[q] < x[p] + w[p]) & (y[p] < y[q] + h[q]) & (y[q] < y[p] + h[p])
        single[number[q][met]] = True
    order = np.lexsort((x, y, ~title, number))
    for g in np.flatnonzero(single).tolist():
        a, z = start[g], start[g] + size[g]
        order[a:z] = a + np.array(_drawn(title[a:z], x[a:z], y[a:z], w[a:z], h[a:z]))
    return order, np.arange(n) - start[number] + 1


def drafted_order(shapes: DataFrame) -> DataFrame:
    """rank of each slide's shapes as they read, but for overlapping ones, which stay in drawing order.

    The order is that of layout among the shapes that no shape still waiting lies under.  Slides come sorted, many in
    a batch; what a batch holds of its last slide waits for the next one.
    """
    place = ["deck", "slide"]
    rows = shapes.select("deck", F.col("slide").cast("long").alias("slide"), F.col("shape_id").cast("long").alias("shape_id"), "seq", "x", "y", "w", "h", F.coalesce("is_title", F.lit(False)).alias("is_title"))

    def ranked(part: pa.Table, code: np.ndarray) -> pa.RecordBatch:
        value = lambda c: part.column(c).to_numpy()
        order, rank = _drafted(code, value("is_title").astype(bool), *[value(c) for c in "xywh"])
        kept = part.select(["deck", "slide", "shape_id"]).take(pa.array(order))
        return pa.RecordBatch.from_arrays([*[kept.column(c).combine_chunks() for c in range(3)], pa.array(rank, pa.int32())], ["deck", "slide", "shape_id", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            part, code = _numbered(waiting)
            last = int(np.searchsorted(code, code[-1])) if len(code) else 0
            if last:
                yield ranked(part.slice(0, last), code[:last])
                waiting = part.slice(last).to_batches()
        part, code = _numbered(waiting)
        if len(code):
            yield ranked(part, code)

    def _numbered(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        """The batches as one table, and the number of each row's slide in it."""
        if not batches:
            return pa.table({}), np.zeros(0, np.int64)
        part = pa.Table.from_batches(batches)
        codes = [part.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in place]
        new = reduce(np.logical_or, [np.diff(c, prepend=c[:1]) != 0 for c in codes])
        return part, np.cumsum(new)

    dealt = rows.repartition(*place).sortWithinPartitions(*place, F.asc_nulls_last("seq"), "shape_id")
    return dealt.mapInArrow(run, "deck string, slide long, shape_id long, rank int")


def cropped_apart(pictures: DataFrame) -> DataFrame:
    """Images whose copies, all on slides, show different crops."""
    return pictures.groupBy("image").agg(F.bool_and(F.col("slide").isNotNull()).alias("placed"), F.countDistinct("crop").alias("crops")).filter("placed and crops > 1").select("image", "crops")


def alt_rows(pictures: DataFrame) -> DataFrame:
    """One row an image: its first 12 places and the distinct states of its text."""
    nth = F.row_number().over(Window.partitionBy("image").orderBy("seq", "place"))
    first = pictures.withColumn("__n", nth).filter("__n <= 12").groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "place"))), lambda x: x["place"]).alias("places"))
    states = pictures.groupBy("image").agg(F.array_sort(F.collect_set(F.coalesce("alt", F.lit("<absent>")))).alias("states"))
    return first.join(states, "image")


#: Installed typefaces that may be sent to every task.
MOST_FACES = 10_000


def nearest(wanted: DataFrame, fonts: DataFrame, vector: str = "panose", avoid: tuple[str, ...] = ()) -> DataFrame:
    """Each wanted typeface with the installed one at least distance, of equals the first by name; faces in ``avoid`` are passed over.

    The installed ones are counted first; more than MOST_FACES are an error, as they go to every task as one array.
    """
    own = fonts.filter(~F.col("face").isin(*avoid)) if avoid else fonts
    if own.limit(MOST_FACES + 1).count() > MOST_FACES:
        raise ValueError(f"more than {MOST_FACES} installed typefaces")
    every = own.agg(F.array_sort(F.collect_list(F.struct(F.col("face"), F.col(vector).alias("v")))).alias("fonts"))
    distance = lambda f: F.aggregate(F.zip_with(F.col(vector), f["v"], lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("fonts", lambda f: F.struct(distance(f).alias("distance"), f["face"].alias("face"))))
    return wanted.crossJoin(F.broadcast(every)).select(*wanted.columns, best["face"].alias("nearest"), best["distance"].alias("distance"))


def widest(uses: DataFrame, ratio: float = 2.0) -> DataFrame:
    """src, its largest shown width, pixels and whether it has more than ``ratio`` pixels for each shown one."""
    return uses.groupBy("src").agg(F.max("shown").alias("shown"), F.max("pixels").alias("pixels")).withColumn("too_wide", F.col("pixels") > F.col("shown") * ratio)
