"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints are the minimum 5-word hash of each 6 consecutive ones (the rightmost of equals), so any shared
span of 10 words gives both sides one fingerprint at the same place of the span.  Fingerprints of documents
and items are joined; a hit names the offset between the two texts, and the item's words round it are compared
along it, which finds every shared window exactly.  Items of fewer than 10 words are one window, found by
the hash of as many document words, and compared likewise.

A fingerprint of an item carries the at most 15 words round it that a window with it can hold, so what is joined grows
with the benchmark's words, however they are dealt to items.  It is broadcast while it has ``broadcast_rows`` rows at
most (some 40 MB); beyond that both sides are shuffled by fingerprint and the hits go back to their documents by a
second join.

Defined results: null and empty texts have no words and are clean; items without words are left out; rows
that repeat give one result each; an empty benchmark leaves all documents clean; an item id that repeats
counts once, whatever its texts, all of which are compared; items without an id count as one more item, which
has no name in ``items``; only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import Scratch, bounded, unused
from folioquarry.llm.textsql import starts, words_of

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Fingerprints of the benchmark that may be broadcast; each has 15 words at most.
BROADCAST_ROWS = 100_000
_LOW = 7  # bits of a packed hash that hold its place in the window, as SPAN <= 8


def _gram(words: Column, at: Column, k: int) -> Column:
    """Hash of k words from a place on, the low bits cleared."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + i) for i in range(k)]).bitwiseAND(F.lit(~_LOW))


def _grams(words: Column, k: int) -> Column:
    return F.transform(starts(F.size(words), k), lambda i: _gram(words, i, k))


def _minima(hashes: Column) -> Column:
    """For each window of SPAN hashes its minimum, with (SPAN - 1 - place) in the low bits."""
    return F.transform(starts(F.size(hashes), SPAN), lambda i: F.least(*[F.get(hashes, i + j).bitwiseOR(F.lit(SPAN - 1 - j)) for j in range(SPAN)]))


def _place(packed: Column, window: Column) -> Column:
    return (window + (SPAN - 1) - packed.bitwiseAND(F.lit(_LOW))).cast("int")


def fingerprints(df: DataFrame, keep: list[str], words: str = "w", marker: bool = False) -> DataFrame:
    """keep, fp and pos: the winnowed fingerprints of each row; with ``marker`` one more row whose fp is null."""
    df = df.withColumn("h", _grams(F.col(words), GRAM)).withColumn("m", _minima(F.col("h")))
    first = F.array(F.lit(None).cast("long")) if marker else F.array().cast("array<long>")
    out = df.select(*keep, "m", F.posexplode(F.concat(first, "m")).alias("at", "packed"))
    window = F.col("at") - (1 if marker else 0)
    before = F.get(F.col("m"), window - 1)
    new = (window == 0) | (_place(F.col("packed"), window) != _place(before, window - 1))
    out = out.filter(F.col("packed").isNull() | new)
    return out.select(*keep, F.col("packed").bitwiseAND(F.lit(~_LOW)).alias("fp"), _place(F.col("packed"), window).alias("pos"))


def _short(df: DataFrame, keep: list[str], lengths: list[int], words: str = "w") -> DataFrame:
    """keep, fp and pos of every run of as many words as one of ``lengths``."""
    runs = F.concat(*[F.transform(_grams(F.col(words), k), lambda h, i: F.struct(h.alias("fp"), i.cast("int").alias("pos"))) for k in lengths])
    return df.select(*keep, F.explode(runs).alias("r")).select(*keep, "r.fp", "r.pos")


def _hits(words: Column, item: Column, offset: Column) -> Column:
    """Document places that windows of the item cover when it is laid at an offset of the document."""
    size = F.least(F.size(item), F.lit(WINDOW))
    same = F.transform(item, lambda x, j: F.coalesce(F.get(words, offset + j) == x, F.lit(False)))
    whole = F.filter(starts(F.size(item), size), lambda j: F.forall(F.slice(same, j + 1, size), lambda x: x))
    return F.array_distinct(F.flatten(F.transform(whole, lambda j: F.sequence(offset + j, offset + j + size - 1))))


def _round(words: Column, place: Column) -> tuple[Column, Column]:
    """The words that windows with the gram at a place can hold, and where they begin."""
    low = F.greatest(place - (WINDOW - GRAM), F.lit(0))
    return F.slice(words, low + 1, place + WINDOW - low), low


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, broadcast_rows: int) -> DataFrame:
    """id, text_hash, n_words, copies, items, unnamed and n_hit of each text of each id."""
    ref = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words_of(F.col(f"`{item_text}`")).alias("iw")).filter("size(iw) > 0")
    long_items, short_items = ref.filter(F.size("iw") >= WINDOW), ref.filter(F.size("iw") < WINDOW)
    lengths = sorted(ref.agg(F.collect_set(F.when(F.size("iw") < WINDOW, F.size("iw"))).alias("short")).first()["short"])  # nine at most
    key = ["id", "text_hash"]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    near, low = _round(F.col("iw"), F.col("pos"))
    marks = fingerprints(long_items, ["item", "iw"], "iw").select("item", "fp", (F.col("pos") - low).alias("q"), near.alias("iw")).distinct()
    sides = [(fingerprints(rows, [*key, "w"], marker=True), marks)]
    if lengths:
        sides.append((_short(rows, [*key, "w"], lengths), _short_items(short_items, lengths)))
    found = None
    for left, right in sides:
        if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
            part = left.join(F.broadcast(right), "fp", "left").filter("fp is null or iw is not null")
        else:
            part = _by_shuffle(left.drop("w"), right, rows, marks=found is None)
        # no filter uses the comparison below: such a filter would leave code generation and copy the words of every row
        part = part.select(*key, F.when(F.col("fp").isNull(), F.size("w")).alias("n_words"), "item", F.when(F.col("iw").isNotNull(), _hits(F.col("w"), F.col("iw"), F.col("pos") - F.col("q"))).alias("places"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.size("places") > 0, F.col("item")))).alias("items"),
        F.max(F.when(F.size("places") > 0, F.col("item").isNull().cast("int"))).alias("unnamed"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n_hit"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted ids) for each document row."""
    per = _judged(docs, items, id_col, text_col, item_id, item_text, broadcast_rows)
    per = per.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return per.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long"),
        F.col("n_hit").cast("long"),
        (F.size("items") + F.coalesce("unnamed", F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def retain(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, with their own columns alone, whose texts hold no window of an item; each text of an id by itself.

    The texts that go are broadcast while they are few; beyond ``BROADCAST_ROWS`` of common.py both sides are shuffled.
    """
    hit = _judged(docs, items, id_col, text_col, item_id, item_text, broadcast_rows).filter("n_hit > 0")
    gone_id, gone_hash = unused(docs, "gone_id"), unused(docs, "gone_hash")
    gone = Scratch(docs.sparkSession).put(hit.select(F.col("id").alias(gone_id), F.col("text_hash").alias(gone_hash)))
    same = (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(gone_hash)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id))
    return docs.join(bounded(gone), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _short_items(items: DataFrame, lengths: list[int]) -> DataFrame:
    fp = F.coalesce(*[F.when(F.size("iw") == k, _gram(F.col("iw"), F.lit(0), k)) for k in lengths])
    return items.select("item", fp.alias("fp"), F.lit(0).alias("q"), "iw").distinct()


def _by_shuffle(left: DataFrame, right: DataFrame, rows: DataFrame, marks: bool) -> DataFrame:
    """What the broadcast join gives, for large benchmarks: fingerprints alone are shuffled, then hits meet their documents."""
    right = right.withColumn("item_hash", F.xxhash64("iw"))  # an id may have several texts, or be null
    pairs = left.filter("fp is not null").join(right, "fp").select("id", "text_hash", "fp", (F.col("pos") - F.col("q")).alias("pos"), "item", "item_hash", "iw")
    hits = pairs.groupBy(F.col("id").alias("d"), F.col("text_hash").alias("t"), "item", "item_hash", "pos").agg(F.first("iw").alias("iw"), F.first("fp").alias("fp")).withColumn("q", F.lit(0))
    texts = rows.dropDuplicates(["id", "text_hash"])
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    columns = ["id", "text_hash", "w", "fp", "pos", "q", "item", "iw"]
    back = hits.join(texts, same).select(columns)
    if not marks:
        return back
    none = [F.lit(None).cast(t).alias(c) for c, t in (("fp", "long"), ("pos", "int"), ("q", "int"), ("item", "string"), ("iw", "array<string>"))]
    return back.unionByName(rows.select(*columns[:3], *none))
