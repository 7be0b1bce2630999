"""Operator 4: near duplicates by DartMinHash signatures, banded joining and exact checks.

Each shingle owns a quadrant of weight and rank on which hashed darts fall with unit density (a Poisson number a
cell of unit area).  A text's darts are those below its shingles' weights and below a rank that yields some
K ln K + 2 K of them; each dart belongs to one of K coordinates, and the earliest of a coordinate is the
signature's value there, so two texts agree at a coordinate with the chance of their weighted Jaccard similarity.
Signatures are cut into bands; texts that share a band are candidates.

Copies are first folded to one text by digest.  Each band's texts are compared exactly with one leader, and those
that prove similar join one class (components, by contraction).  Texts of bands that still hold several classes then
meet by prefix filtering: their rarest shingles are the join keys, and sizes and places bound what a pair can share.
So every pair of texts that shares a band is settled, and no group is expanded into all its pairs.

Defined results: a null text is a class of its own; texts without words belong together only if they are equal; a
text of fewer than five words is one shingle; ties go to the smaller id, then the smaller hash of the text; a row
without an id is classed by its text, comes after all rows with one, and a class without any id has a null class_id;
rows that repeat share a class, and are all first if one is, of which deduplicate() leaves one; texts of one id are
classed each by itself; an empty table gives no rows; only the named columns are read, all others are kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import Scratch, Words, bounded, mixed, over_texts, unused, word_hashes

SHINGLE, BANDS, ROWS = 5, 42, 6
COORDINATES = BANDS * ROWS
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_U = np.uint64


def all_shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """text number and hash of each shingle; texts of fewer words than a shingle come last."""
    w = Words(texts)
    h, n = word_hashes(w), len(w.start)
    size = np.bincount(w.doc, minlength=len(texts))
    with np.errstate(over="ignore"):
        full = n - k + 1
        if full > 0:
            s = h[:full].copy()
            for j in range(1, k):
                s = mixed(s * _U(0x9E3779B97F4A7C15) + h[j : j + full])
            whole = w.doc[:full] == w.doc[k - 1 :]
            doc, value = w.doc[:full][whole], s[whole]
        else:
            doc, value = np.zeros(0, np.int64), np.zeros(0, _U)
        for d in np.flatnonzero((size > 0) & (size < k)):
            a = int(np.searchsorted(w.doc, d))
            s = _U(size[d])
            for x in h[a : a + size[d]]:
                s = mixed(np.array([s * _U(0x9E3779B97F4A7C15) + x]))[0]
            doc, value = np.append(doc, d), np.append(value, s)
    return doc, value


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, hash and count of each distinct shingle, by text and hash."""
    doc, value = all_shingles(texts, k)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def _darts(element: np.ndarray, weight: np.ndarray, reach: np.ndarray, owner: np.ndarray):
    """owner, rank and hash of every dart of the elements below their weights and below their owners' reach.

    Weight bands are [0, 1), [1, 2), [2, 4) and so on; each is cut into ranks so that a cell's area is 1.
    """
    parts, low, band = [], 0.0, 0
    while len(use := np.flatnonzero(weight > low)):
        width = 1.0 if band == 0 else low
        cells = np.ceil(reach[owner[use]] * width).astype(np.int64)
        which = np.repeat(use, cells)
        row = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        with np.errstate(over="ignore"):
            seed = mixed(element[use] + _U(band) * _U(0xD6E8FEB86659FD93))
            cell = mixed(np.repeat(seed, cells) + row.astype(_U) * _U(0xA0761D6478BD642F))
            number = np.searchsorted(_POISSON, (cell >> _U(11)) * 2.0**-53, side="right")
            again = np.repeat(np.arange(len(cell)), number)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(number) - number, number)
            dart = mixed(cell[again] + (nth + 1).astype(_U) * _U(0xE7037ED1A0B428DB))
            rank = (row[again] + (mixed(dart) >> _U(11)) * 2.0**-53) / width
            own = owner[which[again]]
            hit = np.flatnonzero(rank < reach[own])
            own, rank, dart, top = own[hit], rank[hit], dart[hit], weight[which[again[hit]]]
            if (top < low + width).any():  # some weights end within the band
                hit = low + width * ((mixed(dart + _U(2)) >> _U(11)) * 2.0**-53) < top
                own, rank, dart = own[hit], rank[hit], dart[hit]
        parts.append((own, rank, dart))
        low, band = low + width, band + 1
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k values: the hash of each text's earliest dart at each coordinate; texts without elements have zeros."""
    out = np.zeros((n, k), _U)
    total = np.bincount(doc, weights=weight, minlength=n)
    todo, aim = total > 0, k * math.log(k) + 2 * k
    while todo.any():
        reach = np.where(todo, aim / np.maximum(total, 1e-300), 0)
        use = todo[doc]
        own, rank, dart = _darts(element[use], weight[use].astype(float), reach, doc[use])
        place = own * k + (mixed(dart + _U(3)) % _U(k)).astype(np.int64)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        out.reshape(-1)[place[first]] = dart[first]
        todo &= np.isinf(best.reshape(n, k)).any(1)
        aim *= 2
    return out


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hash of each band's values with its number."""
    with np.errstate(over="ignore"):
        out = np.repeat(np.arange(n_bands, dtype=_U)[None, :], len(signature), 0)
        for j in range(rows):
            out = mixed(out * _U(0x9E3779B97F4A7C15) + signature[:, j : n_bands * rows : rows])
    return out.view(np.int64)


def _digest(text: str | None) -> bytes | None:
    return None if text is None else hashlib.md5(b" ".join(text.encode().split()) if text.split() else b"\0" + text.encode()).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str, weighted: bool = False) -> DataFrame:
    """id, raw (hash of the text as it is), digest of the words, and bands (none without words) of every row."""

    def kernel(texts: list[str | None]) -> list[list]:
        out = []
        for i in range(0, len(texts), 64):  # so few that the arrays stay in the processor's cache
            part = texts[i : i + 64]
            if weighted:
                doc, element, weight = shingles(part)
            else:  # that a shingle repeats changes no minimum
                doc, element = all_shingles(part)
                weight = np.ones(len(doc))
            found = bands(signatures(doc, element, weight, len(part)))
            some = np.bincount(doc, minlength=len(part)) > 0
            out += [b if s else b[:0] for b, s in zip(found, some, strict=True)]
        return [[_digest(t) for t in texts], out]

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return over_texts(_rows(docs, id_col, text_col), "text", kernel, T.StructType(fields), ["id", "raw"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("raw"), text.alias("text"))


def _sets(docs: DataFrame, id_col: str, text_col: str, texts: DataFrame) -> DataFrame:
    """vid and set (sorted shingle hashes) of the given texts (vid, digest, and the row that stands for them).

    The rows that are wanted are broadcast while they are few; beyond ``BROADCAST_ROWS`` both sides are shuffled.
    """

    def kernel(parts: list[str | None]) -> list[list]:
        doc, element, _ = shingles(parts)
        return [[_digest(t) for t in parts], np.split(element.view(np.int64), np.searchsorted(doc, np.arange(1, len(parts))))]

    wanted = texts.select(F.col("row.id").alias("wanted_id"), F.col("row.raw").alias("wanted_raw"))
    rows = _rows(docs, id_col, text_col)
    rows = rows.join(bounded(wanted), (F.col("raw") == F.col("wanted_raw")) & F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType()))]
    found = over_texts(rows, "text", kernel, T.StructType(fields), ["raw"])
    return found.join(texts.select("digest", "vid"), "digest").dropDuplicates(["vid"]).select("vid", "set")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets' Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("vid").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("vid").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """vid and root (one vertex of its component) of every vertex, by rounds of contraction.

    Each vertex goes to the neighbour of least hash unless its own is less; edges between what is left go on.
    A star collapses in two rounds; the hash is salted anew every second round, so that each pair of rounds
    removes an expected constant share of the vertices of any graph.
    """
    edges, known, turn = scratch.put(edges.distinct()), None, 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn // 2), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        least = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(order("b")).alias("m"))
        goes = scratch.put(least.select(F.col("a").alias("v"), F.least(F.col("m"), order("a"))["v"].alias("to")))
        now = goes.select(F.col("v").alias("vid"), F.col("to").alias("root"))
        if known is not None:
            now = known.join(goes, known["root"] == goes["v"], "left").select("vid", F.coalesce("to", "root").alias("root"))
        now = scratch.put(now)
        ends = edges.join(goes.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(goes.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        left = scratch.put(ends.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        scratch.drop(edges, known, goes)
        edges, known, turn = left, now, turn + 1
    return known if known is not None else edges.select(F.col("a").alias("vid"), F.col("b").alias("root"))


def stars(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each band's leader with its other members: the leader is in the largest bands, so amid its copies."""
    weight = members.groupBy("vid").agg(F.sum("n").alias("weight"))
    members = scratch.put(members.join(weight, "vid"))
    lead = scratch.put(members.groupBy("band").agg((-F.max(F.struct("weight", (-F.col("vid")).alias("v")))["v"]).alias("a")))
    return members.select("band", F.col("vid").alias("b")).join(lead, "band").filter("a != b").select("a", "b").distinct()


def unsettled(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """vid, root and outside of the texts of bands that hold several classes; outside: not of some such band's largest class."""
    now = members.select("vid", "band").join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    sizes = now.groupBy("band", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("band").agg(F.max(F.struct("c", "root"))["root"].alias("most"), F.count("*").alias("k")).filter("k > 1")
    several = scratch.put(several.select("band", "most"))
    return now.join(several, "band").groupBy("vid").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("most")).alias("outside"))


def prefixes(texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """s, place and n beside the columns of ``texts``: the shingles by which a similar pair must meet.

    A text's shingles go from rare to frequent among these texts; two texts of the threshold's similarity share
    one of the first n - ceil(threshold n) + 1.  Shingles of one text alone keep their places and are left out.
    """
    each = texts.select("vid").join(sets, "vid").select("vid", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often")).filter("often > 1")
    # one row for each text: a list of its own shingles
    lists = each.join(often, "s").groupBy("vid", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("list"))
    alone = F.col("n") - F.size("list")
    reach = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - alone
    lists = lists.select("vid", "n", alone.alias("alone"), F.slice("list", F.lit(1), F.greatest(reach, F.lit(0)).cast("int")).alias("list"))
    return lists.select("vid", "n", "alone", F.posexplode("list").alias("i", "x")).select("vid", "n", F.col("x.s").alias("s"), (F.col("alone") + F.col("i")).alias("place")).join(texts, "vid")


def residue(prefix: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes, one of them outside, that meet by a prefix and may reach the threshold.

    What lies behind the meeting place bounds the common shingles, and the bound must reach what the sizes ask for.
    """
    a = prefix.filter("outside").select(*[F.col(c).alias(f"{c}_a") for c in ("vid", "root", "n", "place")], "s")
    b = prefix.select(*[F.col(c).alias(f"{c}_b") for c in ("vid", "root", "n", "place", "outside")], "s")
    once = ~F.col("outside_b") | (F.col("vid_a") < F.col("vid_b"))
    need = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    met = a.join(b, (a["s"] == b["s"]) & (F.col("root_a") != F.col("root_b")) & once & sizes & (most >= need))
    return met.select(F.col("vid_a").alias("a"), F.col("vid_b").alias("b")).distinct()


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, weighted: bool, scratch: Scratch) -> DataFrame:
    """id, raw and key (one number for each class; null for null texts) of every row, as a table; all that led to it is deleted."""
    rows = scratch.put(sketch(docs, id_col, text_col, weighted))
    texts = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw")).alias("row"), F.first("bands").alias("bands"))
    texts = scratch.put(texts.withColumn("vid", F.monotonically_increasing_id()))  # fixed by the table that is written
    members = texts.select("vid", F.explode("bands").alias("band"))
    # counts by band are written before they are joined, as Spark splits a hot key only where both sides come from a shuffle or a table
    shared = scratch.put(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
    members = scratch.put(members.join(shared, "band"))
    scratch.drop(shared)
    needed = scratch.put(texts.join(members.select("vid").distinct(), "vid", "left_semi").select("vid", "digest", "row"))
    sets = scratch.put(_sets(docs, id_col, text_col, needed))
    links = scratch.put(similar(stars(members, scratch), sets, threshold))
    roots = components(links, scratch)
    left = scratch.put(unsettled(members, roots, scratch))
    prefix = scratch.put(prefixes(left, sets, threshold))
    more = scratch.put(similar(residue(prefix, threshold), sets, threshold))
    if not more.isEmpty():
        # classes so far and the links between them: as many rows as texts, however many links there were
        both = roots.filter("vid != root").select(F.col("vid").alias("a"), F.col("root").alias("b")).union(more)
        old, roots = roots, components(both, scratch)
        scratch.drop(old)
    scratch.drop(members, needed, sets, links, left, prefix, more)
    keys = texts.select("digest", "vid").join(roots, "vid", "left").select("digest", F.coalesce("root", "vid").alias("key"))
    out = scratch.put(rows.select("id", "raw", "digest").join(keys, "digest", "left").select("id", "raw", "key"))
    scratch.drop(rows, texts, roots)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """id_col, class_id (the smallest id of the class) and is_first for every row."""
    scratch = Scratch(docs.sparkSession)
    rows = _classed(docs, id_col, text_col, threshold, weighted, scratch)
    first = scratch.put(_firsts(rows)).select("key", F.col("first.id").alias("first_id"), F.col("first.raw").alias("first_raw"))
    out = rows.join(first, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("first_id"))
    is_first = F.col("key").isNull() | (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw")))
    return out.select(F.col("id").alias(id_col), own.alias("class_id"), is_first.alias("is_first"))


def _firsts(rows: DataFrame) -> DataFrame:
    """key and first (no_id, id, raw, copies) of every class: its smallest row, rows without an id last."""
    each = rows.filter("key is not null").groupBy("key", "id", "raw").agg(F.count("*").alias("copies"))
    return each.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw", "copies")).alias("first"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class, with its own columns alone: that of the smallest id, and one of rows that repeat it.

    The rows that go are broadcast while they are few; beyond ``BROADCAST_ROWS`` both sides are shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _classed(docs, id_col, text_col, threshold, False, scratch)
    firsts = scratch.put(_firsts(rows))
    stay = firsts.select("key", F.col("first.id").alias("first_id"), F.col("first.raw").alias("first_raw"))
    gone = rows.join(stay, "key").filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw"))))
    gone_id, gone_raw, own_raw = (unused(docs, n) for n in ("gone_id", "gone_raw", "own_raw"))
    gone = scratch.put(gone.select(F.col("id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct())
    raw = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    its = [F.col(f"`{c}`") for c in docs.columns]
    is_row = (raw == F.col(gone_raw)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id))
    out = docs.join(bounded(gone), is_row, "left_anti")
    again = firsts.filter("first.copies > 1").select(F.col("first.id").alias(gone_id), F.col("first.raw").alias(gone_raw))
    if again.isEmpty():
        return out.select(*its)
    # rows that repeat in full key, of which one stays; null texts are nobody's copies
    is_again = is_row & F.col(f"`{text_col}`").isNotNull()
    repeated = out.join(bounded(again), is_again, "left_semi").withColumn(own_raw, raw).dropDuplicates([id_col, own_raw])
    return out.join(bounded(again), is_again, "left_anti").select(*its).unionByName(repeated.select(*its))
