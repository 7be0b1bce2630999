"""Links and sites: resolution, redirects, crawl profiles, menus, localised references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.text import canonical, percent_decoded
from folioquarry.operators.page_rules import is_external
from folioquarry.operators.sequences import ranked


def normal_path(path: Column) -> Column:
    """A posix path without ., .. and doubled slashes."""
    rooted = F.when(path.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.coalesce(F.element_at(s, -1), F.lit("")) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when((p == "..") & (rooted == "/"), s).otherwise(F.concat(s, F.array(p))))
    out = F.concat(rooted, F.array_join(kept, "/"))
    return F.when(out == "", ".").otherwise(out)


def internal_links(facts: DataFrame) -> DataFrame:
    """name, href, target page name and fragment of each link that is not external; routes of presentations become ids."""
    rows = facts.select("name", "presentation", F.posexplode("links").alias("pos", "href")).filter((F.col("href") != "") & (~is_external(F.col("href")) | F.col("href").startswith("#")))
    target = F.split_part("href", F.lit("#"), F.lit(1))
    fragment = F.when(F.instr("href", "#") > 0, F.regexp_extract("href", "(?s)#(.*)$", 1)).otherwise("")
    step = F.regexp_extract(fragment, "^/([^/]*)", 1)
    routed = F.when(F.col("presentation") & fragment.startswith("/") & (target == ""), F.when(fragment.rlike(r"^/[\d/]*$"), "").otherwise(step)).otherwise(fragment)
    folder = F.regexp_extract("name", "^(.*)/[^/]*$", 1)
    joined = F.when(percent_decoded(target).startswith("/"), percent_decoded(target)).when(folder == "", percent_decoded(target)).otherwise(F.concat(folder, F.lit("/"), percent_decoded(target)))
    return rows.select("name", "pos", "href", F.when(target == "", F.col("name")).otherwise(normal_path(joined)).alias("target"), routed.alias("fragment"))


def check_links(facts: DataFrame, files: DataFrame | None = None, strip_query: bool = False) -> DataFrame:
    """Links to pages that are not there, and to ids that their page lacks; files: names that are no pages but exist."""
    links = internal_links(facts)
    if strip_query:
        links = links.withColumn("target", F.split_part("target", F.lit("?"), F.lit(1)))
    pages = facts.select(F.col("name").alias("target")).distinct()
    known = pages.withColumn("page", F.lit(True)) if files is None else pages.withColumn("page", F.lit(True)).unionByName(files.select(F.col("name").alias("target")).distinct().join(pages, "target", "left_anti").withColumn("page", F.lit(False)))
    at = links.join(known, "target", "left")
    missing = at.filter("page is null").select(F.col("name").alias("where"), F.lit("link-to-missing-file").alias("check"), F.col("href").alias("detail"))
    ids = facts.select(F.col("name").alias("target"), F.explode("ids").alias("id")).distinct()
    asked = at.filter("page and fragment != ''").withColumn("ways", F.array_distinct(F.array("fragment", percent_decoded("fragment"))))
    one = asked.select("*", F.explode("ways").alias("id")).join(ids, ["target", "id"], "left_semi").select("name", "pos")
    lost = asked.join(one, ["name", "pos"], "left_anti").select(F.col("name").alias("where"), F.lit("link-to-missing-fragment").alias("check"), F.col("href").alias("detail"))
    return missing.unionByName(lost)


def _held(rows: DataFrame) -> DataFrame:
    """Rows of a round, computed once: checkpointed where there is a folder for it."""
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.persist()


def follow(redirects: DataFrame) -> DataFrame:
    """url and the end of its redirects; in a cycle the walk stops when it comes to an address that it has left before.

    Every address jumps to where its target has come, twice as far each round, so a chain of n ends after log2(n)
    rounds; what is still on its way then is in a cycle or leads into one, and is walked step by step.
    """
    now = redirects.select("url", F.col("target").alias("end"))
    for _ in range(max(1, math.ceil(math.log2(redirects.count() + 1)))):
        ahead = now.select(F.col("url").alias("__from"), F.col("end").alias("__to"))
        nxt = _held(now.join(ahead, now["end"] == ahead["__from"], "left").select("url", F.coalesce("__to", "end").alias("end"), F.col("__to").isNotNull().alias("go")))
        if nxt.filter("go").isEmpty():
            return nxt.select("url", "end")
        now.unpersist()
        now = nxt.select("url", "end")
    cyclic = _held(now.join(redirects.select(F.col("url").alias("end")), "end", "left_semi").select("url"))
    if cyclic.isEmpty():
        return now
    return now.join(cyclic, "url", "left_anti").unionByName(_walk(redirects, redirects.join(cyclic, "url", "left_semi")))


def _walk(redirects: DataFrame, starts: DataFrame) -> DataFrame:
    """url and end of the starting rows, one step a round."""
    now = starts.select("url", F.col("target").alias("end"), F.array("url").alias("seen"))
    step = redirects.select(F.col("url").alias("from"), F.col("target").alias("to"))
    while True:  # ends, as no walk leaves an address twice
        nxt = now.join(step, now["end"] == step["from"], "left")
        go = F.col("to").isNotNull() & ~F.array_contains("seen", F.col("end"))
        moved = _held(nxt.select("url", F.when(go, F.col("to")).otherwise(F.col("end")).alias("end"), F.when(go, F.concat("seen", F.array("end"))).otherwise(F.col("seen")).alias("seen"), go.alias("go")))
        if moved.filter("go").isEmpty():
            return moved.select("url", "end")
        now.unpersist()
        now = moved.select("url", "end", "seen")


def page_key(refs: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Each reference with the page it names: its canonical address, else that without its query."""
    known = pages.select(F.col("url").alias("page")).distinct()
    rows = refs.withColumn("__full", canonical(url_col)).withColumn("__bare", F.split_part("__full", F.lit("?"), F.lit(1)))
    out = rows.join(known.withColumnRenamed("page", "__p"), F.col("__full") == F.col("__p"), "left").join(known.withColumnRenamed("page", "__q"), F.col("__bare") == F.col("__q"), "left")
    return out.withColumn("page", F.coalesce("__p", "__q")).drop("__full", "__bare", "__p", "__q")


def localize(refs: DataFrame, pages: DataFrame, resources: DataFrame, redirects: DataFrame, keep_hosts: tuple[str, ...] = ()) -> DataFrame:
    """refs(page, value, is_link) with local (a page or resource) or missing (why there is none)."""
    ends = follow(redirects)
    asked = refs.join(ends, refs["value"] == ends["url"], "left").withColumn("at", F.coalesce("end", "value")).drop("url", "end")
    found = page_key(asked, pages.withColumn("url", canonical("url")), "at").withColumnRenamed("page", "__page") if "page" not in refs.columns else page_key(asked.withColumnRenamed("page", "from"), pages.withColumn("url", canonical("url")), "at").withColumnRenamed("page", "__page").withColumnRenamed("from", "page")
    found = found.join(resources.select(F.col("url").alias("__r"), F.col("key").alias("__key")), F.col("at") == F.col("__r"), "left")
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#]*)", 1)
    why = F.when(F.col("__page").isNull() & F.col("__key").isNull(), F.when(F.col("is_link") & (host("at") == host("page")), "page-not-saved").when(~F.col("is_link") & ~host("at").isin(*(keep_hosts or ("",))), "resource-not-held"))
    return found.select("page", "value", F.coalesce("__page", "__key").alias("local"), why.alias("missing"))


def detect_profile(pages: DataFrame, profiles: list[tuple[str, list[str]]], html_col: str = "html") -> DataFrame:
    """The first profile all of whose patterns more than half of the pages match: one pass over the pages."""
    hits = []
    for name, patterns in profiles:
        every = F.lit(True)
        for p in patterns:
            every = every & F.coalesce(F.col(html_col).rlike(p), F.lit(False))
        hits.append(F.sum(every.cast("long")).alias(name))
    counted = pages.agg(F.count("*").alias("__n"), *hits)
    first = F.coalesce(*[F.when(F.col(name) * 2 > F.col("__n"), F.lit(name)) for name, _ in profiles])
    return counted.select(first.alias("profile"), F.col("__n").alias("n_pages"))


def split_titles(pages: DataFrame, title_col: str, separators: tuple[str, ...] = (" | ", " - ", " – ", " — ")) -> DataFrame:
    """separator and tail that titles share: exactly one distinct tail, on four fifths of them at least."""
    parts = []
    for i, sep in enumerate(separators):
        tail = F.when(F.instr(title_col, sep) > 0, F.substring_index(title_col, sep, -1))
        parts.append(pages.agg(F.lit(i).alias("rank"), F.lit(sep).alias("separator"), F.min(tail).alias("tail"), F.max(tail).alias("last"), F.count(tail).alias("n"), F.count("*").alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("tail = last and n >= 0.8 * total").orderBy("rank").limit(1).select("separator", "tail", "n", "total")


def menu_rank(links: DataFrame) -> DataFrame:
    """links(container, seq, target, size): reach, distinct and runs of each container, and its rank; those that reach too little have none."""
    w = Window.partitionBy("container").orderBy("seq")
    runs = links.withColumn("new", (~F.col("target").eqNullSafe(F.lag("target").over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    per = runs.groupBy("container").agg(F.countDistinct("target").alias("reach"), F.sum("new").alias("runs"), F.max("size").alias("size"), F.min("seq").alias("first"))
    fit = (F.col("reach") >= 3) & (F.col("runs") <= 1.25 * F.col("reach") + 1)
    order = ranked(per.filter(fit), [F.desc("reach"), "size", "first", "container"])
    return per.join(order.select("container", "rank"), "container", "left")


def resolve_redirect_map(records: DataFrame) -> dict[str, DataFrame]:
    """Crawl records(seq, type, url, status, content_type, location, refers_to, body) as pages, resources, redirects and aliases."""
    ok = records.filter("type = 'response' and status = 200")
    html = ok.filter(F.col("content_type").startswith("text/html"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    seed = html.agg(F.min_by(host, "seq").alias("seed"))
    mine = html.crossJoin(F.broadcast(seed)).withColumn("page", host == F.col("seed")).drop("seed")  # the other side is one row
    pages = mine.filter("page").groupBy(canonical("url").alias("url")).agg(F.min_by("body", "seq").alias("body"), F.min("seq").alias("seq"))
    rest = ok.filter(~F.col("content_type").startswith("text/html")).unionByName(mine.filter("not page").drop("page"))
    return {
        "pages": pages,
        "resources": rest.groupBy("url").agg(F.sha1(F.min_by("body", "seq")).alias("key")),
        "redirects": records.filter("type = 'response' and status between 300 and 399 and location is not null").groupBy("url").agg(F.min_by("location", "seq").alias("target")),
        "aliases": records.filter("type = 'revisit'").select("url", F.col("refers_to").alias("target")).distinct(),
    }
