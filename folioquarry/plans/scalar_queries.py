"""Queries for the scalars of names, paths, addresses, languages, numbers and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import text as t
from folioquarry.operators import alttext
from folioquarry.plans.queries import query, table


@query("""WITH a AS (SELECT p_partkey, p_name AS alt, CASE WHEN p_partkey % 2 = 0 THEN 'img/' || replace(upper(p_name), ' ', '%20') || '.png?v=1' ELSE 'img/' || p_type || '.png#x' END AS src FROM part),
n AS (SELECT *, regexp_extract(url_decode(split_part(split_part(src, '?', 1), '#', 1)), '([^/]*)$', 1) AS leaf, lower(regexp_replace(alt, '[^A-Za-z0-9]', '', 'g')) AS squashed FROM a)
SELECT p_partkey, squashed <> '' AND squashed IN (lower(regexp_replace(leaf, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(regexp_replace(leaf, '\\.[^.]*$', ''), '[^A-Za-z0-9]', '', 'g'))) AS named FROM n""")
def alt_is_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.concat(F.lit("img/"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("%20")), F.lit(".png?v=1"))
    src = F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.concat(F.lit("img/"), F.col("p_type"), F.lit(".png#x")))
    return table(spark, sf_dir, "part").select("p_partkey", alttext.is_file_name(F.col("p_name"), src).alias("named"))


@query("""WITH s AS (SELECT page_id, url, array_to_string(list_transform(string_split(url, '/'), lambda x: coalesce(nullif(trim(regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '-', 'g'), '-+\\.', '.', 'g'), '-'), ''), '-')), '/') AS safe FROM pages)
SELECT page_id, safe, safe = url AS is_safe, lower(safe) AS output FROM s""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.safe_path("url").alias("safe"), t.is_safe("url").alias("is_safe"), t.output_path("url", lower=True).alias("output"))


@query("""WITH u AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '/' WHEN page_id % 3 = 1 THEN '/Page.One.HTML#a.b' ELSE '#top' END AS url FROM pages),
p AS (SELECT *, split_part(url, '#', 1) AS path, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#')) ELSE '' END AS anchor FROM u)
SELECT page_id, lower(regexp_replace(regexp_replace(url, '^(https?|ftp)://|^mailto:', '', 'i'), '/+$', '')) AS form,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\\.[^.]*$', '\\1') || anchor AS stem, url <> '' AND NOT contains(trim(url), ' ') AND contains(path, '/') AS is_path FROM p""")
def address_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    url = F.concat("url", F.when(k == 0, "/").when(k == 1, "/Page.One.HTML#a.b").otherwise("#top"))
    return table(spark, sf_dir, "pages").select("page_id", t.address_form(url).alias("form"), t.stem_of(url).alias("stem"), t.looks_like_path(url).alias("is_path"))


@query("""WITH w AS (SELECT p_partkey, lower(p_type) || '-of-' || CASE WHEN p_partkey % 4 = 0 THEN 'NASA' ELSE 'the' END || '-' || replace(p_name, ' ', '-') AS slug FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(slug, '-'), lambda x, i: CASE WHEN i > 1 AND x IN ('of', 'the') THEN x WHEN x = 'NASA' THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), ' ') AS title,
array_to_string(list_transform(string_split(slug, '-'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') AS stem_title FROM w""")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.when(F.col("p_partkey") % 4 == 0, "NASA").otherwise("the")
    slug = F.concat(F.lower("p_type"), F.lit("-of-"), middle, F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", t.title_from_slug(slug).alias("title"), t.stem_title(slug).alias("stem_title"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chapter-' || p_size WHEN 1 THEN p_size || '-' || replace(p_name, ' ', '-') WHEN 2 THEN 'appendix-' || p_size ELSE p_size || '--part' END AS stem FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 2 THEN CAST(regexp_extract(stem, '(\\d+)', 1) AS BIGINT) END AS chapter, CASE WHEN contains(stem, '--') THEN split_part(stem, '--', 1) END AS source,
CASE WHEN starts_with(stem, 'appendix') THEN 'back' ELSE 'middle' END AS role FROM s""")
def chapter_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, name = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.replace("p_name", F.lit(" "), F.lit("-"))
    stem = F.when(k == 0, F.concat(F.lit("chapter-"), size)).when(k == 1, F.concat(size, F.lit("-"), name)).when(k == 2, F.concat(F.lit("appendix-"), size)).otherwise(F.concat(size, F.lit("--part")))
    return table(spark, sf_dir, "part").select("p_partkey", t.chapter_of(stem).alias("chapter"), t.piece_source(stem).alias("source"), t.matter_role(stem).alias("role"))


@query("""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '‘', ''''), '’', ''''), '“', '"'), '”', '"'), '–', '-'), '—', '--'), '…', '...'), '\\s+', ' ', 'g'))) AS normal FROM documents""")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normalize_text("text", fold=True)).alias("normal"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || '+1%zz' AS id, replace(p_name, ' ', '_') || '%C3%A9' AS href FROM part""")
def fragment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("%20%20")), F.lit("%2B1%25zz"))
    return table(spark, sf_dir, "part").select("p_partkey", t.fragment_id(raw).alias("id"), t.fragment_href(F.concat("p_name", F.lit("é"))).alias("href"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN trim(regexp_replace(c_mktsegment, '(.)', '\\1 ', 'g')) ELSE c_mktsegment || ' a b c' END AS said, CASE WHEN c_custkey % 2 = 0 THEN 'Table ' || c_custkey || '. ' || c_mktsegment ELSE 'Table ' || c_custkey || ' shows ' || c_mktsegment END AS line FROM customer)
SELECT c_custkey, c_custkey % 3 = 0 AS spelled, c_custkey % 2 = 1 AS sentence FROM s""")
def spelled_and_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.trim(F.regexp_replace("c_mktsegment", "(.)", "$1 "))).otherwise(F.concat("c_mktsegment", F.lit(" a b c")))
    line = F.concat(F.lit("Table "), k, F.when(k % 2 == 0, F.lit(". ")).otherwise(F.lit(" shows ")), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.looks_spelled_out(said).alias("spelled"), t.looks_like_sentence(line).alias("sentence"))


@query("""WITH w AS (SELECT c_custkey, CAST(c_custkey % 40 AS VARCHAR) || '.5' AS n, c_custkey % 8 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) / 2.54 WHEN 2 THEN CAST(n AS DOUBLE) / 25.4 WHEN 3 THEN CAST(n AS DOUBLE) / 72 WHEN 4 THEN CAST(n AS DOUBLE) / 6 WHEN 5 THEN CAST(n AS DOUBLE) / 96 WHEN 6 THEN CAST(n AS DOUBLE) / 96 END AS inches FROM w""")
def widths_in_inches(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("in", "CM", "mm", "pt", "pc", "px", "", "em")])
    width = F.concat((F.col("c_custkey") % 40).cast("string"), F.lit(".5"), F.get(units, (F.col("c_custkey") % 8).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", t.to_inches(width).alias("inches"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(lang) || '_us' WHEN 1 THEN lang || '-hant-tw' WHEN 2 THEN ' ' || lang || ' ' WHEN 3 THEN 'und' WHEN 4 THEN 'a language' ELSE lang || '-x-AB' END AS raw, lang FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '-US' WHEN 1 THEN lang || '-Hant-TW' WHEN 2 THEN lang WHEN 5 THEN lang || '-x-ab' END AS tag, CASE WHEN doc_id % 6 NOT IN (3, 4) THEN lang END AS language,
CASE WHEN doc_id % 6 = 1 THEN 'Hant' END AS script, coalesce(doc_id % 6 IN (0, 2, 5), false) AS same FROM r""")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lang = F.col("doc_id") % 6, F.col("lang")
    raw = (
        F.when(k == 0, F.concat(F.upper(lang), F.lit("_us"))).when(k == 1, F.concat(lang, F.lit("-hant-tw"))).when(k == 2, F.concat(F.lit(" "), lang, F.lit(" "))).when(k == 3, "und").when(k == 4, "a language").otherwise(F.concat(lang, F.lit("-x-AB")))
    )
    both = t.language_of(raw)
    return table(spark, sf_dir, "documents").select("doc_id", t.tag(raw).alias("tag"), both["language"].alias("language"), both["script"].alias("script"), t.same_language(raw, lang).alias("same"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'is empty' WHEN 1 THEN 'is reserved' WHEN 2 THEN 'has characters that are not safe' WHEN 3 THEN 'ends with a dot' WHEN 4 THEN 'names a device' END AS problem FROM customer""")
def folder_name_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "").when(k == 1, "..").when(k == 2, F.col("c_name")).when(k == 3, F.concat("c_mktsegment", F.lit("."))).when(k == 4, "aux.txt").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.name_problem(name).alias("problem"))


@query("""WITH n AS (SELECT p_partkey, p_partkey + 1 AS n FROM part) SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT))
WHEN n <= 18278 THEN chr(CAST(64 + (n - 27) // 676 AS INT)) || chr(CAST(65 + (n - 27) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT))
ELSE chr(CAST(64 + (n - 703) // 17576 AS INT)) || chr(CAST(65 + (n - 703) // 676 % 26 AS INT)) || chr(CAST(65 + (n - 27) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) END AS letter FROM n""")
def appendix_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.letter(F.col("p_partkey") + 1).alias("letter"))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '$' || CAST(c_acctbal AS VARCHAR) WHEN 1 THEN '−' || CAST(abs(c_acctbal) AS VARCHAR) || ' %' WHEN 2 THEN c_mktsegment WHEN 3 THEN ' 1,' || (100 + c_custkey % 900) || '.5 ' ELSE c_custkey || ' kg' END AS said FROM customer)
SELECT c_custkey, TRY_CAST(regexp_replace(replace(said, '−', '-'), '[^0-9.-]', '', 'g') AS DOUBLE) AS number, c_custkey % 5 IN (0, 1, 3) AS amount FROM v""")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key, balance = F.col("c_custkey") % 5, F.col("c_custkey"), F.col("c_acctbal").cast("decimal(18,2)").cast("double").cast("string")
    size = F.abs("c_acctbal").cast("string")
    said = F.when(k == 0, F.concat(F.lit("$"), balance)).when(k == 1, F.concat(F.lit("−"), size, F.lit(" %"))).when(k == 2, F.col("c_mktsegment"))
    said = said.when(k == 3, F.concat(F.lit(" 1,"), (100 + key % 900).cast("string"), F.lit(".5 "))).otherwise(F.concat(key.cast("string"), F.lit(" kg")))
    return table(spark, sf_dir, "customer").select("c_custkey", t.parse_number(said).alias("number"), t.is_amount(said).alias("amount"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/zip' WHEN 3 THEN 'application/pdf' END AS kind, sha256(CASE event_id % 5 WHEN 4 THEN 'none' ELSE props END) AS digest FROM events""")
def sniffed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    head = F.unhex(F.when(k == 0, "89504E470D0A1A0A").when(k == 1, "FFD8FFE0").when(k == 2, "504B0304").when(k == 3, "255044462D").otherwise("00"))
    body = F.when(k != 4, F.col("props").cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", t.media_type(F.concat(head, F.col("props").cast("binary"))).alias("kind"), t.file_digest(body, F.sha2(F.lit("none"), 256)).alias("digest"))


@query("""SELECT p_partkey, 'http://a.org/' || replace(p_name, ' ', '%20') || '/x%20y/%C3%A9.html?q=1' AS address, replace(p_name, ' ', '%20') || '/%5Ba%5D.png' AS image FROM part""")
def resource_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("http://a.org/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("/x y/é.html?q=1#f"))
    return table(spark, sf_dir, "part").select("p_partkey", t.resource_address(url).alias("address"), t.image_uri(F.concat("p_name", F.lit("/[a].png"))).alias("image"))


@query("""SELECT doc_id, md5('“' || coalesce(regexp_replace(text, '[‘’]', '', 'g'), '') || '” & <' || doc_id || '>') AS plain, 'a-' || doc_id || '-b' AS slug FROM documents""")
def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("&#8220;"), F.coalesce(F.regexp_replace("text", "[‘’]", ""), F.lit("")), F.lit("&#x201D; &amp; &lt;"), F.col("doc_id").cast("string"), F.lit("&gt;"))
    title = F.concat(F.lit("A&nbsp;"), F.col("doc_id").cast("string"), F.lit("&#32;&#8217;&zwnj;&#38; B"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.unescaped(made)).alias("plain"), t.slugify(title).alias("slug"))
