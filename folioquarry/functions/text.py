"""Text, path, address and language scalars: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space, word class and lists that results depend on.
SPACE = r"(?U)[\s\x1c-\x1f]+"
FOLDED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", " ": " "}
EXTERNAL = ("http://", "https://", "//", "data:", "mailto:", "tel:", "#")
PAGE_SUFFIXES = (".html", ".htm", ".xhtml")
FILE_SUFFIXES = (
    ".docx", ".md", ".markdown", ".html", ".htm", ".xhtml", ".tex", ".epub", ".json", ".png", ".jpg", ".jpeg",
    ".gif", ".svg", ".webp", ".tif", ".tiff", ".bmp", ".so", ".emf", ".wmf", ".pdf",
)
MINOR_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "with", "versus", "vs")
FRONT_WORDS = ("frontmatter", "preamble", "preface", "foreword", "titlepage", "about")
BACK_WORDS = ("notes", "index", "references", "bibliography", "glossary", "solutions", "appendix", "backmatter", "colophon")
NO_LANGUAGE = ("zxx", "und", "mul", "mis")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "on", "1"), ("false", "no", "off", "0")
PER_INCH = {"in": 1.0, "cm": 2.54, "mm": 25.4, "pt": 72.0, "pc": 6.0, "px": 96.0}
WORD_FLOOR = 5

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), the value computed once and named once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after_first(items: Column) -> Column:
    """All elements of an array but its first."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def squeeze(x: Text) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE, " "))


def clean(x: Text) -> Column:
    """Spacing, closing punctuation and case aside."""
    return F.lower(F.regexp_replace(squeeze(x), r"[\s.!?;:,]+$", ""))


def normalize_text(x: Text, fold: bool = False) -> Column:
    x = _c(x)
    if fold:
        for fancy, plain in FOLDED.items():
            x = F.replace(x, F.lit(fancy), F.lit(plain))
    return squeeze(x)


def percent_decoded(x: Text) -> Column:
    """Percent-decoding that keeps plus signs, and what cannot be decoded as it is."""
    return F.coalesce(F.try_url_decode(F.replace(_c(x), F.lit("+"), F.lit("%2B"))), _c(x))


def _segment(x: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._/-]+", "-"), r"-+(?=\.)", "")
    return F.coalesce(F.nullif(F.regexp_replace(safe, "^-+|-+$", ""), F.lit("")), F.lit("-"))


def safe_path(x: Text) -> Column:
    """Each segment with runs of unsafe characters as one hyphen."""
    return F.array_join(F.transform(F.split(_c(x), "/"), _segment), "/")


def safe_stem(x: Text) -> Column:
    bare = F.regexp_replace(_c(x), "^/+|/+$", "")
    return F.when(bare == "", "page").otherwise(_segment(F.replace(_c(x), F.lit("/"), F.lit("-"))))


def is_safe(x: Text) -> Column:
    return safe_path(x) == _c(x)


def output_path(x: Text, safe: bool = True, lower: bool = False) -> Column:
    x = safe_path(x) if safe else _c(x)
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else x


def unescaped(x: Text) -> Column:
    """Character references decoded: all named ones of the HTML standard that end in a semicolon, and numeric ones.

    As browsers do it, numbers 128 to 159 mean windows-1252, and 0 and what is no character U+FFFD.
    """
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    old = F.create_map(*[F.lit(y) for n in range(128, 160) for y in (n, bytes([n]).decode("cp1252", "ignore") or chr(n))])

    def numbered(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^#[xX]?0*([0-9A-Fa-f]*)$", 1)
        n = F.when(F.length(digits) <= 8, F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
        n = F.coalesce(n, F.lit(0))
        bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(n)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(old, n.cast("int")), plain)

    def decoded(part: Column) -> Column:
        ref = F.regexp_extract(part, "^&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1)
        value = F.when(ref.startswith("#"), F.concat(let(ref, numbered), F.substr(part, F.length(ref) + 3))).otherwise(F.concat(F.try_element_at(names, ref), F.substr(part, F.length(ref) + 3)))
        return F.when(ref == "", part).otherwise(F.coalesce(value, part))

    return F.when(F.instr(_c(x), "&") > 0, F.array_join(F.transform(F.split(_c(x), "(?=&)"), decoded), "")).otherwise(_c(x))


def clean_title(x: Text) -> Column:
    x = F.regexp_replace(unescaped(x), "[​‌‍﻿­]", "")
    return squeeze(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def slugify(x: Text) -> Column:
    """File-name form of a title."""
    x = F.regexp_replace(F.lower(clean_title(x)), "['’‘`]", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem_title(x: Text) -> Column:
    return F.initcap(F.translate(_c(x), "-_", "  "))


def title_from_slug(x: Text) -> Column:
    words = F.filter(F.split(_c(x), "-"), lambda w: w != "")
    minor = F.array(*[F.lit(w) for w in MINOR_WORDS])
    acronym = lambda w: (F.length(w) <= 3) & w.rlike("[A-Z]") & (F.upper(w) == w)
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(minor, w), w).when(acronym(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")


def chapter_of(x: Text) -> Column:
    number = F.coalesce(F.nullif(F.regexp_extract(_c(x), r"^chapter-(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(_c(x), r"^(\d+)-", 1), F.lit("")))
    return number.try_cast("bigint")


def matter_role(x: Text) -> Column:
    words = F.split(F.lower(_c(x)), "[^a-z0-9]+")
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return F.when(_c(x).startswith("_") | has(FRONT_WORDS), "front").when(has(BACK_WORDS), "back").otherwise("middle")


def letter(n: Text) -> Column:
    """1 is A, 27 is AA: letters of a number without a zero digit."""
    n = _c(n).cast("int")
    step = lambda s: F.struct(((s["n"] - 1) / 26).cast("int").alias("n"), F.concat(F.char(65 + (s["n"] - 1) % 26), s["t"]).alias("t"))
    start = F.struct(n.alias("n"), F.lit("").alias("t"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, lambda s, _: F.when(s["n"] > 0, step(s)).otherwise(s), lambda s: s["t"])


def piece_source(x: Text) -> Column:
    return F.when(F.instr(_c(x), "--") > 0, F.substring_index(_c(x), "--", 1))


def canonical(url: Text) -> Column:
    """An address without fragment, a directory named for its index file, the query kept."""
    bare = F.split_part(_c(url), F.lit("#"), F.lit(1))
    base = F.split_part(bare, F.lit("?"), F.lit(1))
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    return F.concat(F.when(base.endswith("/"), F.concat(base, F.lit("index.html"))).otherwise(base), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def fragment_id(x: Text) -> Column:
    return F.regexp_replace(percent_decoded(x), SPACE, "_")


def address_form(x: Text) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(percent_decoded(F.trim(_c(x))), r"^(?i)(https?|ftp)://|^mailto:", ""), "/+$", ""))


def looks_spelled_out(x: Text) -> Column:
    return _c(x).rlike(r"(?:^|\s)(?:[A-Za-z]\s+){3}[A-Za-z](?:\s|$)")


def looks_like_sentence(x: Text, labels: tuple[str, ...] = ("Figure", "Table", "Example")) -> Column:
    return F.regexp_extract(_c(x), rf"^(?:{'|'.join(labels)})\s+[\d.]*\s*(.*)$", 1).rlike("^[a-z]")


def to_inches(x: Text) -> Column:
    number = F.regexp_extract(F.lower(F.trim(_c(x))), r"^(\d+(?:\.\d+)?|\.\d+)(in|cm|mm|pt|pc|px)?$", 1)
    unit = F.regexp_extract(F.lower(F.trim(_c(x))), r"^(\d+(?:\.\d+)?|\.\d+)(in|cm|mm|pt|pc|px)?$", 2)
    scale = F.lit(PER_INCH["px"])
    for name, value in PER_INCH.items():
        scale = F.when(unit == name, value).otherwise(scale)
    return number.try_cast("double") / scale


def tag(x: Text) -> Column:
    """A language tag in its usual case; null for words, blanks and codes of no language."""
    x = F.trim(_c(x).cast("string"))
    head = F.split_part(x, F.lit("_"), F.lit(1))
    x = F.when(F.instr(x, "_") == 0, x).when(F.instr(head, "-") > 0, head).otherwise(F.replace(x, F.lit("_"), F.lit("-")))
    parts = F.split(x, "-")
    cased = F.aggregate(
        after_first(parts),
        F.struct(F.lower(F.get(parts, F.lit(0))).alias("t"), F.lit(False).alias("tail")),
        lambda s, p: F.struct(
            F.concat(s["t"], F.lit("-"), F.when(s["tail"] | (F.length(p) == 1), F.lower(p)).when(p.rlike("^[A-Za-z]{2}$"), F.upper(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).otherwise(F.lower(p))).alias("t"),
            (s["tail"] | (F.length(p) == 1)).alias("tail"),
        ),
        lambda s: s["t"],
    )
    return F.when(x.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$") & ~F.lower(x).isin(*NO_LANGUAGE), cased)


def language_of(x: Text) -> Column:
    """struct(language with extended subtags, script) of a tag; null for none."""
    t = tag(x)
    extended = F.regexp_extract(t, "^([a-z]{2,3}(?:-[a-z]{3}(?=-|$)){0,3})", 1)
    script = F.nullif(F.regexp_extract(t, "^[a-z]{2,3}(?:-[a-z]{3}(?=-|$)){0,3}-([A-Z][a-z]{3})(?=-|$)", 1), F.lit(""))
    return F.when(t.isNotNull(), F.struct(extended.alias("language"), script.alias("script")))


def same_language(a: Text, b: Text) -> Column:
    one, other = language_of(a), language_of(b)
    return one.isNotNull() & other.isNotNull() & F.coalesce(one["language"] == other["language"], F.lit(False)) & one["script"].eqNullSafe(other["script"])


#: Starts that a spreadsheet takes for a formula.
FORMULA = r"^'*[=+\-@\t\r\n＝＋－＠]"


def guarded(x: Text) -> Column:
    return F.when(_c(x).rlike(FORMULA), F.concat(F.lit("'"), _c(x))).otherwise(_c(x))


def unguarded(x: Text) -> Column:
    return F.when(_c(x).startswith("'") & _c(x).rlike(FORMULA), F.substr(_c(x), F.lit(2))).otherwise(_c(x))


def stem_of(x: Text) -> Column:
    """A file reference's bare stem, its anchor kept."""
    path = F.split_part(_c(x), F.lit("#"), F.lit(1))
    anchor = F.when(F.instr(_c(x), "#") > 0, F.regexp_extract(_c(x), "(?s)(#.*)$", 1)).otherwise("")
    base = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    return F.concat(F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", ""), anchor)


def looks_like_path(x: Text) -> Column:
    path = F.split_part(_c(x), F.lit("#"), F.lit(1))
    ends = F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in FILE_SUFFIXES) + ")$")
    return F.coalesce((_c(x) != "") & (F.instr(F.trim(_c(x)), " ") == 0) & ((F.instr(path, "/") > 0) | ends), F.lit(False))


def _is_external(href: Column, prefixes: tuple[str, ...] = EXTERNAL) -> Column:
    low, out = F.lower(href), F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def classify_link(href: Text) -> Column:
    """fragment, external, page or asset; null for a blank address."""
    h = F.trim(_c(href))
    path = F.split_part(F.split_part(h, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    suffix = F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=[^.])(\.[^.]*)$", 1))
    kind = F.when(h.startswith("#"), "fragment").when(_is_external(h), "external").when(path == "", "fragment").when((suffix == "") | suffix.isin(*PAGE_SUFFIXES), "page").otherwise("asset")
    return F.when(h != "", kind)


def within_tolerance(old: Text, new: Text, percent: float = 2.0) -> Column:
    gap = F.abs(_c(old) - _c(new))
    return F.coalesce((gap <= WORD_FLOOR) | (gap * 100.0 <= percent * F.greatest(F.abs(_c(old)), F.abs(_c(new)))), F.lit(False))


def natural_key(x: Text) -> Column:
    """Sorts like the text with runs of digits by value: each run is padded behind its length."""
    runs = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))).otherwise(p)), "\u0001")


def parse_number(x: Text) -> Column:
    t = F.translate(F.trim(_c(x)), "−", "-")
    return F.regexp_replace(t, r"[^\d.-]", "").try_cast("double")


def is_amount(x: Text) -> Column:
    return F.coalesce(F.trim(_c(x)).rlike(r"^[(+\-−]?\s*[$€£]?\s*[+\-−]?\d[\d,]*(\.\d+)?\s*%?\)?$"), F.lit(False))


def name_problem(x: Text) -> Column:
    """Why a folder name will not do; null if it will."""
    x = _c(x)
    return (
        F.when(x.isNull() | (x == ""), "is empty").when(x.isin(".", ".."), "is reserved").when(~x.rlike(r"^[A-Za-z0-9._-]+$"), "has characters that are not safe")
        .when(x.endswith("."), "ends with a dot").when(F.upper(F.split_part(x, F.lit("."), F.lit(1))).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "names a device")
    )


def boolean_word(x: Text) -> Column:
    low = F.lower(F.trim(_c(x)))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def media_type(content: Text) -> Column:
    """Media type by leading bytes of a binary column."""
    head = F.hex(F.substring(_c(content), 1, 12))
    found = F.lit(None).cast("string")
    for magic, name in (("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("52494646", "image/webp"), ("474946383", "image/gif"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png")):
        found = F.when(head.startswith(magic), name).otherwise(found)
    return found


def file_digest(content: Text, fallback: Text) -> Column:
    return F.coalesce(F.sha2(_c(content), 256), _c(fallback))


def percent_encoded(x: Text, safe: str) -> Column:
    """Bytes of UTF-8 as %XX, but for ASCII letters, digits, -._~ and the characters of ``safe``."""
    kept = "".join(dict.fromkeys("-._~" + safe))
    quoted = "".join("\\" + c for c in kept)
    each = F.split(_c(x), "(?<=(?s:.))(?=(?s:.))")
    byte_pairs = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.when(_c(x).rlike(f"[^A-Za-z0-9{quoted}]"), F.array_join(F.transform(each, lambda c: F.when(c.rlike(f"^[A-Za-z0-9{quoted}]*$"), c).otherwise(byte_pairs(c))), "")).otherwise(_c(x))


def fragment_href(x: Text) -> Column:
    """An id as a link names it: what an address cannot hold is encoded."""
    return percent_encoded(fragment_id(x), "!$&'()*+,;=:@/?")


def resource_address(url: Text) -> Column:
    """An address without its fragment, its path encoded as a browser sends it."""
    bare = F.split_part(_c(url), F.lit("#"), F.lit(1))
    base = F.split_part(bare, F.lit("?"), F.lit(1))
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*", "")).otherwise("")
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", 0)
    path = percent_encoded(percent_decoded(F.substr(base, F.length(host) + 1)), "/:@!$&'()*+,;=")
    return F.concat(host, path, F.when(query == "?", "").otherwise(query))


def image_uri(x: Text) -> Column:
    """An image's path as the reader writes it: white space and <>|"{}[]^` encoded, the rest as it is."""
    each = F.split(_c(x), "(?<=(?s:.))(?=(?s:.))")
    odd = r"^[ \t-\r\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000<>|\"{}\[\]^`]$"
    return F.array_join(F.transform(each, lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")


#: Names that Windows keeps for devices.
DEVICES = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"


def filename_problem(x: Text) -> Column:
    """Why a text is no name of one file inside a folder; null if it is."""
    x = _c(x)
    return F.when(x.isNull() | ~x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") | (F.instr(x, "..") > 0), "is no file's name").when(F.split_part(x, F.lit("."), F.lit(1)).rlike(f"(?i)^({DEVICES})$"), "names a device")


def coerced(x: Text, kind: str, low: float | None = None, high: float | None = None, allowed: tuple[str, ...] = ()) -> Column:
    """struct(value, problem) of a setting's text read as bool, int, float, enum, date, language or string; a blank is null."""
    text = F.trim(_c(x))
    given = F.nullif(text, F.lit(""))
    if kind == "bool":
        value, problem = boolean_word(text).cast("string"), "is not true or false"
    elif kind in ("int", "float"):
        number = given.try_cast("double")
        fits = ~F.isnan(number) & (F.abs(number) != float("inf"))
        fits = fits & (number >= low) if low is not None else fits
        fits = fits & (number <= high) if high is not None else fits
        form = given.rlike(r"^[+-]?[0-9]+$") if kind == "int" else given.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        value, problem = F.when(form & fits, (number.cast("bigint") if kind == "int" else number).cast("string")), "is not a number in range"
    elif kind == "enum":
        names = F.array(*[F.lit(a) for a in allowed])
        value, problem = F.get(F.filter(names, lambda a: F.lower(a) == F.lower(text)), F.lit(0)), "is not one of the choices"
    elif kind == "date":
        value, problem = F.when(given.rlike(r"^\d{4}-\d{2}-\d{2}$") & given.try_cast("date").isNotNull(), given), "is not a date"
    elif kind == "language":
        value, problem = tag(given), "is not a language tag"
    else:
        value, problem = given, "is not text"
    return F.struct(value.alias("value"), F.when(given.isNotNull() & value.isNull(), F.lit(problem)).alias("problem"))
