"""Readers of packaged sources: crawl archives, MIME pages, EPUB, cartridges and decks, from ``binaryFile`` rows."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from posixpath import dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RECORD = "path string, seq long, type string, url string, status int, content_type string, location string, refers_to string, body binary"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and content of files at any depth; lock files of word processors are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.filter(~F.regexp_extract("path", "([^/]*)$", 1).startswith("~$"))


def kind_of(content: bytes) -> str | None:
    """What a file is by its bytes: warc, epub, cartridge, deck, word, zip, mhtml, html, or None."""
    if content[:5] == b"WARC/":
        return "warc"
    if content[:2] == b"\x1f\x8b":
        try:
            return "warc" if zlib.decompressobj(31).decompress(content[:4096], 5) == b"WARC/" else None
        except zlib.error:
            return None
    if content[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = set(z.namelist())
        except zipfile.BadZipFile:
            return None
        if any(re.match(r"archive/.*\.warc", n) for n in names):
            return "warc"
        parts = {"META-INF/container.xml": "epub", "imsmanifest.xml": "cartridge", "ppt/presentation.xml": "deck", "word/document.xml": "word"}
        return next((kind for n, kind in parts.items() if n in names), "zip")
    head = content[:4096].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if re.search(rb"(?m)^mime-version:", head) and b"multipart/" in head:
        return "mhtml"
    return "html" if head.startswith((b"<!doctype html", b"<html", b"<!--", b"<head", b"<body")) else None


def with_kind(rows: DataFrame) -> DataFrame:
    """kind of every file, told from its content."""

    @F.pandas_udf("string")
    def kind(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else kind_of(bytes(v)))

    return rows.withColumn("kind", kind("content"))


def is_warc() -> F.Column:
    """Whether content is a crawl archive: plain, gzip, or a zip that holds one."""

    @F.pandas_udf("boolean")
    def told(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and kind_of(bytes(v)) == "warc")

    return told("content")


def load_site(rows: DataFrame) -> DataFrame:
    """url and html of the pages of any crawl archives, MIME pages and saved pages among the files; a url's first source by path stays."""
    known = with_kind(rows)
    crawl = read_warc(known.filter("kind = 'warc'")).filter("type = 'response' and status = 200 and content_type like 'text/html%'").select("path", "seq", "url", F.decode("body", "UTF-8").alias("html"))
    mime = read_mhtml(known.filter("kind = 'mhtml'")).filter("mime = 'text/html' and url is not null").select("path", F.col("part").cast("long").alias("seq"), "url", F.decode("body", "UTF-8").alias("html"))
    saved = saved_pages(known.filter("kind = 'html'")).select("path", F.lit(0).cast("long").alias("seq"), "url", "html")
    every = crawl.unionByName(mime).unionByName(saved)
    return every.groupBy("url").agg(F.min_by("html", F.struct("path", "seq")).alias("html"), F.min("path").alias("path"), (F.count("*") - 1).alias("n_more"))


#: Rows, and bytes of their texts and bodies, after which a reader hands on what it has; a file's rows stay together.
OUT_ROWS, OUT_BYTES = 10_000, 4 << 20


def _held(v: object) -> int:
    """Bytes of texts and bodies in a value, near enough for a bound."""
    kind = type(v)
    return len(v) if kind is str or kind is bytes else sum(map(_held, v.values() if kind is dict else v)) if kind in (tuple, list, dict) else 8


def mapped(rows: DataFrame, one: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``one(path, content)`` returns for each file, those of many small files in one batch."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                more = one(path.as_py(), content.as_py())
                found += more
                held += _held(more)
                if len(found) >= OUT_ROWS or held >= OUT_BYTES:
                    yield batch_of(found)
                    found, held = [], 0
        if found:
            yield batch_of(found)

    return rows.select(F.col("path").cast("string"), "content").mapInArrow(run, schema)


def members(data: bytes) -> list[bytes]:
    """The plain bytes of an archive: of each gzip member, or of each archive in a zip."""
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [m for n in sorted(z.namelist()) if re.match(r"archive/.*\.warc", n) for m in members(z.read(n))]
    if data[:2] != b"\x1f\x8b":
        return [data]
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return [b"".join(out)]


def http_response(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and decoded body of a stored message."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if heads.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            parts.append(body[end + 2 : end + 2 + size])
            at = end + size + 4
        body = b"".join(parts) or body
    for coding in reversed([c.strip() for c in heads.get("content-encoding", "").lower().split(",")]):
        if coding in ("gzip", "x-gzip"):
            body = zlib.decompressobj(31).decompress(body) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":  # with a header as the standard has it, or without one as some servers send it
            body = zlib.decompressobj(15 if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2], "big") % 31 == 0 else -15).decompress(body)
        elif coding not in ("", "identity"):
            raise ValueError(f"a body in {coding!r} cannot be read")
    status = re.match(r"HTTP/\S+\s+(\d{3})", first)
    return int(status[1]) if status else 0, heads, body


def warc_rows(path: str, content: bytes) -> list[tuple]:
    """A row for each response or revisit record."""
    out = []
    for data in members(content):
        at = 0
        while (start := data.find(b"WARC/1.", at)) >= 0:
            stop = data.find(b"\r\n\r\n", start)
            if stop < 0:
                break
            heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[start:stop].decode("utf-8", "replace").split("\r\n")[1:])}
            size = int(heads.get("content-length", 0))
            block, at = data[stop + 4 : stop + 4 + size], stop + 4 + size
            kind = heads.get("warc-type")
            if kind in ("response", "revisit"):
                status, http, body = http_response(block)
                out.append((path, len(out), kind, heads.get("warc-target-uri", "").strip("<>"), status, http.get("content-type"), http.get("location"), heads.get("warc-refers-to-target-uri"), body if kind == "response" else None))
    return out


def read_warc(rows: DataFrame) -> DataFrame:
    return mapped(rows, warc_rows, RECORD)


def mhtml_rows(path: str, content: bytes) -> list[tuple]:
    from email import message_from_bytes

    return [(path, i, p.get("Content-Location"), p.get_content_type(), p.get_payload(decode=True)) for i, p in enumerate(x for x in message_from_bytes(content).walk() if not x.is_multipart())]


def read_mhtml(rows: DataFrame) -> DataFrame:
    """path, part number, url, media type and bytes of each MIME part."""
    return mapped(rows, mhtml_rows, "path string, part int, url string, mime string, body binary")


def saved_pages(rows: DataFrame) -> DataFrame:
    """url and html of pages a browser saved: by the comment it leaves, else the canonical link, else the file's name; the first path of a url stays."""
    text = rows.select("path", F.decode("content", "UTF-8").alias("html"))
    some = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    url = F.coalesce(some(r"saved from url=\(\d+\)(\S+)"), some(r"(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*href=[\"']([^\"']+)"), F.regexp_extract("path", "([^/]*)$", 1))
    return text.withColumn("url", url).groupBy("url").agg(F.min_by("html", "path").alias("html"), F.min("path").alias("path"), (F.count("*") - 1).alias("n_more"))


#: A zip archive's end, an entry of its directory, and what precedes a member's data.
_END, _ENTRY, _LOCAL = struct.Struct("<4s8xLLH"), struct.Struct("<4s2xHHH4xLLLHHH8xL"), struct.Struct("<4s2xH18xHH")


def _usual(extra: bytes) -> bool:
    """Whether a member's further fields are whole and neither its sizes beyond 4 GB nor another name."""
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        if kind in (0x0001, 0x7075) or size + 4 > len(extra):
            return False
        extra = extra[size + 4 :]
    return True


class Members:
    """The members of a zip archive as zipfile reads them, without its objects for each; whatever is rare or damaged is left to zipfile."""

    def __init__(self, content: bytes) -> None:
        self.content, self.slow = content, None
        try:
            self.held = self._directory()
        except (struct.error, UnicodeDecodeError):
            self.held = None
        if self.held is None:
            self.slow = zipfile.ZipFile(io.BytesIO(content))

    def _directory(self) -> dict[str, tuple] | None:
        """Each member's name as written, flags, method, check, sizes and place; None if zipfile has to read the archive."""
        content, stop = self.content, len(self.content) - 22
        if stop < 0 or content[stop - 20 : stop - 16] == b"PK\x06\x07":
            return None
        mark, size, at, comment = _END.unpack_from(content, stop)
        if mark != b"PK\x05\x06" or comment or at + size != stop:
            return None
        held, self.places = {}, [at]
        while at < stop:
            mark, version, flags, method, crc, packed, plain, n_name, n_extra, n_comment, place = _ENTRY.unpack_from(content, at)
            raw = content[at + 46 : at + 46 + n_name]
            # versions that zipfile refuses; encryption and patches; other methods; large or renamed members
            if mark != b"PK\x01\x02" or version > 63 or flags & ~0x80E or method not in (0, 8) or b"\0" in raw or n_extra and not _usual(content[at + 46 + n_name : at + 46 + n_name + n_extra]):
                return None
            held[raw.decode() if flags & 0x800 or raw.isascii() else raw.decode("cp437")] = raw, flags, method, crc, packed, plain, place
            self.places.append(place)
            at += 46 + n_name + n_extra + n_comment
        self.places.sort()
        return held if at == stop and len(set(self.places)) == len(self.places) else None

    def read(self, name: str) -> bytes:
        if self.slow is None and name in self.held:
            raw, flags, method, crc, packed, plain, place = self.held[name]
            try:
                mark, own, n_name, n_extra = _LOCAL.unpack_from(self.content, place)
                start = place + 30 + n_name + n_extra
                if mark == b"PK\x03\x04" and not (own ^ flags) & 0x800 and self.content[place + 30 : place + 30 + n_name] == raw and start + packed <= self.places[bisect_right(self.places, place)]:
                    data = self.content[start : start + packed]
                    if method == 8:
                        data = zlib.decompressobj(-15).decompress(data, plain + 1)
                    if len(data) == plain and zlib.crc32(data) == crc:
                        return data
            except (struct.error, zlib.error, IndexError):
                pass
        self.slow = self.slow or zipfile.ZipFile(io.BytesIO(self.content))
        return self.slow.read(name)


def _xml(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data[:2000] and b"<!ENTITY" in data[:20000]:
        raise ValueError("entities are not read")
    return ET.fromstring(data)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _called(elements: Iterable[ET.Element], name: str) -> list[ET.Element]:
    """Those of the elements with the name, in any namespace."""
    return [e for e in elements if e.tag.rpartition("}")[2] == name]


def epub_rows(path: str, content: bytes) -> list[tuple]:
    """A row for each manifest item, with its place in the spine (null outside) and whether it is there; spine first, then by member."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = next(e.get("full-path") for e in _xml(z.read("META-INF/container.xml")).iter() if _name(e) == "rootfile")
        package = _xml(z.read(root))
        spine = {e.get("idref"): i for i, e in enumerate(x for x in package.iter() if _name(x) == "itemref")}
        out = []
        for e in package.iter():
            if _name(e) == "item":
                member = normpath(join(dirname(root), e.get("href", "")))
                page = e.get("media-type") == "application/xhtml+xml" and member in names
                out.append((path, e.get("id"), member, e.get("media-type"), spine.get(e.get("id")), member in names, z.read(member).decode("utf-8", "replace") if page else None))
        return sorted(out, key=lambda r: (r[4] is None, r[4] or 0, r[2]))


def read_epub(rows: DataFrame) -> DataFrame:
    return mapped(rows, epub_rows, "path string, id string, member string, mime string, spine int, held boolean, html string")


@lru_cache(16)  # most books have the same container
def _root_file(container: bytes) -> str:
    return next(e.get("full-path") for e in _xml(container).iter() if _name(e) == "rootfile")


def _package(z: zipfile.ZipFile | Members) -> tuple[str, ET.Element]:
    root = _root_file(z.read("META-INF/container.xml"))
    return root, _xml(z.read(root))


def epub_metadata_rows(path: str, content: bytes) -> list[tuple]:
    """A row for each metadata entry: its name without prefix, or the property of a meta element, and its text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = _package(z)[1]
    found = [x for e in package.iter() if _name(e) == "metadata" for x in e]
    rows = [(x.get("property") or x.get("name") if _name(x) == "meta" else _name(x), " ".join((x.text or x.get("content") or "").split())) for x in found]
    return [(path, i, n, v) for i, (n, v) in enumerate(rows) if n and v]


def read_epub_metadata(rows: DataFrame) -> DataFrame:
    return mapped(rows, epub_metadata_rows, "path string, pos int, name string, value string")


def epub_outline_rows(path: str, content: bytes) -> list[tuple]:
    """Entries of the navigation document, or of the older table of contents where there is none: place, depth, title, member, fragment."""

    def entry(depth: int, title: str, target: str | None) -> None:
        file, _, fragment = (target or "").partition("#")
        place = normpath(join(folder, unquote(file))) if file else member if target else None
        found.append((path, len(found), depth, " ".join(title.split()), place, fragment or None))

    z = Members(content)
    root, package = _package(z)
    items = _called(package.iter(), "item")
    nav = next((e for e in items if "nav" in e.get("properties", "").split()), None)
    chosen = nav if nav is not None else next((e for e in items if e.get("media-type") == "application/x-dtbncx+xml"), None)
    if chosen is None:
        return []
    member = normpath(join(dirname(root), chosen.get("href", "")))
    folder, tree = dirname(member), _xml(z.read(member))
    found: list[tuple] = []
    if nav is not None:
        navs = _called(tree.iter(), "nav")
        toc = next((e for e in navs if any(k.endswith("type") and "toc" in v.split() for k, v in e.attrib.items())), navs[0] if navs else ())
        todo = [(e, 0) for e in reversed(_called(toc, "ol"))]
        while todo:  # the next one stands last
            e, depth = todo.pop()
            if _name(e) == "li":
                label = next((c for c in e if _name(c) in ("a", "span")), None)
                if label is not None:
                    entry(depth, "".join(label.itertext()), label.get("href"))
                todo += [(c, depth + 1) for c in reversed(_called(e, "ol"))]
            else:
                todo += [(c, depth) for c in reversed(_called(e, "li"))]
    else:
        todo = [(e, 0) for m in _called(tree.iter(), "navMap") for e in _called(m, "navPoint")][::-1]
        while todo:
            e, depth = todo.pop()
            title = next(("".join(c.itertext()) for c in _called(e, "navLabel")), "")
            entry(depth, title, next((c.get("src") for c in _called(e, "content")), None))
            todo += [(c, depth + 1) for c in reversed(_called(e, "navPoint"))]
    return found


def read_epub_outline(rows: DataFrame) -> DataFrame:
    return mapped(rows, epub_outline_rows, "path string, pos int, depth int, title string, member string, fragment string")


def collection_rows(path: str, content: bytes) -> list[tuple]:
    """Entries of a book's collection file: place, depth, title and the module (null for a subcollection)."""
    out: list[tuple] = []
    todo = [(e, 0) for e in _xml(content).iter() if _name(e) == "content"][:1]
    while todo:
        e, depth = todo.pop(0)
        title = next((" ".join("".join(c.itertext()).split()) for c in e if _name(c) == "title"), None)
        if _name(e) in ("subcollection", "module"):
            out.append((path, len(out), depth, title, e.get("document") if _name(e) == "module" else None))
        inner = [c for x in e if _name(x) == "content" for c in x] if _name(e) == "subcollection" else list(e) if _name(e) == "content" else []
        todo = [(c, depth + (_name(e) == "subcollection")) for c in inner if _name(c) in ("subcollection", "module")] + todo
    return out


def read_collections(rows: DataFrame) -> DataFrame:
    return mapped(rows, collection_rows, "path string, pos int, depth int, title string, module string")


def cartridge_rows(path: str, content: bytes) -> list[tuple]:
    """Entries of a cartridge's organization: place, depth, title, resource, its type and file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        manifest = _xml(z.read("imsmanifest.xml"))
    held = {e.get("identifier"): (e.get("type"), e.get("href") or next((f.get("href") for f in e if _name(f) == "file"), None)) for e in manifest.iter() if _name(e) == "resource"}
    out: list[tuple] = []
    todo = [(e, 0) for e in manifest.iter() if _name(e) == "organization"][:1]
    while todo:
        e, depth = todo.pop(0)
        if _name(e) == "item":
            title = next((c.text for c in e if _name(c) == "title"), None)
            kind, href = held.get(e.get("identifierref"), (None, None))
            if title or href:
                out.append((path, len(out), depth, title, e.get("identifierref"), kind, href))
        todo = [(c, depth + (_name(e) == "item")) for c in e if _name(c) == "item"] + todo
    return out


def read_cartridge(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("type").isNull(), "heading").when(F.col("type") == "webcontent", F.when(F.lower("href").rlike(r"\.x?html?$"), "page").otherwise("file")).when(F.col("type").contains("imswl"), "link").otherwise("activity")
    return mapped(rows, cartridge_rows, "path string, pos int, depth int, title string, resource string, type string, href string").withColumn("kind", kind)


DECK = "path string, slide int, shape_id int, parent_id int, seq int, kind string, text string, descr string, decorative boolean, is_title boolean, x long, y long, w long, h long"


def deck_rows(path: str, content: bytes) -> list[tuple]:
    """Shapes of each slide in tree order, groups before what they hold."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for number, member in enumerate(slides, 1):
            todo: list[tuple[ET.Element, int | None]] = [(e, None) for e in _xml(z.read(member)).iter() if _name(e) == "spTree"][:1]
            seq = 0
            while todo:
                e, parent = todo.pop(0)
                kind = {"sp": "shape", "pic": "picture", "graphicFrame": "object", "grpSp": "group", "cxnSp": "connector"}.get(_name(e))
                own = parent
                if kind:
                    info = next((x for x in e.iter() if _name(x) == "cNvPr"), None)
                    own = int(info.get("id", 0)) if info is not None else 0
                    title = any(_name(x) == "ph" and x.get("type") in ("title", "ctrTitle") for x in e.iter())
                    text = "\n".join("".join(t.text or "\t" for t in p.iter() if _name(t) in ("t", "tab")) for p in e.iter() if _name(p) == "p") if kind == "shape" else ""
                    box = {_name(x): x for x in e.iter() if _name(x) in ("off", "ext") and (x.get("x") or x.get("cx"))}
                    place = [int(box["off"].get(k, 0)) if "off" in box else 0 for k in ("x", "y")] + [int(box["ext"].get(k, 0)) if "ext" in box else 0 for k in ("cx", "cy")]
                    out.append((path, number, own, parent, seq, kind, text, info.get("descr") if info is not None else None, any(_name(x) == "decorative" and x.get("val") == "1" for x in e.iter()), title, *place))
                    seq += 1
                if kind in (None, "group"):
                    todo = [(c, own) for c in e if _name(c) in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")] + todo
    return out


def read_decks(rows: DataFrame) -> DataFrame:
    return mapped(rows, deck_rows, DECK)


def epub_rules(items: DataFrame) -> DataFrame:
    """Findings about a package: items without a file, and a spine without pages."""
    lost = items.filter("not held").select(F.col("path").alias("where"), F.lit("manifest-item-missing").alias("check"), F.col("member").alias("detail"))
    empty = items.groupBy("path").agg(F.count("spine").alias("n")).filter("n = 0").select(F.col("path").alias("where"), F.lit("spine-idref-unknown").alias("check"), F.lit("no page in the spine").alias("detail"))
    return lost.unionByName(empty)
