"""Archives: what is written is a sound archive, and archives of other forms are read whole."""

import glob
import gzip
import hashlib
import zlib
from base64 import b32encode

import pytest

from folioquarry.llm import warc

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", None), (4, "http://a/4", "é" * 70_000), (5, "http://a/5", "<p>five\r\n\r\nWARC/1.1\r\n"), (5, "http://a/5", "<p>five\r\n\r\nWARC/1.1\r\n"), (6, None, "<p>five\r\n\r\nWARC/1.1\r\n"), (None, "http://a/n", "<p>one</p>")]


def members(data):
    out = []
    while data:
        plain = zlib.decompressobj(31)
        out.append(plain.decompress(data) + plain.flush())
        data = plain.unused_data
    return out


def test_written_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write(warc.resolve(pages), str(tmp_path / "a"), date="2026-01-02T03:04:05Z", records_per_file=3)
    files = glob.glob(str(tmp_path / "a" / "part-*"))
    assert len(files) >= 3
    records = [m for f in files for m in members(open(f, "rb").read()) if m]
    assert len(records) == len(PAGES) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in records)
    for f in files:
        assert gzip.decompress(open(f, "rb").read()) == b"".join(m for m in members(open(f, "rb").read()))
    heads = [dict(x.split(": ", 1) for x in m.split(b"\r\n\r\n", 1)[0].decode().split("\r\n")[1:]) for m in records]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) and {h["WARC-Date"] for h in heads} == {"2026-01-02T03:04:05Z"}
    by_id = {h.get("Page-ID"): h for h in heads}
    assert by_id["2"]["WARC-Refers-To"] == by_id["1"]["WARC-Record-ID"] and by_id["2"]["WARC-Refers-To-Target-URI"] == "http://a/1" and by_id["2"]["WARC-Refers-To-Date"] == "2026-01-02T03:04:05Z"
    assert "WARC-Refers-To" not in by_id["6"] and by_id["6"]["Refers-To-Page-ID"] == "5"
    for h, m in zip(heads, records, strict=True):
        block = m.split(b"\r\n\r\n", 1)[1][:-4]
        assert int(h["Content-Length"]) == len(block) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        body = block.split(b"\r\n\r\n", 1)[1]
        if h["WARC-Type"] == "response":
            assert h["WARC-Payload-Digest"] == "sha1:" + b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert body == b""


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(warc.resolve(pages), str(tmp_path / "b"))
    rows = warc.read(spark, str(tmp_path / "b")).collect()
    original = {i: (t or "").encode() for i, _, t in PAGES}
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (5, "response", None), (6, "revisit", 5)]
    for r in rows:
        assert r.payload_bytes == len(original[r.page_id])
        assert r.payload is None if r.record_type == "revisit" else r.payload == original[r.page_id]


def test_payloads_below_a_size_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {(r.page_id, r.record_type) for r in warc.resolve(pages, least_bytes=12).collect() if r.page_id in (2, 6)} == {(2, "response"), (6, "revisit")}


def foreign(kind, body, uri="http://x/"):
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if kind == "response" else body
    kinds = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields", "resource": "text/html"}
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nX-Folded: a\r\n b\r\nContent-Type: {kinds[kind]}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["members", "whole", "plain", "padded"])
def test_archives_of_other_tools(spark, tmp_path, form):
    parts = [foreign("warcinfo", b"software: x\r\n"), foreign("response", b"<p>1</p>" * 20_000), foreign("resource", b"\x00\xff"), foreign("response", b"")]
    data = {"members": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(b"".join(parts)), "plain": b"".join(parts), "padded": (b"\0" * 5).join(map(gzip.compress, parts))}[form]
    (tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload)) for r in rows] == [("warcinfo", b"software: x\r\n"), ("response", b"<p>1</p>" * 20_000), ("resource", b"\x00\xff"), ("response", b"")]


@pytest.mark.parametrize("cut", [10, 200, -1, -9])
def test_damaged_archives_are_errors(cut):
    data = gzip.compress(foreign("response", bytes(range(256)) * 40))[:cut]
    with pytest.raises(warc.Damaged):
        list(warc.records_of(data))
    with pytest.raises(warc.Damaged):
        list(warc.records_of(foreign("response", b"abc")[: cut if cut < 0 else -5]))
    with pytest.raises(warc.Damaged):
        list(warc.records_of(gzip.compress(foreign("response", b"abc")) + b"junk"))
