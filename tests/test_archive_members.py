"""Members of ordinary archives are read without zipfile, and those of all others as zipfile reads them."""

import io
import random
import zipfile

import pytest

from folioquarry.plans.site_queries import _stored
from folioquarry.sources import archives

CONTAINER = "<c><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></c>"
PACKAGE = "<package><manifest><item href='n%s.xhtml' properties='nav'/></manifest></package>"
NAV = "<html xmlns:e='u'><nav e:type='toc'><ol><li><a href='t/a%%20b.xhtml#s'>%s</a><ol><li><span>in</span></li></ol></li><li><a href='#x'>last</a></li></ol></nav></html>"


def packed(members, method=zipfile.ZIP_STORED, before=b"", comment=b"", extra=b""):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, text in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.extra = method, extra
            z.writestr(info, text)
    return out.getvalue()


def read(one, names):
    try:
        return [one.read(n) for n in names]
    except Exception as e:  # noqa: BLE001
        return type(e), str(e)


def test_outlines_of_ordinary_books_take_no_zipfile(monkeypatch):
    members = [("META-INF/container.xml", CONTAINER), ("O/p.opf", PACKAGE % 1), ("O/n1.xhtml", NAV % "é")]
    books = [packed(members), packed(members, zipfile.ZIP_DEFLATED), packed(members, extra=b"UT\5\0\1abcd"), _stored(members)]
    monkeypatch.setattr(zipfile, "ZipFile", None)
    for book in books:
        assert archives.epub_outline_rows("b", book) == [("b", 0, 0, "é", "O/t/a b.xhtml", "s"), ("b", 1, 1, "in", None, None), ("b", 2, 0, "last", "O/n1.xhtml", "x")]


@pytest.mark.parametrize("how", [{}, {"method": zipfile.ZIP_DEFLATED}, {"method": zipfile.ZIP_LZMA}, {"before": b"#!/bin/sh\n"}, {"comment": b"a comment"}, {"extra": b"UT\5\0\1abcd"}, {"extra": b"\x99\x99\xff\0"}])
def test_members_are_those_of_zipfile(how):
    members = [("a", "one " * 50), ("é/b", "zwei ü"), ("c", "")]
    names, content = [n for n, _ in members], packed(members, **how)
    rng = random.Random(3)
    for _ in range(400):
        try:
            right = read(zipfile.ZipFile(io.BytesIO(content)), names)
        except Exception as e:  # noqa: BLE001
            right = type(e), str(e)
        try:
            got = read(archives.Members(content), names)
        except Exception as e:  # noqa: BLE001
            got = type(e), str(e)
        assert got == right
        broken = bytearray(packed(members, **how))  # from the second time on, one byte is another
        broken[rng.randrange(len(broken))] = rng.randrange(256)
        content = bytes(broken)


def test_stored_archives_are_sound():
    members = [("a/é.xml", "text ü"), ("b", ""), ("c", "x" * 70_000)]
    with zipfile.ZipFile(io.BytesIO(_stored(members))) as z:
        assert z.testzip() is None and [(n, z.read(n).decode()) for n in z.namelist()] == members
    with zipfile.ZipFile(io.BytesIO(_stored([]))) as z:
        assert z.namelist() == []


def test_missing_members_are_told():
    with pytest.raises(KeyError, match="no item named 'x' in the archive"):
        archives.Members(packed([("a", "b")])).read("x")
