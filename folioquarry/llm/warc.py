"""Operator 8: WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest; the smallest id of each digest is the original
response, and the rest are revisit records that point to it.  What was resolved goes back to the rows of the scan by
a broadcast while the digests that repeat are few; beyond ``BROADCAST_ROWS`` it goes back by a shuffle of the rows
with their payloads.  Archives hold one gzip member a record.  A response holds an HTTP message; a revisit holds the
message's header alone, and names its original by record id, address and date.  The reader takes archives of one
member a record, of one member in all, and plain ones, its own and foreign ones, record by record.

Defined results: a null payload is empty; rows that repeat the smallest id of their payload, and rows without an id,
are responses; rows that repeat another id are all revisits; record ids are fixed by page and payload, and random
for rows that repeat; an empty table writes no records; further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm.common import BATCH_BYTES, Scratch, bounded, new_folder, small_batches

#: Records in one archive file at most.
RECORDS_PER_FILE = 2_000
#: A gzip member without content.  The text writer closes every row with it, as it has to close rows with something.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
CLOSE = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, date string, refers_to_uri string, payload binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")


def sha1_base32(col) -> F.Column:
    """Bare upper-case base32 SHA-1 of a binary column, by the JVM: 8 groups of 5 hex digits, 4 letters each."""
    digits = F.sha1(col)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, target_uri, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_uri, repeats, original_repeats.

    The last two say whether another row has the same id and payload as this one, or as its original.
    """
    payload = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", sha1_base32(F.col("payload")))
    heads = rows.select("page_id", "payload_bytes", "payload_digest", "target_uri").filter(F.col("payload_bytes") >= least_bytes)
    # both are written, so payloads are digested once here, and a digest that many pages have can be split in the join
    scratch = Scratch(pages.sparkSession)
    heads = scratch.put(heads.groupBy("payload_digest", "page_id").agg(F.count("*").alias("copies"), F.min("target_uri").alias("uri")))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri", "copies")))
    groups = heads.groupBy("payload_digest").agg(F.sum("copies").alias("n"), first.alias("original")).filter("n > 1").drop("n")
    groups = scratch.put(groups)
    marks = heads.select(F.col("payload_digest").alias("mark_digest"), F.col("page_id").alias("mark_id"), "copies").join(groups, F.col("mark_digest") == F.col("payload_digest"))
    marks = scratch.put(marks.select("mark_digest", "mark_id", "copies", "original"))
    scratch.drop(heads, groups)
    out = rows.join(bounded(marks), (rows["payload_digest"] == F.col("mark_digest")) & rows["page_id"].eqNullSafe(F.col("mark_id")), "left")
    again = F.coalesce(F.col("page_id") != F.col("original.page_id"), F.lit(False))
    return out.select(
        "page_id", "target_uri", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original.page_id")).alias("refers_to"),
        F.when(again, F.col("original.uri")).alias("refers_to_uri"),
        (F.coalesce("copies", F.lit(1)) > 1).alias("repeats"),
        F.coalesce(F.col("original.copies") > 1, F.lit(False)).alias("original_repeats"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One record: header, HTTP message (of a revisit its header alone) and the closing blank lines."""
    one_line = lambda s: re.sub(r"[\r\n]", " ", s or "")
    payload = row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fixed = row["page_id"] is not None and not row["repeats"]
    heads = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"]) if fixed else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", one_line(row["target_uri"])),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if row["page_id"] is not None:
        heads.append(("Page-ID", str(row["page_id"])))  # a field of our own, which the standard allows
    if row["record_type"] == "revisit":
        heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", one_line(row["refers_to_uri"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(row["refers_to"]))]
        if not row["original_repeats"]:
            heads.append(("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])))
    else:
        block += payload
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + CLOSE


def member(data: bytes) -> bytes:
    """A gzip member, the same bytes for the same data."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write(records: DataFrame, folder: str, date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write resolved records as WARC files (``*.txt`` to Spark, gzip in fact) of one gzip member a record.

    Rows are compressed one by one and written by Spark's own writer, so that any store that Spark reaches will do.
    """
    small_batches(records.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                out.append(member(record({n: batch.column(n)[i].as_py() for n in batch.schema.names}, date)))
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    made = records.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    writer = made.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


class Damaged(ValueError):
    """An archive that does not say what its headers promise."""


class Stream:
    """Bytes of an archive in order, inflated as they are asked for; plain data pass through."""

    def __init__(self, data: bytes | memoryview, step: int = 1 << 16):
        self.data, self.at, self.step, self.held = memoryview(data), 0, step, bytearray()
        self.packed = bytes(self.data[:2]) == b"\x1f\x8b"
        self.plain, self.begun = zlib.decompressobj(31) if self.packed else None, False

    def more(self) -> bool:
        """Hold some more bytes; false at the end."""
        before = len(self.held)
        while len(self.held) == before:
            if self.packed and self.plain.eof:
                self.at -= len(self.plain.unused_data)
                while self.at < len(self.data) and self.data[self.at] == 0:  # padding between members
                    self.at += 1
                self.plain, self.begun = zlib.decompressobj(31), False
                if self.at < len(self.data) and bytes(self.data[self.at : self.at + 2]) != b"\x1f\x8b"[: len(self.data) - self.at]:
                    raise Damaged(f"no gzip member at byte {self.at}")
            if self.at >= len(self.data):
                if self.begun and not self.plain.eof:
                    raise Damaged("the last gzip member is cut")
                return False
            part = self.data[self.at : self.at + self.step]
            self.at, self.begun = self.at + len(part), self.packed
            try:
                self.held += self.plain.decompress(part) if self.packed else part
            except zlib.error as e:
                raise Damaged(f"bytes before {self.at} cannot be inflated: {e}") from None
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise Damaged("a record's header does not end")
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise Damaged("a record is shorter than its header says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def empty(self) -> bool:
        return not self.held and not self.more()


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive; raises Damaged where it is."""
    stream = Stream(data)
    while not stream.empty():
        first, *lines = re.sub("\r?\n[ \t]+", " ", stream.until(CLOSE).decode("utf-8", "replace")).strip("\r\n").split("\r\n")
        if first not in ("WARC/1.0", "WARC/1.1"):
            raise Damaged(f"no WARC record: {first[:40]!r}")
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(heads["content-length"]))
        if stream.take(4) != CLOSE:
            raise Damaged(f"{heads.get('warc-record-id')}: it does not end where its length says")
        yield heads, block


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and body of a stored HTTP message."""
    head, _, body = block.partition(CLOSE)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def _row(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest")
    is_http = h.get("content-type", "").startswith("application/http")
    fields, body = http_parts(block) if is_http else ({}, block)
    size = int(fields["content-length"]) if kind == "revisit" and fields.get("content-length", "").isdigit() else len(body)
    bare = digest.removeprefix("sha1:") if digest else None
    if kind == "response" and digest and digest.startswith("sha1:") and "transfer-encoding" not in fields and "content-encoding" not in fields:
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != bare.upper():
            raise Damaged(f"{h.get('warc-record-id')}: the payload is not the one its header names")
    number = lambda k: int(h[k]) if re.fullmatch("-?[0-9]+", h.get(k, "")) else None
    return (number("page-id"), h.get("warc-target-uri"), kind, bare, size, number("refers-to-page-id"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-refers-to-target-uri"), body if with_payload and kind != "revisit" else None)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives of a folder, one row each; the digests of responses are computed anew and compared.

    A reader holds one archive as it is stored, and some records of it inflated.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(folder).select("content")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in records_of(content.as_buffer()):
                    rows.append(_row(h, block, with_payload))
                    size += len(block) + 200
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return files.mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Write the resolved archives of ``pages`` to ``folder`` (else a new one in the shared folder) and read them back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write(resolve(pages, **names), folder)
    return read(spark, folder, with_payload=False)
