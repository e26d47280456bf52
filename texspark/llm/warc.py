"""WARC archives: written with segmented records, read back and reassembled.

Each page is a record whose block is an HTTP response with a chunked body. A block
longer than a segment is cut: the first segment keeps the record's type, the others are
continuation records that name the record they continue, their number and, on the last
one, the total length. Readers group the segments by origin, order them by number, hold
the sum against the total length and decode the chunked framing. Of records with the
same payload one keeps it, and the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import saved, shared_dir, table, text_slices

#: Bytes of a block that one record holds, of an HTTP chunk, and of records that one archive file holds (about).
SEGMENT, CHUNK, ARCHIVE_RECORDS = 256 << 10, 16 << 10, 400
#: Bytes that are inflated at a time.
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def cut(text: bytes, size: int) -> list[bytes]:
    """Pieces of `size` bytes at most, none ending inside a character: the archives are written as text."""
    pieces, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(text[at:end])
        at = end
    return pieces


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = cut(payload, size)
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """A WARC/1.1 record without the two line ends that follow it."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", *(f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + _END + block


def clean(url: str | None) -> str:
    """The url without characters that would end its header line."""
    return re.sub(r"[\x00-\x20\x7f]+", "", url or "") or "urn:none"


def records(row: dict) -> Iterator[bytes]:
    """The records of a page: one, or the first segment and its continuations."""
    name, uri = f"urn:page:{row['row']}", clean(row["url"])
    fields = {"Target_URI": uri, "Payload_Digest": f"sha1:{row['digest']}", "Page": row["row"]}
    if row["refers_to"] is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        yield record("revisit", name, head, **fields, Refers_To=f"<urn:page:{row['refers_to']}>", Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html.encode() if isinstance(html := row["html"] or b"", str) else html)
    if len(block) <= SEGMENT:
        yield record("response", name, block, **fields)
        return
    pieces = cut(block, SEGMENT)
    for number, piece in enumerate(pieces, 1):
        last = {"Segment_Total_Length": len(block)} if number == len(pieces) else {}
        if number == 1:
            yield record("response", name, piece, **fields, Segment_Number=1)
        else:
            yield record("continuation", f"{name}:{number}", piece, Segment_Origin_ID=f"<{name}>", Segment_Number=number, **last)


class Inflated(io.RawIOBase):
    """The bytes of gzip members, one after the other; `whole` tells whether they came to their end."""

    def __init__(self, content: bytes):
        self.content, self.at, self.member, self.held, self.more, self.broken = memoryview(content), 0, None, memoryview(b""), False, False

    def readable(self) -> bool:
        return True

    @property
    def whole(self) -> bool:
        return not self.broken and self.member is None

    def readinto(self, out) -> int:
        while not self.held and not self.broken and (self.more or self.at < len(self.content)):
            self.member = self.member or zlib.decompressobj(31)
            chunk = self.content[self.at : self.at + (1 << 16)]
            try:
                self.held = memoryview(self.member.decompress(chunk, PIECE))
            except zlib.error:
                self.broken = True
                break
            self.at += len(chunk) - len(self.member.unconsumed_tail or self.member.unused_data)
            self.more = len(self.held) == PIECE and not self.member.eof
            if self.member.eof:
                self.member = None
        n = min(len(out), len(self.held))
        out[:n], self.held = self.held[:n], self.held[n:]
        return n


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive (plain, or gzip of any number of members): header fields in lower case, and blocks.

    Lines may end without a carriage return, fields may lack the blank after the colon
    or go on in the next line. Raises ValueError where an archive is damaged.
    """
    members = Inflated(content) if content[:2] == b"\x1f\x8b" else None
    file = io.BufferedReader(members, 1 << 18) if members else io.BytesIO(content)
    while first := file.readline():
        if not first.strip():  # the line ends after a record
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        fields, name = {}, ""
        while (line := file.readline()).strip():
            if line[:1] in b" \t" and name:
                fields[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ValueError("a header line has no field")
            name = name.strip().lower()
            fields[name] = value.strip()
        size = int(fields["content-length"]) if "content-length" in fields else -1
        block = file.read(max(size, 0))
        if size < 0 or len(block) < size:
            raise ValueError("record is cut short")
        yield fields, block
    if members and not members.whole:
        raise ValueError("archive is cut short")


def payload_of(kind: str, block: bytes) -> bytes:
    """The payload of a record's block: what follows the head of an HTTP response, or all of it; ValueError if it is broken."""
    if kind != "response" or not block.startswith(b"HTTP/"):
        return block
    head, end, body = block.partition(_END)
    if not end:
        raise ValueError("the head does not end")
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked", head.lower()) else body


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(sha1: Column) -> Column:
    """Base32 of a SHA-1 given in hex: eight digits for every ten."""
    eights = [F.lpad(F.conv(F.substring(sha1, at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digested(pages: DataFrame) -> DataFrame:
    """pages as page_id, url, html, digest and payload_bytes.

    None of the last three is null, for Spark either: else a join on the digest tests it at the scan, which makes it twice.
    """
    html = F.coalesce("html", F.lit(""))
    digest = F.coalesce(base32(F.sha1(html)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), digest.alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records to write for pages (page_id, url, html): row (an id), page_id, url, digest, payload_bytes, html, refers_to (a row).

    Of the rows with one payload of at least `least` bytes, that with the largest page_id
    is the response (nulls come first; of equal ids the last row); smaller payloads are
    all responses, and only these have their html here.
    """
    small = F.col("payload_bytes") < least
    described = saved(digested(pages).withColumn("html", F.when(small, F.col("html"))).withColumn("row", F.monotonically_increasing_id()), "pages")
    large = described.where(~small)
    best = large.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best")).select("digest", F.col("best.row").alias("first"))
    joined = large.join(best, "digest").withColumn("refers_to", F.when(F.col("row") != F.col("first"), F.col("first"))).drop("first")
    return joined.unionByName(described.where(small).withColumn("refers_to", F.lit(None).cast("long")))


def write(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as gzip-compressed WARC files in a folder of any Hadoop file system.

    Returns the rows' ids (row, page_id) by which records name pages. Html is text, so a
    record is a line of a text file whose line end is the two line ends after a record.
    Null html is an empty payload and a null url `urn:none`; repeated rows are records of
    their own; an empty table writes no record; other columns are ignored.
    """
    planned = saved(plan(pages, least), "plan")
    columns = ["row", "url", "digest", "payload_bytes", "refers_to"]
    lone = F.expr(f"refers_to is null and payload_bytes >= {least}")
    # A task hands on one copy of a payload, so copies don't gather.
    texts = digested(pages).where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.first("html").alias("html"))
    rows = planned.where(lone).select(*columns).join(texts, "digest").select(*columns, "html").unionByName(planned.where(~lone).select(*columns, "html"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            utf8 = batch.set_column(batch.schema.get_field_index("html"), "html", batch.column("html").cast(pa.binary()))
            for part in text_slices(utf8, "html"):
                yield pa.record_batch({"value": pa.array([r for row in part.to_pylist() for r in records(row)], pa.binary()).cast(pa.string())})

    rows.mapInArrow(lines, "value string").write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)
    return planned.select("row", "page_id")


def entries(content: bytes) -> Iterator[tuple]:
    """An archive's captures and their segments: record_id, kind, refers_to, url, payload_bytes, digest, number, total, block."""
    bare = lambda name: name.strip("<> ") if name else None
    for fields, block in parsed(content):
        kind, size, digest = fields.get("warc-type", "").lower(), None, None
        if kind not in ("response", "resource", "revisit", "continuation"):
            continue
        if kind == "revisit":
            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block)
            size, digest = int(length[1]) if length else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        name = bare(fields.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id"))
        total = fields.get("warc-segment-total-length")
        yield name, None if kind == "continuation" else kind, bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, digest, int(fields.get("warc-segment-number", 0)), None if total is None else int(total), block


def capture(record_id: str | None, kind: str | None, refers_to: str | None, url: str | None, size: int | None, digest: str | None, block: bytes | None) -> tuple:
    """What `read` gives for a whole record: record_id, kind, refers_to, url, payload_bytes, digest, whole, payload."""
    payload = None
    if kind != "revisit" and block is not None:
        with contextlib.suppress(ValueError):
            payload = payload_of(kind, block)
    if payload is not None:
        size, digest = len(payload), base32_digest(payload)
    return record_id, kind, refers_to, url, size, digest, kind == "revisit" or payload is not None, payload


def batches_of(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows, whose last value is the largest, in batches of about `limit` bytes; values past the schema's fields are left out."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=False)], schema=schema)

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1] or b"") + 500
        if total > limit:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """The captures in a folder of WARC files (*.gz, *.warc), of any writer.

    Returns record_id and refers_to (as in the header, without angle brackets), kind
    (response, resource or revisit; other records are no captures), url, payload_bytes,
    digest (of the payload read, or of the one a revisit names), payload and whole. whole
    is false if a capture lacks a segment or its length or framing is wrong; its payload
    is null then. An archive that is damaged gives a row with kind `damaged` after the
    records that can be read. An archive is held whole by a task, and so is a payload. A
    folder without records gives no rows; repeated records are rows of their own unless
    they are segments. Without `payloads` every payload is read and checked all the same,
    but its column is left out, so that none leaves its task.
    """
    arrow = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_()), *[("payload", pa.binary())] * payloads])
    row = "record_id string, kind string, refers_to string, url string, payload_bytes long, digest string, whole boolean" + ", payload binary" * payloads
    arrow_part = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    part = "record_id string, kind string, url string, number int, total long, block binary"

    def whole_of(content: bytes) -> Iterator[tuple]:
        try:
            for *head, number, _, block in entries(content):
                if number == 0:
                    yield capture(*head, block)
        except ValueError:
            yield None, "damaged", None, None, None, None, False, None

    def segments_of(content: bytes) -> Iterator[tuple]:
        with contextlib.suppress(ValueError):
            for name, kind, _, url, _, _, number, total, block in entries(content):
                if number > 0:
                    yield name, kind, url, number, total, block

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from batches_of(whole_of(content.as_py()), arrow)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from batches_of(segments_of(content.as_py()), arrow_part)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")

    # Records that are cut: the segments of an origin, in order, if none is missing and their lengths make the total.
    parts = files.mapInArrow(segments, part).groupBy("record_id").agg(F.max("kind").alias("kind"), F.max("url").alias("url"), F.max("total").alias("total"), F.count("*").alias("n"), F.max("number").alias("last"), F.sum(F.length("block")).alias("length"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"))
    sound = F.expr("kind is not null and n = last and length <=> total")
    joined = parts.select("record_id", "kind", "url", F.when(sound, F.array_join(F.transform("segments", lambda s: F.hex(s.block)), "")).alias("hex")).select("record_id", "kind", "url", F.unhex("hex").alias("block"))

    def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (capture(name.as_py(), kind.as_py(), None, url.as_py(), None, None, block.as_py()) for name, kind, url, block in zip(*batch.columns, strict=True))
            yield from batches_of(rows, arrow)

    captures = files.mapInArrow(whole, row).unionByName(joined.mapInArrow(reassembled, row))
    return captures.select("record_id", "kind", "refers_to", "url", "payload_bytes", "digest", *["payload"] * payloads, "whole")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back; a capture that is not whole is an error."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = write(table(spark, sf_dir, "pages"), path)
    number = lambda name: F.regexp_extract(name, r"^urn:page:(\d+)$", 1).cast("long")
    captures = read(spark, path, payloads=False).select(number("record_id").alias("row"), F.when(F.col("whole"), F.col("kind")).otherwise(F.raise_error(F.lit("a capture was not read back whole"))).alias("kind"), number("refers_to").alias("refers_to"), "payload_bytes", "digest")
    # One join for both kinds, or the archives would be read again for each; responses refer to a negative row of their own, which none has.
    named = captures.join(rows, "row").withColumn("refers_to", F.coalesce("refers_to", -1 - F.col("row")))
    response = rows.select(F.col("row").alias("refers_to"), F.col("page_id").alias("refers_page"))
    out = named.join(response, "refers_to", "left")
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"))


def oracle() -> str:
    """The columns and rows of op6_warc in DuckDB, where page ids are distinct."""
    return """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS response,
  list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT) AS fifths FROM pages_)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((fifths[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM named"""
