"""WARC archives: a deduplicating writer and a salvage reader.

Archives are rows (archive, content) of a table, so they go wherever Spark can write; spark.read.format("binaryFile")
gives ordinary .warc and .warc.gz files in the same shape. The reader checks every member (gzip checks, version
line, headers, lengths, payload digest). After a failed check it searches for the next member (or, in
uncompressed archives and inside unpacked members, version line) that passes, goes on from there, and logs the bytes between as a
quarantined gap. What a member gave before a gzip error is read by the same checks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import arrow_map, utf8

#: An archive is closed after this many bytes.
ROLL = 4_000_000
PIECE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
EOL = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:tessella:page:{'' if page_id is None else page_id}:{row}>"


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def write_record(page_id: int | None, row: int, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response record, or a revisit of the record refers_to, whose block has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


ARCHIVE = StructType([StructField("archive", StringType()), StructField("content", BinaryType())])


def write_archives(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """archive, content: gzip WARC archives of the pages (page_id, url, html).

    Of pages with equal payloads of least_bytes or more, that with the smallest page_id (nulls last; of repeated rows
    one) is a response and the others revisit it. Null html is an empty payload, null url an empty one; an
    empty table gives no archives; other columns are not read.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), utf8("html").alias("payload"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha1("payload")))
    rank = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.col("row").alias("r"))
    first = base.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min(rank).alias("f")).select("digest", F.col("f.p").alias("first_id"), F.col("f.r").alias("first_row"))
    rows = base.join(first, "digest", "left").select("page_id", "row", "url", "payload", F.when(F.octet_length("payload") < least_bytes, None).otherwise(F.col("first_id")).alias("first_id"), F.when(F.octet_length("payload") < least_bytes, None).otherwise(F.col("first_row")).alias("first_row"))

    def run(rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, held, size, n = context.partitionId() if context else 0, [], 0, 0
        for page_id, row, url, payload, first_id, first_row in rows:
            held.append(member(write_record(page_id, row, url, payload, None if first_row is None or first_row == row else record_id(first_id, first_row))))
            size += len(held[-1])
            if size >= ROLL:
                yield f"part-{part:05d}-{n:05d}.warc.gz", b"".join(held)
                held, size, n = [], 0, n + 1
        if held:
            yield f"part-{part:05d}-{n:05d}.warc.gz", b"".join(held)

    return arrow_map(rows, run, ARCHIVE)


class Damaged(ValueError):
    pass


_ID = re.compile(r"<urn:tessella:page:(-?\d*):\d+>")


def page_of(value: str | None) -> int | None:
    m = _ID.fullmatch(value or "")
    return int(m[1]) if m and m[1] else None


def fields_of(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line has no colon")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at this place of uncompressed data, checked, and the place behind it."""
    if not re.match(rb"WARC/\d\.\d\r\n", data[at : at + 10]):
        raise Damaged("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise Damaged("the header does not end")
    head = fields_of(data[at:split].split(EOL)[1:])
    if not (length := head.get("content-length", "")).isdigit():
        raise Damaged("no Content-Length")
    start = split + 4
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block has another length")
    block, kind = data[start:end], head.get("warc-type", "")
    payload, n, digest = block, len(block), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = fields_of(http.split(EOL)[1:]).get("content-length", "")
        n = int(told) if told.isdigit() else len(payload)
    if kind == "response":
        if digest and digest != digest_of(payload):
            raise Damaged("the payload has another digest")
        if n != len(payload):
            raise Damaged("the payload has another length")
    record = {"page_id": page_of(head.get("warc-record-id")), "url": head.get("warc-target-uri", ""), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": page_of(head.get("warc-refers-to")), "payload": payload if kind == "response" else None}
    return record, end + 4


class Broken(Damaged):
    """A gzip member fails its checks; plain is what was inflated before."""

    def __init__(self, reason: str, plain: bytes):
        super().__init__(reason)
        self.plain = plain


def inflated(data: bytes, at: int, stop: int | None = None) -> tuple[bytes, int]:
    """What a broken member gives, byte by byte in the last piece, and the place by which it gave that or `stop` bytes."""
    inflater, view, pos, plain, n = zlib.decompressobj(31), memoryview(data), at, [], 0
    step = PIECE
    while pos < len(data) and not inflater.eof:
        spare = inflater.copy() if step > 1 else None
        try:
            out = inflater.decompress(view[pos : pos + step])
        except zlib.error:
            out = None
        if step > 1 and (out is None or stop is not None and n + len(out) >= stop):
            inflater, step = spare, 1
            continue
        if out is None:
            break
        plain.append(out)
        n, pos = n + len(out), min(pos + step, len(data))
        if stop is not None and n >= stop:
            break
    return b"".join(plain), pos


def unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at this place and the place behind it."""
    inflater, view, pos, plain = zlib.decompressobj(31), memoryview(data), at, []
    try:
        while pos < len(data) and not inflater.eof:  # in pieces: what is left over is copied each time
            plain.append(inflater.decompress(view[pos : pos + PIECE]))
            pos += PIECE
    except zlib.error as e:
        raise Broken(f"gzip: {e}", inflated(data, at)[0]) from None
    if not inflater.eof:
        raise Broken("gzip: the member does not end", b"".join(plain))
    return b"".join(plain), min(pos, len(data)) - len(inflater.unused_data)


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")


def inside(plain: bytes) -> tuple[list[tuple], int]:
    """(record, None) and (None, reason) of each record and gap of a member's bytes, and the place behind the last record."""
    items, pos, last, reason = [], 0, 0, None
    while pos < len(plain):
        try:
            record, end = parse_record(plain, pos)
        except Damaged as e:
            reason = reason or str(e)
            m = _VERSION.search(plain, pos + 1)
            pos = m.start() if m else len(plain)
            continue
        items += [(None, reason)] * (reason is not None) + [(record, None)]
        pos, last, reason = end, end, None
    return items + [(None, reason)] * (reason is not None), last


def one(data: bytes, at: int) -> tuple[list[tuple], int, str | None]:
    """The items of the member (or the plain record) at this place, the place behind, and why a member is broken.

    Of a broken member the place is where its last good record ended. Without a good record the bytes are damaged, and so is a
    broken member that is one record and no more, as the check that fails is the record's own.
    """
    if data[at : at + 2] != b"\x1f\x8b":
        record, end = parse_record(data, at)
        return [(record, None)], end, None
    try:
        (plain, end), broken = unpack(data, at), None
    except Broken as e:
        plain, end, broken = e.plain, at, str(e)
    items, last = inside(plain)
    if (plain or broken) and not last or broken and len(items) == 1 and last == len(plain):
        raise Damaged(broken or items[0][1])
    if broken:
        return [i for i in items if i[0]], inflated(data, at, last)[1], broken
    return items, end, None


def salvage(data: bytes):
    """Yields (offset, end, record, reason): records in order, and gaps (record None) with the reason of the first failed check.

    Inside a gzip member, records and gaps have the member's offset and end. A member that breaks off gives the records before
    and a gap; both end where the next bytes that pass begin.
    """
    at, held = 0, None
    while at < len(data):
        try:
            items, end, broken = one(data, at)
        except Damaged as e:
            held = held or (at, [], str(e))
            m = _NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if held:
            yield from ((held[0], at, *i) for i in [*held[1], (None, held[2])])
            held = None
        if broken:
            held = (at, items, broken)
            m = _NEXT.search(data, max(end, at + 1))
            at = m.start() if m else len(data)
            continue
        yield from ((at, end, *i) for i in items)
        at = end
    if held:
        yield from ((held[0], len(data), *i) for i in [*held[1], (None, held[2])])


RECORDS = StructType(
    [
        StructField("archive", StringType()),
        StructField("offset", LongType()),
        StructField("end", LongType()),
        StructField("gap", StringType()),
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("record_type", StringType()),
        StructField("refers_to", LongType()),
        StructField("payload", BinaryType()),
    ]
)


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record, and a row per quarantined gap (gap: the reason; offset, end: its bytes).

    archives: archive (or path) and content. Null or empty content has neither. Revisits have no payload of their own;
    their payload_bytes and payload_digest are those of the payload they stand for.
    """
    name = "archive" if "archive" in archives.columns else "path"

    def run(rows):
        for archive, content in rows:
            for offset, end, record, reason in salvage(content or b""):
                if record is None:
                    yield archive, offset, end, reason, *[None] * 7
                else:
                    yield archive, offset, end, None, *(record[k] for k in RECORDS.names[4:10]), record["payload"] if payloads else None

    # a few archives at a time reach a worker
    return arrow_map(archives.select(F.col(name).alias("archive"), "content"), run, RECORDS)
