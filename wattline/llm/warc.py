"""Legacy ARC archives to WARC, and both formats read and written.

An ARC file opens with a `filedesc:` record whose body names the version and the fields of every later header line
(version 1: five fields, version 2: ten; the last is always the declared length). Records are cut by that length. A
converted record keeps the stored HTTP message as its block and gets a record id from its key, an ISO time from the
14-digit date, a type, and SHA-256 digests of block and payload. A payload that another record already holds becomes a
revisit: the HTTP head stays, with its declared content length, and the record names the other one.

Records are compressed one by one, as gzip members, and archives are rows of (name, content) of bounded size that Spark
writes and reads, so that any store works.

Defined results: a null payload is empty; a null or blank address becomes `urn:page:<key>`, and blanks and controls in an
address are percent-encoded; a null key is a key of its own; rows that repeat a key and its payload are all written, and
all are the response if the key is the smallest; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import joined_small
from wattline.session import materialize

#: Header fields of the two versions of the older format (fixed values).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
ARCHIVE_BYTES = 4 << 20
LEAST = 100
DATE = "20000101000000"
_KEY = b"X-Archive-Key"


# the older format -----------------------------------------------------------------------------------------------------

def http_message(key: int | None, payload: bytes) -> bytes:
    named = b"" if key is None else b"%s: %d\r\n" % (_KEY, key)
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (named, len(payload))) + payload


def safe_address(url: str | None, key: int | None) -> str:
    url = (url or "").strip()
    if not url:
        return f"urn:page:{'none' if key is None else key}"
    return re.sub(r"[\x00-\x20\x7f-\x9f   ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_head(name: str, version: int, date: str = DATE) -> bytes:
    body = f"{version} 0 converted\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, message: bytes, version: int, name: str, offset: int, ip: str = "0.0.0.0", date: str = DATE) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(message).hexdigest()} - {offset} {name}"
    return f"{url} {ip} {date} text/html{extra} {len(message)}\n".encode() + message + b"\n"


def read_arc(data: bytes) -> Iterator[dict[str, str | bytes]]:
    """Records of an archive as header fields and `content`; the fields come from the file's own version block."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        cells = data[at:end].decode().split(" ")
        length = int(cells[-1])
        content = data[end + 1:end + 1 + length]
        if len(content) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(content)} are there")
        at = end + 1 + length + 1
        if fields is None:
            lines = content.decode().split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"unknown archive version {version}")
            fields = lines[1].split(" ")
            continue
        if len(cells) != len(fields):
            raise ValueError(f"header line with {len(cells)} fields for {len(fields)}")
        yield dict(zip(fields, cells, strict=True)) | {"content": content}


# the newer format -----------------------------------------------------------------------------------------------------

def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page:{key}'.encode()).digest()[:16], version=5)}>"


def iso_time(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def message_parts(message: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Head with its blank line, payload, and header fields of an HTTP message."""
    cut = message.index(b"\r\n\r\n") + 4
    fields = dict(line.split(b": ", 1) for line in message[:cut - 4].split(b"\r\n")[1:])
    return message[:cut], message[cut:], fields


def to_warc(record: dict, refers: int | None = None, revisit: bool = False) -> bytes:
    """One uncompressed record: a response, or a revisit of the record with key `refers`."""
    head, payload, fields = message_parts(record["content"])
    key = int(fields[_KEY]) if _KEY in fields else None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}",
             f"WARC-Date: {iso_time(record['Archive-date'])}", f"WARC-Target-URI: {record['URL']}",
             f"WARC-IP-Address: {record['IP-address']}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive of gzip members."""
    while data:
        unpacker = zlib.decompressobj(31)
        record = unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data
        cut = record.index(b"\r\n\r\n") + 4
        fields = dict(line.split(": ", 1) for line in record[:cut - 4].decode().split("\r\n")[1:])
        yield fields, record[cut:cut + int(fields["Content-Length"])]


def convert(arc: bytes, revisits: dict[int, int | None]) -> bytes:
    """An archive of the older format as one of the newer; `revisits` by position of the record."""
    out = []
    for i, record in enumerate(read_arc(arc)):
        out.append(gzip_member(to_warc(record, revisits.get(i), i in revisits)))
    return b"".join(out)


# jobs -----------------------------------------------------------------------------------------------------------------

def first_holders(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """All pages with their digest and, where an equal payload of at least `least` bytes has a smaller key, that key."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    shared = keyed.where(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = joined_small(keyed, materialize(shared, "warc-shared"), "digest")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers"))


def write_archives(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content) of converted archives: every page is stored in the older format first, in both versions by turn."""
    def write(batches):
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        arc, records, revisits = b"", 0, {}
        held: list[bytes] = []
        size = 0

        def close():
            nonlocal made, records, revisits, held, size
            name = f"part-{part:06d}-{made:06d}.warc.gz"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([convert(b"".join(held), revisits)], pa.large_binary()).cast(pa.binary())],
                                             names=["name", "content"])
            made, records, revisits, held, size = made + 1, 0, {}, [], 0
            return out

        for batch in batches:
            cells = zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")], strict=True)
            for key, url, html, refers in cells:
                version, name = 1 + made % 2, f"part-{part:06d}-{made:06d}.arc"
                if not held:
                    held, size = [arc_head(name, version)], 0
                record = arc_record(safe_address(url, key), http_message(key, (html or "").encode()), version, name, size)
                if refers is not None:
                    revisits[records] = refers
                held.append(record)
                records += 1
                size += len(record)
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return first_holders(pages, least).mapInArrow(write, "name string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, record_id, record_type, payload_bytes, payload_digest, refers_id.

    The digest of a response is computed from its payload and must be the declared one.
    """
    schema = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_id string"

    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for fields, block in read_warc(content):
                    _, payload, http = message_parts(block)
                    kind = fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    rows.append({"page_id": int(http[_KEY]) if _KEY in http else None, "record_id": fields["WARC-Record-ID"],
                                 "record_type": kind, "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest,
                                 "refers_id": fields.get("WARC-Refers-To")})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_id", pa.string())]))

    return archives.mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Add `refers_to`, the key of the response that a revisit names."""
    records = materialize(records, "warc-records")
    plain = records.where("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    ids = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(
        F.min("page_id").alias("refers_to"))
    linked = records.where("refers_id IS NOT NULL").join(ids, "refers_id", "left")
    return plain.unionByName(linked)


def warc_round(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and resolve the revisits."""
    return resolve(read_archives(materialize(write_archives(pages, least, archive_bytes), "warc-archives")))
