"""Legacy archive conversion: ARC records to equivalent WARC records.

``arc_archives`` renders pages as ARC files, ``convert`` reads ARC of version 1
(five header fields) and 2 (ten fields) by the field list of the file's own
version block and the declared lengths, and synthesises what WARC needs:
record identifiers, ISO timestamps, types and digests. ``mark_revisits`` makes
all but one record of equal payloads a revisit, ``write_warc`` writes archive
files through Spark's text writer (one archive a row, record separator as line
separator), ``read_warc`` reads them back from any store Spark can read.

Edge cases: a null html is an empty payload; white space in a URL is
percent-encoded and a missing URL is ``urn:nil``; records without id are always
responses; rows of the same id and payload are each a response; an empty table
gives no records. Payloads are any bytes, and may hold header-like lines.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.common import slices
from jobsight.session import scratch_path

# fixed values: field lists of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes after which an archive is closed and the next begins.
ARCHIVE_BYTES = 8 << 20
_END = b"\r\n\r\n"
_PREFIX = int.from_bytes(hashlib.sha1(b"arc-to-warc").digest()[:6], "big")

RECORD = T.StructType([
    T.StructField("record_key", T.LongType()), T.StructField("uri", T.StringType()),
    T.StructField("warc_date", T.StringType()), T.StructField("warc_type", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("head", T.BinaryType()), T.StructField("payload", T.BinaryType())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int) -> str:
    """A version 8 UUID that carries the record's key, so equal input gives equal identifiers."""
    n = _PREFIX << 80 | 8 << 76 | ((key >> 62) & 3) << 64 | 2 << 62 | (key & ((1 << 62) - 1))
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def key_of(identifier: str) -> int:
    n = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    key = (n >> 64 & 3) << 62 | n & ((1 << 62) - 1)
    return key - (1 << 64) if key >> 63 else key


# ---------------------------------------------------------------- writing ARC

def _version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n\n".encode()
    return _arc_line(version, f"filedesc://{name}", "19960101000000", "text/plain", body, name, 0) + body


def _arc_line(version: int, url: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    if version == 1:
        return f"{url} 0.0.0.0 {date} {kind} {len(body)}\n".encode()
    return f"{url} 0.0.0.0 {date} {kind} 200 {zlib.crc32(body):08x} - {offset} {name} {len(body)}\n".encode()


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One row ``arc`` (binary) per archive; versions 1 and 2 take turns. Pages carry no
    capture time, so records bear one fixed time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, number = [], 0, 0
        for batch in slices(batches):
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                version = 1 + number % 2
                name = f"pages-{number}.arc"
                if not out:
                    out = [_version_block(version, name)]
                    size = len(out[0])
                payload = (html or "").encode()
                url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:nil"
                mark = "" if key is None else f"X-Record-Key: {key}\r\n"
                body = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {len(payload)}\r\n{mark}\r\n").encode() + payload
                record = b"\n" + _arc_line(version, url, "19960101000000", "text/html", body, name, size) + body
                out.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["arc"])
                    out, number = [], number + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["arc"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "arc binary")


# ------------------------------------------------------------- ARC to records

def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file: header fields by name, ``body`` by the declared length."""
    fields, at = None, 0
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at:stop if stop >= 0 else len(data)]
        at += len(line) + 1
        if not line.strip():
            continue                                      # separator between records
        names = fields or (ARC_FIELDS[1] if line.count(b" ") == 4 else ARC_FIELDS[2]).split()
        values = line.decode("utf-8", "replace").split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC header of {len(values)} fields, {len(names)} expected: {line[:80]!r}")
        found = dict(zip(names, values))
        length = int(found["Archive-length"])
        if at + length > len(data):
            raise ValueError(f"ARC record of {length} bytes is cut off")
        found["body"] = data[at:at + length]
        at += length
        if fields is None and found["URL"].startswith("filedesc:"):
            fields = found["body"].split(b"\n")[1].decode().split()
        yield found


def to_record(arc: dict) -> tuple:
    """The WARC equivalent of one ARC record, as a row of RECORD."""
    d = (arc["Archive-date"] + "00000101000000"[len(arc["Archive-date"]):])[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    body, url = arc["body"], arc["URL"]
    if url.startswith("filedesc:"):
        return None, url, date, "warcinfo", arc["Content-type"], digest(body), b"", body
    if not body.startswith(b"HTTP/"):                     # e.g. dns: records
        return None, url, date, "resource", arc["Content-type"], digest(body), b"", body
    head, _, payload = body.partition(_END)
    mark = re.search(rb"(?mi)^X-Record-Key: (-?\d+)\r?$", head)
    key = int(mark[1]) if mark else None
    return key, url, date, "response", "application/http; msgtype=response", digest(payload), head + _END, payload


def convert(arcs: DataFrame, arc_col: str = "arc") -> DataFrame:
    """Rows of RECORD of all archives (version blocks become warcinfo)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.binary()] * 2
        for batch in slices(batches, 1):
            rows = [to_record(r) for data in batch.column(0).to_pylist() for r in parse_arc(data or b"")]
            for i in range(0, len(rows), 256):
                cols = zip(*rows[i:i + 256])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], RECORD.names)

    return arcs.select(arc_col).mapInArrow(run, RECORD)


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers_to``: the smallest record_key of the same payload
    (of ``min_bytes`` or more) where that is another record, else null. Only keys
    and digests are grouped; the payloads meet the few results by both, as a key may
    stand for several payloads."""
    keys = records.where((F.col("warc_type") == "response") & F.col("record_key").isNotNull()
                         & (F.length("payload") >= min_bytes)).select("record_key", "payload_digest")
    first = (keys.groupBy("payload_digest").agg(F.min("record_key").alias("first"), F.max("record_key").alias("top"))
             .where("first < top").drop("top"))
    revisits = (keys.join(first, "payload_digest").where("record_key > first")
                .select("record_key", "payload_digest", F.col("first").alias("refers_to")).distinct())
    return records.join(revisits, ["record_key", "payload_digest"], "left")


# ------------------------------------------------------------------- WARC files

def warc_record(key, uri, date, kind, content_type, payload_digest, head, payload, refers_to, fallback: int) -> bytes:
    """One WARC/1.1 record without its closing separator. A revisit keeps the HTTP
    head and leaves the payload out."""
    if refers_to is not None:
        kind, block = "revisit", head
    else:
        block = head + payload
    identifier = record_id(key) if key is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {payload_digest} {fallback}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if kind != "warcinfo":
        lines.append(f"WARC-Target-URI: {uri}")
        lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}",
              f"Content-Type: {content_type if kind != 'warcinfo' else 'application/warc-fields'}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def write_warc(marked: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files (gzip) below ``path``, each of about ``archive_bytes`` before compression."""
    cols = RECORD.names + ["refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n = [], 0, 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                out.append(warc_record(*row, n))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_END.join(out)], pa.binary())], ["warc"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(out)], pa.binary())], ["warc"])

    (marked.select(*cols).mapInArrow(run, "warc binary").select(F.col("warc").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        stop = data.index(_END, at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        start = stop + 4
        end = start + int(head["Content-Length"])
        yield head, data[start:end]
        at = end + 4


WARC_ROW = T.StructType([
    T.StructField("record_key", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("warc_date", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType())])


def _read_row(head: dict, block: bytes) -> tuple | None:
    kind = head["WARC-Type"]
    if kind == "warcinfo":
        return None
    stored = head["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(_END) if block.startswith(b"HTTP/") else (b"", b"", block)
    mark = re.search(rb"(?mi)^X-Record-Key: (-?\d+)\r?$", http)
    key = int(mark[1]) if mark else None
    if kind == "revisit":
        size = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)[1])
        return key, kind, head["WARC-Target-URI"], head["WARC-Date"], size, stored, key_of(head["WARC-Refers-To"])
    if digest(payload) != stored:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return key, kind, head["WARC-Target-URI"], head["WARC-Date"], len(payload), stored, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of WARC_ROW of all archives below ``path`` (warcinfo left out); digests of
    stored payloads are checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in slices(batches, 1):
            for data in batch.column(0).to_pylist():
                rows = [r for h, b in parse_warc(zlib.decompress(data, 31)) if (r := _read_row(h, b))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], WARC_ROW.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC_ROW)


def pages_through_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC files written and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    records = convert(arc_archives(pages))
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(mark_revisits(records, min_bytes), path)
    return read_warc(pages.sparkSession, path).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
