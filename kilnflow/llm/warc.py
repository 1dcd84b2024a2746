"""Operator 11: WARC archives with revisits, and a salvage reader.

Archives hold one gzip member per record. The reader checks every record
(member checksum, version line, lengths, digests); after a failed check it
searches for the next member or version line that holds a whole valid record,
goes on from there, and returns the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.llm.common import cut

GZIP = b"\x1f\x8b\x08"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A gzip member of nothing, but for its last byte, a zero.
_EMPTY = zlib.compress(b"", wbits=31)[:-1]
_ID = re.compile(r"<urn:kilnflow:page:(-?\d+)>$")
#: Rows of one payload are dealt over so many keys when they look up the payload's response.
SALTS = 4096


class Damaged(ValueError):
    """What lies at a place of an archive is no whole record."""


@dataclass
class Record:
    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int
    payload_digest: str | None


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


# --- writing ---------------------------------------------------------------


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A revisit has the HTTP header of its response and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + (b"" if revisit else payload or b"")
    name = lambda i: f"<urn:kilnflow:page:{'null' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    lines += [f"WARC-Payload-Digest: {_sha1(bytes.fromhex(digest))}", f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _plan(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(responses with their payloads, revisits without) of ``pages``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # Payloads are hashed once; what follows works on ids and digests.
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    keys = cut(rows.filter(F.col("n") >= min_bytes).groupBy("page_id", "url", "digest", "n").agg(F.count("*").alias("copies")).withColumn("salt", salt), "warc-keys")
    salted = keys.groupBy("digest", "salt").agg(F.max("page_id").alias("top"), F.sum("copies").alias("rows"))
    tops = salted.groupBy(F.col("digest").alias("d_")).agg(F.max("top").alias("refers_to"), F.sum("rows").alias("rows_")).filter("rows_ > 1")
    # At most SALTS rows of a digest meet here, and a digest's rows are dealt by the salt afterwards.
    by_salt = salted.select("digest", "salt").join(tops, F.col("digest") == F.col("d_")).select("digest", "salt", "refers_to")
    again = keys.join(by_salt, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = cut(again.select("page_id", "url", "digest", "n", "copies", "refers_to"), "warc-revisits")
    gone = again.select(F.col("page_id").alias("g_id"), F.col("digest").alias("g_digest"), F.lit(True).alias("g_"))
    responses = rows.join(gone.distinct(), F.col("page_id").eqNullSafe(F.col("g_id")) & (F.col("digest") == F.col("g_digest")), "left_anti")
    return responses, again.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("i", "copies")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, archive_bytes: int = 32 << 20, compress: bool = True, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into archives below ``path``, a file for about each ``archive_bytes``.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least
    ``min_bytes`` those with the largest page_id are responses and the others
    revisit them; rows with smaller payloads are all responses. A null page_id
    is below all others. Rows that repeat a response's id and payload are
    responses, too. Control characters, spaces and non-ASCII characters of a
    url are percent-encoded; a null url gives no target. Other columns are not
    kept. An empty table writes no record.

    Files are written by Spark's text sink, so that lost tasks leave nothing
    behind. Its separator, at a file's end, is the archive's own last byte.
    """
    responses, revisits = _plan(pages, min_bytes)
    columns = ["page_id", "url", "payload", "n", "digest", "revisit", "refers_to"]
    responses = responses.withColumns({"revisit": F.lit(False), "refers_to": F.lit(None).cast("long")}).select(*columns)
    revisits = revisits.withColumns({"revisit": F.lit(True), "payload": F.lit(None).cast("binary")}).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            data = b"".join(done)
            if compress:
                data = data[:-1] if data[-1] == 0 else data + _EMPTY
            else:
                data = data[:-1]
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])

        for b in batches:
            for row in zip(*b.columns):
                page_id, url, payload, n, digest, revisit, refers_to = (x.as_py() for x in row)
                data = record_bytes(page_id, url, payload, n, digest, revisit, refers_to, date)
                done.append(zlib.compress(data, 6, wbits=31) if compress else data)
                size += len(done[-1])
                if size >= archive_bytes:
                    yield archive()
                    done, size = [], 0
        if done:
            yield archive()

    archives = responses.unionByName(revisits).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0" if compress else "\n").option("maxRecordsPerFile", 1).text(path)


# --- reading ---------------------------------------------------------------


def _digest(field: str | None) -> str | None:
    """A digest field's SHA-1 as hex; None for another or unreadable one."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def _record(data: bytes, at: int, offset: int, length: int | None = None) -> Record:
    """The uncompressed record at ``data[at:]``; ``length`` is its member's, whose whole content it has to be."""
    if not data.startswith(VERSIONS, at):
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    last = None
    for line in data[at:head].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded field
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.strip().decode("utf-8", "replace")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("no type or record id")
    n = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", n):
        raise Damaged("no content length")
    end = head + 4 + int(n)
    if data[end : end + 4] != b"\r\n\r\n" or length is not None and end + 4 != len(data):
        raise Damaged("length")
    block = data[head + 4 : end]
    want = _digest(fields.get("warc-block-digest"))
    if want and hashlib.sha1(block).hexdigest() != want:
        raise Damaged("block digest")
    payload, size = block, len(block)
    digest = _digest(fields.get("warc-payload-digest"))
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if fields.get("warc-type") == "revisit":
            found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
            size = int(found[1]) if found else 0
    if fields.get("warc-type") != "revisit":
        real = hashlib.sha1(payload).hexdigest()
        if digest and digest != real:
            raise Damaged("payload digest")
        digest = real
    return Record(offset, end + 4 - at if length is None else length, fields, payload, size, digest)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, length) of the gzip member at ``data[at:]``."""
    view, out, pos, step = memoryview(data), [], at, 2048
    unpack = zlib.decompressobj(31)
    try:
        while not unpack.eof:
            piece = view[pos : pos + step]
            if not piece:
                raise Damaged("member cut off")
            out.append(unpack.decompress(piece))
            pos, step = pos + len(piece), min(2 * step, 1 << 20)
            if len(out) == 1 and out[0] and not (out[0].startswith(b"WARC/") or b"WARC/".startswith(out[0])):
                raise Damaged("member of something else")
    except zlib.error as e:
        raise Damaged("member checksum" if "check" in str(e) else "member data") from None
    return b"".join(out), pos - len(unpack.unused_data) - at


def _read(data: bytes, at: int) -> tuple[Record | None, int]:
    """(record, length) of what lies at ``data[at:]``; no record for an empty member."""
    if data.startswith(GZIP, at):
        content, length = _member(data, at)
        return (_record(content, 0, at, length) if content else None), length
    record = _record(data, at, at)
    return record, record.length


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All whole records of an archive and the gaps between them, in order; together with empty members they cover every byte."""
    at = 0
    while at < len(data):
        try:
            record, length = _read(data, at)
        except Damaged as e:
            reason, start = str(e), at
            record, length = None, 0
            for found in _START.finditer(data, at + 1):
                try:
                    record, length = _read(data, found.start())
                except Damaged:
                    continue
                if record:
                    at = found.start()
                    break
            else:
                at = len(data)
            yield Gap(start, at - start, reason)
        if record:
            yield record
        at += length


_OUT = "archive string, offset long, length long, warc_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record and per quarantined gap of the archives below ``path``.

    ``gap`` is null for records and says for a gap which check failed at its
    beginning; offset and length are in bytes of the archive. page_id and
    refers_to come from record ids that write_archives gives, else they are
    null. A revisit's payload_bytes and payload_digest are those of the full
    payload, by its header. Records repeated in an archive come as often as
    they are there. An archive is one row of Spark's binary source, so one task
    holds it whole: write_archives bounds it.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap", pa.string())])
    number = lambda name: int(m[1]) if (m := _ID.match(name or "")) else None

    def rows(archive: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield (archive, x.offset, x.length, None, None, None, None, None, None, None, None, x.reason)
            else:
                f = x.fields
                name = f.get("warc-record-id")
                yield (archive, x.offset, x.length, f.get("warc-type"), name, number(name), f.get("warc-target-uri"), x.payload_bytes, x.payload_digest, number(f.get("warc-refers-to")), x.payload if payloads else None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for row in rows(b.column(0)[i].as_py(), b.column(1)[i].as_py()):
                    held.append(row)
                    size += 200 + len(row[10] or b"")
                    if size > 4 << 20:
                        yield make(held)
                        held, size = [], 0
                if held:
                    yield make(held)

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("path", "content").mapInArrow(run, _OUT)


def records(rows: DataFrame) -> DataFrame:
    """The records of read_archives() without its gaps."""
    return rows.filter("gap IS NULL").drop("gap")


def gaps(rows: DataFrame) -> DataFrame:
    """The log of quarantined bytes: archive, offset, length and the failed check."""
    return rows.filter("gap IS NOT NULL").select("archive", "offset", "length", "gap")
