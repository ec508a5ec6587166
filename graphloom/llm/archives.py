"""ARC and WARC archives: writing, reading, and the conversion of the older to the newer.

An ARC archive begins with a version block, a record with the uri filedesc://..., whose first
line names the version. Version 1 has header lines of five fields (uri, IP, date, type,
length), version 2 of ten (result code, checksum, location, offset and file name before the
length). Lengths are declared, so the content of a record may hold anything. From each record
the converter synthesises what a WARC record needs besides: an identifier (a UUID of the
archive's path and the record's offset, so a task that runs again gives it again), an ISO
timestamp from up to 14 digits, the type (warcinfo for version blocks, response for HTTP,
else resource), and digests of block and payload. Of responses with equal payloads of
`least` bytes or more one stays a response; the others become revisits, which refer to it and
have its HTTP header only.

Archives are read file by file as streams (plain, or gzip of any number of members), and
written by Spark's own text writer, whose line separator is what stands between records, so
any store that Spark reaches will do and a lost task is written again. Archives of ARC are
cut at ARCHIVE_BYTES, those of WARC at ARCHIVE_RECORDS. Which record is the response is decided
from narrow rows (digest, length, place); payloads are never shuffled unless the revisits are
more than are sent to every executor.

Defined cases: a null payload is empty; a null or empty uri is `-`; white space and control
characters of a uri are percent-encoded; a null key is left out of the HTTP header, and is
read as null; equal keys and fully equal rows give records of their own, and of equal payloads
with equal keys the last place is the response; a payload of any bytes and length (up to what
one row of Spark holds) is whole; no rows give no archives, which are then read as no records.
A record that ends before its declared length is marked truncated. A header line that cannot
be read, or a version that is not known, is an error that names the archive and the offset.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, named, small

ARCHIVE_BYTES = 8 << 20
ARCHIVE_RECORDS = 2000
BATCH_BYTES = 4 << 20
#: Fixed by the formats: names of the header lines' fields by version, the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_END = b"\r\n\r\n"
KEY_FIELD = "X-Record-Key"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def _quoted(uri: str | None) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (uri or "-").encode())


# -- ARC -------------------------------------------------------------------------------


def _version_block(version: int, name: str, date: str) -> bytes:
    text = f"{version} 0 graphloom\n{ARC_FIELDS[version]}\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(text)}\n".encode() + text


def _arc_record(version: int, name: str, offset: int, uri: str | None, date: str, key: str | None, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}"]
    if key is not None:
        lines.append(f"{KEY_FIELD}: {quote(key, safe='')}")
    content = "\r\n".join(lines).encode() + HTTP_END + payload
    more = f" 200 {hashlib.md5(content).hexdigest()} - {offset} {name}" if version == 2 else ""
    return _quoted(uri) + f" 0.0.0.0 {date} text/html{more} {len(content)}\n".encode() + content


def write_arc(records: DataFrame, path: str, *, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records (version, uri, date of 14 digits, key, payload) as ARC archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, parts, sizes, made = TaskContext.get().partitionId(), {}, {}, 0

        def archive(version: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts.pop(version))], pa.binary())], names=["archive"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("version", "uri", "date", "key")]
            for version, uri, date, key, payload in zip(*columns, batch.column("payload"), strict=True):
                payload = payload.as_py() or b""
                if version in parts and sizes[version][1] + len(payload) > archive_bytes:
                    yield archive(version)
                if version not in parts:
                    name, made = f"{task:06d}-{made:06d}.arc", made + 1
                    parts[version] = [_version_block(version, name, date)]
                    sizes[version] = (name, len(parts[version][0]) + 1)
                name, offset = sizes[version]
                parts[version].append(_arc_record(version, name, offset, uri, date, key, payload))
                sizes[version] = (name, offset + len(parts[version][-1]) + 1)
        for version in list(parts):
            yield archive(version)

    rows = records.select(F.col("version").cast("int").alias("version"), "uri", "date", F.col("key").cast("string").alias("key"), F.col("payload").cast("binary").alias("payload"))
    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


@dataclass
class ArcRecord:
    at: int
    version: int
    uri: str
    date: str
    content_type: str
    content: bytes
    truncated: bool


def _stream(data: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def arc_records(data: bytes, path: str = "") -> Iterator[ArcRecord]:
    """The records of an archive, its version block first."""
    stream, at, version = _stream(data), 0, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        try:
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            length = int(text.rsplit(" ", 1)[1])
            if length < 0:
                raise ValueError(length)
            content = stream.read(length)
            if not version:
                version = int(content.split(b" ", 1)[0])
            fields = text.rsplit(" ", len(ARC_FIELDS[version].split(" ")) - 1)
            uri, _, date, kind = fields[:4]
        except (ValueError, KeyError, IndexError) as e:
            raise ValueError(f"{path}: no ARC header at {start}: {line[:200]!r}") from e
        yield ArcRecord(start, version, uri, date, kind, content, len(content) < length)
        at += len(content)


def timestamp(digits: str) -> str:
    """ISO form of an ARC date; missing digits are the first month, day, hour, minute, second."""
    if not re.fullmatch(r"\d{4,14}", digits):
        return "1970-01-01T00:00:00Z"
    d = digits[: len(digits) // 2 * 2] + "00000101000000"[len(digits) // 2 * 2 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _key(head: bytes) -> str | None:
    m = re.search(rb"(?im)^" + KEY_FIELD.encode() + rb":[ \t]*([^\r\n]*)", head)
    return unquote(m[1].decode()) if m else None


ARC_COLUMNS = "record_id string, kind string, uri string, date string, content_type string, key string, truncated boolean, payload_bytes long, payload_sha1 string, payload_sha256 string, place string"


def read_arc(spark: SparkSession, path: str, *, content: bool = True) -> DataFrame:
    """A row for each record of the archives: what a WARC record of it needs; with `content`
    its bytes too, as `head` (of HTTP, with the empty line) and `payload`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.bool_(), pa.int64()] + [pa.string()] * 3 + [pa.binary()] * 2 * content
        names = [c.split(" ")[0] for c in ARC_COLUMNS.split(", ")] + ["head", "payload"] * content
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in arc_records(data.as_py(), file):
                    http = r.content.startswith(b"HTTP/")
                    cut = r.content.find(HTTP_END) + len(HTTP_END) if http and HTTP_END in r.content else 0
                    head, payload = r.content[:cut], r.content[cut:]
                    kind = "warcinfo" if not r.at and r.uri.startswith("filedesc:") else "response" if http else "resource"
                    place = f"{file}#{r.at:020d}"
                    row = (str(uuid.uuid5(uuid.NAMESPACE_URL, place)), kind, r.uri, timestamp(r.date), "application/http; msgtype=response" if http else r.content_type, _key(head), r.truncated, len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest(), place)
                    rows.append((*row, head, payload) if content else row)
                    size += len(payload) * content + 500
                    if size > BATCH_BYTES:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    files = _files(spark, path)
    return files.mapInArrow(run, ARC_COLUMNS + ", head binary, payload binary" * content)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


# -- WARC ------------------------------------------------------------------------------


def revisits(records: DataFrame, *, prefer: Column, least: int) -> DataFrame:
    """(record_id, refers_to, refers_uri, refers_date) of responses whose payload, of `least`
    bytes or more, another response has: the one with the greatest `prefer`, then place."""
    same = ["payload_sha256", "payload_bytes"]
    rows = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    first = F.max(F.struct(prefer.alias("prefer"), "place", "record_id", "uri", "date")).alias("first")
    groups = rows.groupBy(*same).agg(first, F.count("*").alias("n")).where("n > 1")
    found = rows.select("record_id", *same).join(groups, same).where("record_id <> first.record_id")
    return found.select("record_id", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records with head, payload and the columns of `revisits` as WARC archives."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    maybe = lambda when, *lines: F.when(when, F.concat(*lines)).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", F.col("date")),
        maybe(F.col("kind") != "warcinfo", line("WARC-Target-URI", F.col("uri"))),
        maybe(F.col("kind") == "warcinfo", line("WARC-Filename", F.regexp_replace("uri", "^filedesc:/*", ""))),
        maybe(F.col("kind") == "response", line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1")))),
        maybe(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn("refers_to")), line("WARC-Refers-To-Target-URI", F.col("refers_uri")), line("WARC-Refers-To-Date", F.col("refers_date"))),
        maybe(F.col("truncated"), line("WARC-Truncated", F.lit("unspecified"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n\r\n"),
    )
    whole = records.withColumn("block", block).select(F.concat(header.cast("binary"), "block").cast("string"))
    whole.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def warc_records(data: bytes, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of an archive."""
    stream, at = _stream(data), 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        fields: dict[str, str] = {}
        while (text := stream.readline()).strip():
            at += len(text)
            name, _, value = text.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        at += len(text)
        if not line.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"{path}: no WARC record at {start}: {line[:200]!r}")
        block = stream.read(int(fields["content-length"]))
        at += len(block)
        yield fields, block


WARC_COLUMNS = "record_id string, record_type string, uri string, date string, key string, refers_to string, payload_bytes long, payload_digest string, sound boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives, without its block: length and bare SHA-1 of the
    payload that is there (null for revisits, whose payload is elsewhere). `sound` tells
    whether length and digests are those that the header declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_()]
        names = [c.split(" ")[0] for c in WARC_COLUMNS.split(", ")]
        bare = lambda v: v and v.removeprefix("<urn:uuid:").removesuffix(">")
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for fields, block in warc_records(data.as_py(), file):
                    http = block.startswith(b"HTTP/")
                    cut = block.find(HTTP_END) + len(HTTP_END) if http and HTTP_END in block else 0
                    kind, payload = fields.get("warc-type"), block[cut:]
                    sha1 = hashlib.sha1(payload).hexdigest()
                    sound = len(block) == int(fields["content-length"]) and fields.get("warc-block-digest") == f"sha1:{hashlib.sha1(block).hexdigest()}"
                    if kind == "response":
                        sound = sound and fields.get("warc-payload-digest") == f"sha1:{sha1}"
                    there = kind != "revisit"
                    rows.append((bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _key(block[:cut]), bare(fields.get("warc-refers-to")), len(payload) if there else None, sha1 if there else None, sound))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, WARC_COLUMNS)


def converted(spark: SparkSession, arc: str, warc: str, *, prefer: Column | None = None, least: int = 1000) -> None:
    """Write the records of the ARC archives below `arc` as WARC archives below `warc`."""
    facts = Saved(spark, "archives")
    seen = facts.save(read_arc(spark, arc, content=False))
    again = facts.save(revisits(seen, prefer=F.lit(0) if prefer is None else prefer, least=least))
    write_warc(read_arc(spark, arc).join(small(again), "record_id", "left"), warc)
    facts.drop_all()


def resolved(records: DataFrame) -> DataFrame:
    """Records of `read_warc`; revisits have length, digest and `refers_key` of the response
    that they refer to."""
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"), F.col("key").alias("refers_key"))
    own = [c for c in records.columns if c not in ("payload_bytes", "payload_digest")]
    out = records.where("record_type = 'revisit'").join(there, "refers_to", "left").select(*own, F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "refers_key")
    return records.where("record_type <> 'revisit'").select(*own, "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_key")).union(out)


def archived(pages: DataFrame, *, key: str, uri: str, payload: str, least: int = 1000, crawled: str = "20000101000000") -> DataFrame:
    """pages through archives and back: written as ARC of both versions, converted to WARC,
    read again; the rows of `resolved` for the pages' records, of which `key` is a number.
    Of equal payloads the record with the greatest key is the response."""
    spark = pages.sparkSession
    files, facts = Saved(spark, "archives"), Saved(spark, "archived")
    version = F.when(F.crc32(F.coalesce(named(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0, 1).otherwise(2)
    records = pages.select(version.alias("version"), named(uri).alias("uri"), F.lit(crawled).alias("date"), named(key).alias("key"), named(payload).alias("payload"))
    write_arc(records, f"{files.root}/arc")
    converted(spark, f"{files.root}/arc", f"{files.root}/warc", prefer=F.col("key").cast("long"), least=least)
    out = facts.save(read_warc(spark, f"{files.root}/warc").where("record_type <> 'warcinfo'"))
    files.drop_all()
    return resolved(out)
