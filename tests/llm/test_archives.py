"""Archives: round trips, hand-made ARC files, equal payloads against plain Python."""

from __future__ import annotations

import glob
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import archives, queries

LONG = "<p>same page</p>" * 80
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/ 2\n", LONG), (3, None, LONG), (4, "http://b/", "short"), (5, "http://b/5", "short"), (6, "", None), (7, "http://c", ""),
    (8, "filedesc://odd", LONG + "!"), (9, "http://ü/é", "x\r\n\r\nWARC/1.0\r\n\r\nfiledesc://z 0 0 0 5\n" * 40), (10, "u", "é" * 499), (11, "u", "é" * 499), (12, "u", "é" * 500), (13, "u", "é" * 500),
    (14, "u", "a" * 3_000_000), (15, "u", "\x00\x01\n" * 400),
]


def expected(pages):
    top, out = {}, []
    for k, _, text in pages:
        data = (text or "").encode()
        top[data] = max(top.get(data, k), k)
    for k, _, text in pages:
        data = (text or "").encode()
        again = len(data) >= 1000 and top[data] != k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[data] if again else None))
    return sorted(out)


def made(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    made(spark, PAGES).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.op11_arc_to_warc(spark, str(tmp_path)).collect())
    assert got == expected(PAGES)
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(duck.execute(queries.OP11_SQL).fetchall()) == got


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = made(spark, [(1, "u", LONG), (1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (None, "u", "z" * 2000), (None, "v", "z" * 2000)])
    got = sorted((tuple(r) for r in archives.archived(rows, key="page_id", uri="url", payload="html").select("key", "record_type", "refers_key").collect()), key=str)
    assert got == sorted([("1", "response", None), ("1", "revisit", "1"), ("1", "revisit", "1"), (None, "revisit", "1"), (None, "response", None), (None, "revisit", None)], key=str)
    assert archives.archived(rows.limit(0), key="page_id", uri="url", payload="html").count() == 0


def test_archives_of_both_versions(spark, tmp_path):
    records = made(spark, PAGES).select((F.col("page_id") % 2 + 1).alias("version"), F.col("url").alias("uri"), F.lit("19991231235959").alias("date"), F.col("page_id").alias("key"), F.col("html").alias("payload"))
    archives.write_arc(records, f"{tmp_path}/arc", archive_bytes=5000)
    files = glob.glob(f"{tmp_path}/arc/part-*.gz")
    assert len(files) > 3
    versions = set()
    for file in files:
        data = gzip.open(file).read()
        first, *rest = archives.arc_records(data)
        assert first.uri.startswith("filedesc://") and not first.truncated
        versions.add(first.version)
        for r in rest:
            assert data[r.at :].split(b"\n", 1)[1].startswith(r.content) and r.version == first.version
            assert first.version == 1 or f" {r.at} " in data[r.at :].split(b"\n", 1)[0].decode()
    assert versions == {1, 2}
    archives.converted(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", prefer=F.col("key").cast("long"))
    back = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert all(r.sound for r in back) and len({r.record_id for r in back}) == len(back)
    assert {r.date for r in back} == {"1999-12-31T23:59:59Z"}
    assert {r.record_type for r in back} == {"warcinfo", "response", "revisit"}
    uris = {int(r.key): r.uri for r in back if r.key}
    assert uris[2] == "http://a/%202%0A" and uris[3] == "-" and uris[8] == "filedesc://odd" and uris[9] == "http://ü/é"
    # what is stored of a record
    text = {}
    for file in glob.glob(f"{tmp_path}/warc/part-*.gz"):
        for fields, block in archives.warc_records(gzip.open(file).read()):
            text[fields["warc-record-id"]] = (fields, block)
    for fields, block in text.values():
        if fields["warc-type"] == "revisit":
            target, _ = text[fields["warc-refers-to"]]
            assert block.endswith(b"\r\n\r\n") and target["warc-payload-digest"] == fields["warc-payload-digest"] and target["warc-target-uri"] == fields["warc-refers-to-target-uri"]


def test_archives_from_elsewhere(spark, tmp_path):
    """Spaces in uris, short dates, DNS records, bytes that are no text, a record cut short."""
    block = b"1 0 Some Crawler\n" + archives.ARC_FIELDS[1].encode() + b"\n\n"
    png = bytes(range(256)) * 5
    web = b"HTTP/1.0 200 OK\r\nContent-Type: image/png\r\n\r\n" + png
    data = b"filedesc://old.arc 0.0.0.0 1996 text/plain %d\n" % len(block) + block
    data += b"\ndns:example.org 10.0.0.1 199608 text/dns 5\n1.2.3"
    data += b"\nhttp://example.org/a b 10.0.0.1 19960812101112 image/png %d\n" % len(web) + web
    data += b"\nhttp://example.org/cut 10.0.0.1 19960812 text/html 500\nHTTP/1.0 200 OK\r\n\r\nhalf"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc").write_bytes(data)
    half = len(data) // 2
    (tmp_path / "in" / "members.arc.gz").write_bytes(gzip.compress(data[:half]) + gzip.compress(data[half:]))
    archives.converted(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    back = archives.read_warc(spark, f"{tmp_path}/out").collect()
    assert all(r.sound for r in back)
    got = sorted((r.record_type, r.uri or "", r.date) for r in back)
    one = [("warcinfo", "", "1996-01-01T00:00:00Z"), ("resource", "dns:example.org", "1996-08-01T00:00:00Z"), ("response", "http://example.org/cut", "1996-08-12T00:00:00Z")]
    assert got == sorted([*one, *one, ("response", "http://example.org/a b", "1996-08-12T10:11:12Z"), ("revisit", "http://example.org/a b", "1996-08-12T10:11:12Z")])
    assert hashlib.sha1(png).hexdigest() in {r.payload_digest for r in back}
    cut = [f for p in glob.glob(f"{tmp_path}/out/part-*.gz") for f, _ in archives.warc_records(gzip.open(p).read()) if "warc-truncated" in f]
    assert len(cut) == 2


@pytest.mark.parametrize("bad", [b"no header\n", b"filedesc://x 0.0.0.0 1999 text/plain 4\n9 0 ", b"filedesc://x 0.0.0.0 1999 text/plain -4\n1 0 "])
def test_unreadable_headers_are_errors(bad):
    with pytest.raises(ValueError, match="no ARC header at 0"):
        list(archives.arc_records(bad, "x.arc"))
