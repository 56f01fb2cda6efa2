import base64
import gzip
import hashlib

import duckdb
import pytest

from beamgrid.llm import warc

ROWS = [(5, "http://a", "same", 1), (2, "http://b\n c", "same", 2), (9, None, None, 3), (8, "http://d", "", 4), (1, "http://e", "é" * 70_000, 5), (None, "x", "lone", 6), (None, "y", "same", 7), (2, "http://b", "same", 8), (3, "u", "WARC/1.1\r\n\r\n\x1f", 9)]
SCHEMA = "page_id long, url string, html string, record_type int"


def expected(rows, min_bytes=0):
    first = {}
    for k, _, h, _ in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    out = []
    for k, _, h, _ in rows:
        p = (h or "").encode()
        ref = first.get(h or "") if len(p) >= min_bytes else None
        ref = None if ref == k else ref
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


@pytest.mark.parametrize(("split", "min_bytes"), [(1 << 20, 0), (97, 0), (13, 2)])
def test_round_trip(spark, tmp_path, split, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    warc.write(pages, f"file://{tmp_path}/w", min_bytes=min_bytes, archive_bytes=300)
    back = warc.scan(spark, f"file://{tmp_path}/w", split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(ROWS, min_bytes)
    bodies = {(r.page_id, bytes(r.payload).decode()) for r in back if r.record_type == "response"}
    assert (1, "é" * 70_000) in bodies and (None, "lone") in bodies
    for f in (tmp_path / "w").glob("*.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_damaged_and_empty(spark, tmp_path):
    whole = b"".join(warc.record(i, "u", b"x" * i, None, "2024-01-01T00:00:00Z") for i in range(6))
    (tmp_path / "a.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + whole[:50] + b"\0" + whole + b"\x1f\x8b\x08")
    got = sorted(r.page_id for r in warc.scan(spark, f"file://{tmp_path}", split_bytes=40).collect())
    assert got == list(range(6))
    warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert warc.scan(spark, f"file://{tmp_path}/none").count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = warc.query(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(warc.SQL).fetchall())
    assert got.columns == [x[0] for x in c.sql(warc.SQL).description]


def member(*head, block=b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"):
    return gzip.compress("\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_foreign_and_broken_records(spark, tmp_path):
    sha = hashlib.sha1(b"abc")
    b32 = base64.b32encode(sha.digest()).decode()
    length = "Content-Length: 41"
    records = {
        "hex": member("WARC-Type: response", length, f"WARC-Payload-Digest: sha1:{sha.hexdigest()}"),
        "lower": member("warc-type: response", length, f"WARC-Payload-Digest: SHA1:{b32.lower()}"),
        "other": member("WARC-Type: response", length, "WARC-Payload-Digest: sha256:abc"),
        "wrong": member("WARC-Type: response", length, "WARC-Payload-Digest: sha1:" + "A" * 32),
        "endless": member("WARC-Type: response", "Content-Length: \u00b2"),
        "none": member("WARC-Type: response"),
        "revisit": member("WARC-Type: revisit", "Content-Length: 0", block=b""),
        "info": member("WARC-Type: warcinfo", length),
    }
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records.values()))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    got = warc.scan(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert len(got) == 7 and all(r.page_id is None for r in got)
    assert all((bytes(r.payload), r.payload_digest, r.payload_bytes) == (b"abc", b32, 3) for r in got[:6])
    assert [bool(r.problem) for r in got] == [False, False, False, True, True, True, True]
    assert (got[6].record_type, got[6].payload_bytes, got[6].payload_digest) == ("revisit", None, None)


def test_files_of_an_earlier_attempt_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    written = warc.write(pages, f"file://{tmp_path}/w", archive_bytes=300)
    (tmp_path / "w" / "part-999999-0007.warc.gz").write_bytes(warc.record(77, "u", b"left over", None, "2024-01-01T00:00:00Z"))
    assert warc.scan(spark, written).filter("page_id = 77").count() == 0 and warc.scan(spark, written).count() == len(ROWS)
