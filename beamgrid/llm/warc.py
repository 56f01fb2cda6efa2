"""WARC archives of pages: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own, so archives can be cut. A reading task has a byte range of one archive: it
scans it for the magic bytes of gzip, takes a place as a member only when a WARC header can be decoded there, and owns
the records whose first byte lies in its range, even where they end beyond it. After damaged bytes it scans on; what is
amiss in a record's headers is told in its column problem and stops nothing.

A page whose payload equals that of a page with a smaller id is written as a revisit: the HTTP header with the full
length stays, the body does not, WARC-Refers-To names the response.

Defined cases: a null payload is empty; pages with equal payload and id are all responses; a null id is never referred
to while another id has the payload, and such pages, if they are alone with a payload, are all responses; a null url is
written as about:blank; control characters in urls are percent-encoded; an empty table gives no archive and no row. Read
records: without a sound Content-Length the block is all that the member holds; ids that are no page's are null; a
digest by another algorithm is replaced by the payload's SHA-1, or kept as it is where a revisit has no payload; lengths that
a revisit does not tell are null; archives that are empty or hold other records give no row.
Columns beside id, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, read, scratch_path

MAGIC = b"\x1f\x8b\x08"
_ID = "urn:x-page:"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit of refers_to unless that is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives under out, of about archive_bytes at most; returns archive, n_records, n_bytes.

    Payloads of at least min_bytes that are equal are stored once.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    # only payloads that repeat are joined; counts and minima are combined before the shuffle
    repeated = rows.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "size", "first")
    # written, so that both sides of the join are plain shuffles and a very common payload can be split
    rows = rows.join(materialize(repeated, "repeated"), ["sha", "size"], "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, n, size, sink, done = TaskContext.get().partitionId(), 0, 0, 0, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    uri = f"{out}/part-{part:06d}-{k:04d}.warc.gz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                    sink, n, size = fs.open_output_stream(tmp), 0, 0
                member = record(row[0], row[1], row[2].encode(), row[3], date)
                sink.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    sink.close()
                    fs.move(tmp, path)
                    done.append((uri, n, size))
                    sink, k = None, k + 1
        if sink is not None:
            sink.close()
            fs.move(tmp, path)
            done.append((uri, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "n_records", "n_bytes"])

    return materialize(rows.mapInArrow(archive, "archive string, n_records long, n_bytes long"), "archives")


def _number(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch("[0-9]{1,18}", x) else None


def _sha1(named: str) -> str | None:
    """A digest field as upper-case base32, from base32 or hexadecimal; None if it is not a SHA-1."""
    kind, _, value = named.rpartition(":")
    if kind.lower() not in ("", "sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return value.upper() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _parse(data: bytes) -> dict | None:
    """Fields of a whole record; None if it is not a record of a page."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    problems = []
    length = _number(fields.get("content-length"))
    if length is None or length > len(rest):
        problems.append("no sound Content-Length")
    block = rest[:length] if length is not None else rest.removesuffix(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(m[1]) if (m := re.search(r":(-?\d{1,18})>?$", fields.get(x, ""))) else None
    named = fields.get("warc-payload-digest", "")
    if kind == "response":
        size, own = len(payload), digest(payload)
        if named and _sha1(named) not in (own, None):
            problems.append(f"the payload's digest is not {named}")
    else:
        full = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", http)
        size, own = int(full[1]) if full else None, _sha1(named) or named or None
        problems += [] if full else ["the revisit tells no length"]
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"), "payload_bytes": size, "payload_digest": own, "payload": payload, "problem": "; ".join(problems) or None}


class _Bytes:
    """An archive read forwards in blocks."""

    def __init__(self, f, at: int, block: int):
        self.f, self.at, self.block, self.held = f, at, block, bytearray()

    def more(self) -> bool:
        got = self.f.read_at(self.block, self.at + len(self.held))
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def _starts_record(data: bytes) -> bool | None:
    """Whether a member at the start of data opens with a WARC header; None: more bytes are needed."""
    if len(data) < 64:
        return None
    try:
        head = zlib.decompressobj(31).decompress(data[:4096], 16)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") if len(head) >= 7 else None if len(data) < 4096 else False


def records(f, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that start in [start, end)."""
    src = _Bytes(f, start, block)
    while src.at < end:
        at = src.held.find(MAGIC)
        if at < 0:
            src.drop(max(0, len(src.held) - 2))
            if not src.more():
                return
            continue
        src.drop(at)
        if src.at >= end:
            return
        while (good := _starts_record(src.held)) is None and src.more():
            pass
        if good is False or good is None and not _starts_record(src.held + b"\0" * 64):
            src.drop(1)
            continue
        press, out, used = zlib.decompressobj(31), [], 0
        try:
            while not press.eof:
                if used == len(src.held) and not src.more():
                    raise zlib.error("the archive ends inside a record")
                out.append(press.decompress(src.held[used:]))
                used = len(src.held)
        except zlib.error:
            src.drop(1)
            continue
        yield src.at, b"".join(out)
        src.drop(used - len(press.unused_data))


def archives(spark: SparkSession, uri: str) -> DataFrame:
    """archive, n_bytes: the archives in a folder."""
    fs, path = filesystem(uri)
    files = [x for x in fs.get_file_info(FileSelector(path, recursive=True, allow_not_found=True)) if x.path.endswith((".warc.gz", ".warc.gzip"))]
    scheme = uri.partition("://")[0] if "://" in uri else "file"
    return spark.createDataFrame([(f"{scheme}://{x.path}", x.size) for x in files], "archive string, n_bytes long")


def splits(listed: DataFrame, split_bytes: int) -> DataFrame:
    """archive, start, end: byte ranges of archives (archive, n_bytes)."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    return listed.select("archive", "n_bytes", cuts).select("archive", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))


def scan(spark: SparkSession, where: str | DataFrame, split_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder, or of those that a writer has listed, as RECORD; payload is null unless asked for."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.partition(" ")[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for archive, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(archive)
                rows, size = [], 0
                with fs.open_input_file(path) as f:
                    for at, data in records(f, start, end):
                        if (x := _parse(data)) is None:
                            continue
                        size += len(x["payload"]) if with_payload else 200
                        rows.append((*(x[n] for n in names[:6]), x["payload"] if with_payload else None, archive, at, x["problem"]))
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    cut = splits(archives(spark, where) if isinstance(where, str) else where, split_bytes)
    return cut.repartition(min(max(1, cut.count()), 20_000)).mapInArrow(load, RECORD)  # a task for each range


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page written and read back."""
    out = scratch_path(spark, "warc")
    written = write(read(spark, sf_dir, "pages"), out)
    return scan(spark, written, split_bytes=8 << 20, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 by DuckDB is hexadecimal; base32 takes it five bits at a time, from the binary text of its digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
             4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 >> j)))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
