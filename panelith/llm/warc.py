"""WARC archives with an index first.

Writing gives every record its own gzip member in an archive of the shared folder and, through Spark's commit protocol, an index
row with page, URL, file, offset, length, digest and type. A task that is run again writes another file; only files that the committed index names
count. Reading starts from the index: the selected records are sorted by file and offset, neighbouring ranges are read
together, and each record is inflated, parsed and checked against its digest.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes that with the least page is a response and the others are revisits.

Edge cases: a null html is an empty payload; a null URL leaves the target out; rows that repeat the least page of their
payload are all responses; a null page is a revisit if its payload has a page, else a response; an empty table gives
an empty index; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_BYTES, ARCHIVE_BYTES, GAP, RANGE = 100, 256 << 20, 64 << 10, 8 << 20
#: Repeated payloads that are broadcast (about 100 bytes each); of more only the hot ones are.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str):
    """The file system of a shared path and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:  # Hadoop's names of S3 are not pyarrow's
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _writer(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        out, name, at, no = None, None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first, key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_page", "digest")), strict=True):
                    payload = (html or "").encode()
                    revisit = first is not None and page_id != first
                    data = gzip.compress(record(page_id, url, payload, key, first, revisit, date), 4, mtime=0)
                    if out is None or at + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        if no == 0:
                            fs.create_dir(base, recursive=True)
                        name = f"part-{TaskContext.get().partitionId():06d}-{no:04d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, no = fs.open_output_stream(f"{base}/{name}", compression=None), 0, no + 1
                    out.write(data)
                    rows.append((page_id, url, name, at, len(data), key, "revisit" if revisit else "response"))
                    at += len(data)
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in ``folder``; returns the index, a table of the shared folder."""
    common.prepare(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = common.pick(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long")).withColumn("digest", F.sha2(body.cast("binary"), 256)).withColumn("n", F.octet_length(body))
    shared = rows.where(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).where("copies > 1 and first_page is not null")
    shared = common.materialize(shared, "payloads")
    # payloads of at least LEAST_BYTES and shorter ones never have one digest
    few = shared.agg(F.count("*"), F.sum("copies")).first()
    if few[0] <= BROADCAST_ROWS:  # pages are written where they were read
        joined = rows.join(F.broadcast(shared.drop("copies")), "digest", "left")
    else:
        joined = common.look_up(rows, shared, ["digest"], "copies", few[1])
    return common.materialize(joined.select("page_id", "url", "html", "first_page", "digest").mapInArrow(_writer(folder, date, archive_bytes), INDEX_SCHEMA), "warc-index")


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Neighbouring records of one file that are read together."""
    group: list[tuple] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP or row[1] + row[2] - group[0][1] > RANGE):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        name, file = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest")), strict=True))
            out: list[tuple] = []
            size = 0
            for group in _ranges(wanted):
                if group[0][0] != name:
                    if file is not None:
                        file.close()
                    name = group[0][0]
                    file = fs.open_input_file(f"{base}/{name}")
                start = group[0][1]
                data = file.read_at(max(o + n for _, o, n, _ in group) - start, start)
                for _, offset, length, digest in group:
                    fields, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    key = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = fields["WARC-Type"] == "revisit"
                    n = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                    if key != digest or not revisit and (hashlib.sha256(payload).hexdigest() != key or len(payload) != n):
                        raise ValueError(f"a record of {name} at {offset} does not match its digest")
                    page = fields.get("WARC-Page-ID")
                    refers = fields.get("WARC-Refers-To-Page")
                    out.append((page and int(page), n, key, fields["WARC-Type"], refers and int(refers), *((None if revisit else payload,) if payloads else ())))
                    size += len(payload) if payloads else 0
                if size > 4_000_000:
                    yield _record_batch(out, payloads)
                    out, size = [], 0
            yield _record_batch(out, payloads)
        if file is not None:
            file.close()

    return run


def _record_batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *((pa.binary(),) if payloads else ()))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(("payload",) if payloads else ())]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` selects, read back by coalesced byte ranges."""
    spark = index.sparkSession
    common.prepare(spark)
    stretch = F.floor(F.col("offset") / F.lit(16 << 20))
    order = index.select("file", "offset", "length", "digest").repartition(common.parallelism(spark), "file", stretch).sortWithinPartitions("file", "offset")
    return order.mapInArrow(_reader(folder, payloads), RECORD_SCHEMA + (", payload binary" if payloads else ""))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_page FROM p
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
