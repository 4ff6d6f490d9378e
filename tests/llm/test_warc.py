import gzip
import hashlib

from panelith.llm import common, warc

LONG = "<p>" + "same payload é " * 20 + "</p>"
ROWS = [(4, "http://a/x y", LONG, 1), (2, "http://b/\r\nX: 1", LONG, 1), (9, None, LONG, 1), (2, "http://b/", LONG, 1), (5, "http://c/", "short", 1), (6, "http://c/", "short", 1), (7, "u", None, 1), (8, "u", "", 1), (None, "n", LONG, 1), (None, "n", "x" * 200, 1), (11, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 30, 1)]
SCHEMA = "page_id long, url string, html string, digest int"


def expected():
    out = []
    for i, _, h, _ in ROWS:
        p = (h or "").encode()
        same = [j for j, _, k, _ in ROWS if (k or "").encode() == p and j is not None]
        first = min(same, default=None) if len(p) >= 100 else None
        revisit = first is not None and i != first
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(first if revisit else None)))
    return sorted(out)


def test_round_trip(spark):
    folder = common.new_path(spark, "warc")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    index = warc.write_archives(df, folder, archive_bytes=600)
    got = warc.read_records(index, folder, payloads=True).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected()
    html = {(r["page_id"]): bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(html[i] == (h or "").encode() for i, _, h, _ in ROWS if i in html)
    # a selection reads its own records only
    few = warc.read_records(index.where("page_id = 11"), folder).collect()
    assert [r["page_id"] for r in few] == [11]
    # the archives are plain WARC files
    fs, base = warc.file_system(folder)
    name = index.first()["file"]
    data = gzip.decompress(fs.open_input_file(f"{base}/{name}").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"X: 1\r\n" not in data
    assert warc.read_records(warc.write_archives(df.limit(0), common.new_path(spark, "warc")), folder).count() == 0


def test_many_repeated_payloads_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    folder = common.new_path(spark, "warc")
    got = warc.read_records(warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(3), folder), folder).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected()


def test_file_systems_by_scheme():
    from pyarrow import fs

    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x" and warc.file_system("/tmp/x")[1] == "/tmp/x"
    for scheme in ("s3a", "s3n", "s3"):
        found, inside = warc.file_system(f"{scheme}://bucket/folder?region=eu-west-1")
        assert isinstance(found, fs.S3FileSystem) and inside == "bucket/folder"


def test_ranges_join_neighbours():
    rows = [("a", 0, 10, ""), ("a", 10, 10, ""), ("a", 10 + warc.GAP + 21, 5, ""), ("b", 0, 5, "")]
    assert [len(g) for g in warc._ranges(rows)] == [2, 1, 1]
