import glob
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.llm import warc

BIG = "<p>WARC/1.1\r\n\r\nnot a record é</p>" * 5
PAGES = [
    (5, "http://A.example.com/x?y=1", BIG), (2, "http://a.example.com/x?y=1", BIG), (9, "no host", BIG), (3, "http://b.net", "small"),
    (4, "http://b.net", "small"), (6, None, None), (7, "http://b.net/\r\nX: y", ""), (2, "http://a.example.com/x?y=1", BIG), (None, "http://c.org", BIG),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = warc.capture_history(pages).collect()
    assert len(out) == len(PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    for r in out:
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        if html[r.page_id] == BIG:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 2 else ("revisit", 2))
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
    keys = [(r.urlkey, r.ts, r.page_id or -1) for r in out]
    assert keys == sorted(keys)
    assert out[0].__fields__[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {r.urlkey for r in out if r.page_id in (2, 5)} == {"com,example,a)/x?y=1"}


def test_global_order_over_many_files(spark):
    pages = spark.createDataFrame([(i, f"http://h{i * 7 % 13}.example.org/{i % 5}", f"page {i}") for i in range(300)], "page_id long, url string, html string").repartition(9)
    keys = [(r.urlkey, r.ts, r.page_id) for r in warc.capture_history(pages).collect()]
    assert keys == sorted(keys) and len(keys) == 300


def test_index_points_at_records(spark, tmp_path):
    """Each capture is fetched by archive, offset and length; archives end after archive_bytes; any gzip reader reads them whole."""
    path = str(tmp_path / "warc")
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"page {i} " + "é" * (i % 900)) for i in range(200)], "page_id long, url string, html string").repartition(2)
    warc.write_warc(pages, path, 4000)
    files = {"/".join(f.split("/")[-2:]): open(f, "rb").read() for f in glob.glob(path + "/*/part-*") if not f.endswith(".crc")}
    assert len(files) > 4 and all(len(data) < 6000 for data in files.values())
    assert sum(gzip.decompress(data).count(b"WARC-Type") for data in files.values()) == 200
    index = warc.merge_runs(warc.read_warc(spark.read.format("binaryFile").load(path))).collect()
    assert len(index) == 200
    for r in index:
        fields, body = warc.read_record(files[r.archive], r.offset, r.length)
        assert fields["warc-record-id"] == f"<urn:page:{r.page_id}>" and hashlib.sha256(body).hexdigest() == r.payload_digest


def test_long_records_and_cut_archives(spark, monkeypatch):
    """A record of several members; an archive without gzip; one that ends too early."""
    monkeypatch.setattr(warc, "MEMBER_BYTES", 50)
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n"
    plain, zipped = record(300) + record(0) + record(7), b"".join(warc.gzip_record(record(n)) for n in (300, 0, 7))
    assert [len(b) for _, _, _, b in warc.parse_warc(plain)] == [len(b) for _, _, _, b in warc.parse_warc(zipped)] == [300, 0, 7]
    for data in (plain, zipped):
        for offset, length, fields, _ in warc.parse_warc(data):
            assert next(warc.parse_warc(data[offset : offset + length]))[2] == fields
        with pytest.raises(ValueError):
            list(warc.parse_warc(data[:-1]))
    pages = spark.createDataFrame([(1, "http://a.b/", "é" * 100_000), (2, "http://a.b/" + "x" * 50_000, "y")], "page_id long, url string, html string")
    assert {r.page_id: r.payload_bytes for r in warc.capture_history(pages).collect()} == {1: 200_000, 2: 1}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60)), max_size=9), st.integers(1, 5))
def test_streaming_merge(runs, size):
    """Any runs in any block size; ties go by run and place."""
    rows = [[(str(v), 0, 0, str(k), i) for i, v in enumerate(sorted(r, key=str))] for k, r in enumerate(runs)]
    blocks = sorted((r[i : i + size] for r in rows for i in range(0, len(r), size)), key=lambda b: b[0])
    assert list(warc.merged(iter(blocks))) == sorted(sum(rows, []))


def test_merge_holds_a_block_of_each_run(monkeypatch):
    """A range of 200 000 captures in 4 runs: what a merge has read but not handed on stays under a few blocks."""
    monkeypatch.setattr(warc, "AHEAD", 4)
    total, read = 200_000, 0

    def blocks():
        nonlocal read
        for first in range(0, total, 64):
            read += 64
            yield [(f"{v:09d}", 0, 0, str(first // 64 % 4), v) for v in range(first, first + 64)]

    most = 0
    for k, _ in enumerate(warc.merged(blocks())):
        most = max(most, read - k)
    assert k + 1 == total and most <= 64 * 14


def test_empty(spark):
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    got = [x[0] for x in warc.LoserTree([iter([(v,) for v in sorted(r)]) for r in runs])]
    assert got == sorted(sum(runs, []))


def test_bad_archive():
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"HTTP/1.1\r\nx: y\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nx: y"))
