import gzip
import hashlib
import io
import urllib.parse

from tidewatch.llm import warc
from tidewatch.llm._common import fresh_path

BIG = "é" * 1_500_000
ROWS = [(1, "http://a/é x", "x" * 3000), (2, None, "x" * 3000), (3, "u", None), (4, "u", ""), (None, "u", "x" * 3000), (2, None, "x" * 3000), (5, "u", BIG), (6, "u", "small"), (7, "u", "small"), (8, "u", "a\r\n\r\nb")]


def test_round_trip_in_chunks(spark):
    pages = spark.createDataFrame([(*r, "d") for r in ROWS], "page_id long, url string, html string, record_type string")
    folder = fresh_path(spark, "warc")
    files = warc.write(pages, folder)
    chunks = warc.read(spark, files, folder).cache()
    big = sorted(chunks.filter("page_id = 5").collect(), key=lambda r: r.chunk)
    assert len(big) == 3 and b"".join(r.data for r in big) == BIG.encode() and all(len(r.data) <= warc.CHUNK_BYTES for r in big)
    assert [r.payload_digest is None for r in big] == [True, True, False]
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.record_table(chunks).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        again = i == 1
        want.append((i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    path = urllib.parse.urlparse(files.first().path).path
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_broken_archives():
    bad = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nX-Page-Id: 1\r\nX-Payload-Length: 9\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 9\r\n\r\nabc")
    try:
        list(warc.read_records(io.BytesIO(bad)))
    except (EOFError, ValueError):
        return
    raise AssertionError("a cut archive was read as whole")


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def independent_records(data):
    """Records by another way: gzip members one by one, header lines by http.client."""
    import http.client
    import zlib

    while data:
        z = zlib.decompressobj(31)
        raw = io.BytesIO(z.decompress(data))
        data = z.unused_data
        assert raw.readline() == b"WARC/1.1\r\n"
        head = http.client.parse_headers(raw)
        block = raw.read(int(head["Content-Length"]))
        assert raw.read() == b"\r\n\r\n"
        inner = io.BytesIO(block)
        assert inner.readline() == b"HTTP/1.1 200 OK\r\n" and head["Content-Type"] == "application/http; msgtype=response"
        http_head = http.client.parse_headers(inner)
        yield head, http_head, inner.read()


def test_archives_by_an_independent_parser(spark):
    import base64

    pages = spark.createDataFrame([(*r, "mine", "too") for r in ROWS], "page_id long, url string, html string, digest string, _first string")
    files = warc.write(pages, fresh_path(spark, "warc")).collect()
    records = [r for f in files for r in independent_records(open(urllib.parse.urlparse(f.path).path, "rb").read())]
    assert len(records) == len(ROWS) == sum(f.records for f in files)
    ids = {h["WARC-Record-ID"] for h, _, _ in records if h["WARC-Type"] == "response"}
    bodies = sorted(b for h, _, b in records if h["WARC-Type"] == "response")
    assert bodies == sorted((t or "").encode() for i, _, t in ROWS if i != 1)
    for head, http_head, body in records:
        if head["WARC-Type"] == "revisit":
            assert not body and head["WARC-Refers-To"] in ids and head["X-Refers-To-Page-Id"] == "2" and int(http_head["Content-Length"]) == 3000
        else:
            assert int(http_head["Content-Length"]) == len(body)
            assert base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")) == hashlib.sha1(body).digest()
