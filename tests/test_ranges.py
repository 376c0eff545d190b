"""Ranges of archive files: merged requests, retries and sessions against a server that fails now and then."""

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from paraloom.sources import archives, ranges

KIND = "url string, location struct<filename:string,offset:long,length:long,mime:string>"
HEAD = "WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"


@pytest.fixture
def served():
    """Files by name, a log of (path, range, connection) and how many requests are dropped first."""
    files, log, drops = {}, [], []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            log.append((self.path, self.headers["Range"], self.headers["Connection"]))
            if drops and drops.pop():
                self.close_connection = True
                return
            body = files.get(unquote(self.path))
            if body is None:
                self.send_response(404)
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("Content-Length", str(len(body[a : b + 1])))
            self.end_headers()
            self.wfile.write(body[a : b + 1])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/crawl", files, log, drops
    server.shutdown()


def packed(records):
    """Members after one another, and their places."""
    data, places = b"", []
    for r in records:
        member = gzip.compress(r.encode())
        places.append((len(data), len(member)))
        data += member
    return data, places


def test_one_request_a_merged_range(spark, served):
    root, files, log, _ = served
    data, places = packed([f"{HEAD}page {i} " + "x" * i for i in range(40)])
    far = len(data) + (3 << 20)
    files["/crawl/seg/a b.gz"] = data + bytes(3 << 20) + gzip.compress(b"far away")
    files["/crawl/b.gz"] = data
    rows = [(f"u{i}", ("seg/a b.gz", *p, "text/html")) for i, p in enumerate(places)] + [(f"v{i}", ("b.gz", *p, None)) for i, p in enumerate(places) if i % 2]
    rows += [("w", ("seg/a b.gz", far, len(gzip.compress(b"far away")), None)), ("u3", rows[3][1]), ("other", rows[3][1]), ("bad", ("b.gz", 3, 20, None)), ("none", ("lost.gz", 0, 9, None)), ("nothing", (None, 0, 9, None)), ("empty", ("b.gz", 0, 0, None))]
    found = {r.url: r for r in ranges.read_ranges(spark.createDataFrame(rows, KIND).repartition(3), root).collect()}
    assert len(log) == 4 == len({(r.filename, r.range_start) for r in found.values()})
    assert len(found) == len(rows) - 3
    for i in range(40):
        assert bytes(found[f"u{i}"].record).decode() == f"{HEAD}page {i} " + "x" * i
        assert i % 2 == 0 or found[f"v{i}"].record == found[f"u{i}"].record
    assert bytes(found["w"].record) == b"far away" and found["other"].record == found["u3"].record
    assert bytes(found["bad"].record) == b"" == bytes(found["none"].record)


def test_spans_bound_a_range(spark):
    rows = [(f"u{i}", ("f", i * 100, 100, None)) for i in range(1000)]
    plan = ranges.planned(spark.createDataFrame(rows, KIND), span=10_000).collect()
    assert sorted((r.start, r.length, len(r.members)) for r in plan) == [(k * 10_000, 10_000, 100) for k in range(10)]
    assert len(ranges.planned(spark.createDataFrame(rows[::2], KIND), gap=99).collect()) == 500
    assert ranges.read_ranges(spark.createDataFrame([], KIND), "file:///nowhere").count() == 0


def test_repeats_restart_the_session(served):
    root, files, log, drops = served
    files["/crawl/f"] = b"0123456789"
    session = ranges.Session(root)
    fetch = ranges.patient(session, tries=3, pause=0)
    assert fetch("f", 2, 3) == b"234" and fetch("f", 0, 1) == b"0" and len(log) == 2
    drops += [True, True]
    assert fetch("f", 4, 2) == b"45" and len(log) == 5
    drops += [True] * 4
    assert fetch("f", 4, 2) == b"" and len(log) == 9 and log[-1][2] == "close"
    assert fetch("lost", 0, 1) == b"" and len(log) == 10
    drops += [True] * 3
    assert fetch("f", 8, 2) == b"89" and log[-1][2] == "close"


def test_archives_are_written_and_read_again(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://h/{i}", f"{HEAD}<p>{i} é") for i in range(50)] + [("http://h/none", None)], "url string, record string")
    root = f"file://{tmp_path}/archives"
    located = spark.createDataFrame(ranges.stored_archives(pages.repartition(4), root).collect(), KIND)
    found = ranges.read_ranges(located, root)
    body = archives.record_body(F.decode("record", "UTF-8"))
    assert {tuple(r) for r in found.where("length(record) > 0").select("url", body).collect()} == {(f"http://h/{i}", f"<p>{i} é") for i in range(50)}
    dump = [r.value for r in ranges.dumped(found, archives.MAGIC, html_only=True).collect()]
    assert sorted(dump) == sorted(f"{archives.MAGIC} http://h/{i}\n<p>{i} é\n" for i in range(50))
    assert found.select("filename", "range_start").distinct().count() == located.select("location.filename").distinct().count()
