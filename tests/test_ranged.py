"""Ranged downloads from a loopback server that cuts connections, knows no ranges, or goes away in between."""

import hashlib
import random
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veilspark.sources import ranged
from veilspark.streaming import progress

DATA = random.Random(0).randbytes(3_000_001)


class Files(BaseHTTPRequestHandler):
    def do_GET(self):
        s = self.server
        with s.lock:
            s.requests += 1
            n = s.requests
        if s.down and n > s.down:
            return self.send_error(503)
        data = b"" if "empty" in self.path else DATA
        m = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
        if m and not data:
            return self.send_error(416)
        ranges = m and "whole" not in self.path
        a, b = (int(m[1]), int(m[2]) + 1) if ranges else (0, len(data))
        body = data[a:b]
        self.send_response(206 if ranges else 200)
        self.send_header("Content-Length", str(len(body)))
        if ranges:
            self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
        self.end_headers()
        if "cut" in self.path and len(body) > 300_000 and n % 3:
            body = body[: random.Random(n).randint(1, len(body) - 1)]
        try:
            self.wfile.write(body)
        except OSError:
            return
        with s.lock:
            s.sent += len(body)
        self.close_connection = True

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Files)
    s.lock, s.requests, s.sent, s.down = threading.Lock(), 0, 0, 0
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


def joined(df):
    rows = df.orderBy("offset").collect()
    assert [r.offset for r in rows] == [sum(len(x.content) for x in rows[:i]) for i in range(len(rows))]
    return b"".join(bytes(r.content) for r in rows)


@pytest.mark.parametrize("path", ["/file", "/cut", "/whole", "/empty"])
def test_read(spark, server, path):
    df = ranged.read(spark, server.url + path, piece=700_000)
    expected = b"" if path == "/empty" else DATA
    assert hashlib.sha256(joined(df)).digest() == hashlib.sha256(expected).digest()
    assert df.rdd.getNumPartitions() == (1 if path == "/empty" else 5)


def test_resume(spark, server, tmp_path):
    folder = str(tmp_path / "kept")
    server.down = 4  # the size, and three pieces of a second job or so
    with pytest.raises(Exception, match="503"):
        ranged.fetch(spark, server.url + "/file", folder, 400_000, 2)
    done = ranged.kept(spark, folder).agg(F.sum(F.octet_length("content"))).first()[0]
    assert done and 0 < done < len(DATA)
    server.down, before = 0, server.sent
    df = ranged.fetch(spark, server.url + "/cut", folder, 400_000, 2)
    assert joined(df) == DATA and server.sent - before <= len(DATA) - done + 1 + 5 * 400_000
    before = server.sent
    assert joined(ranged.fetch(spark, server.url + "/file", folder, 400_000, 2)) == DATA and server.sent - before == 1
    chunks = df.select(F.lit(1).alias("download_id"), F.col("fetched").alias("ts"), F.octet_length("content").alias("bytes"), F.col("offset").alias("seq"))
    last = progress.progress(chunks).orderBy(F.desc("downloaded")).first()
    assert last.downloaded == last.total == len(DATA) and last.percent == 100
    with pytest.raises(Exception, match="503"):
        server.down = 1
        ranged.fetch(spark, server.url + "/file", str(tmp_path / "other"))


def test_a_server_that_is_gone(spark, server):
    server.down = 1
    with pytest.raises(Exception, match="503"):
        ranged.read(spark, server.url + "/file", piece=700_000).count()
