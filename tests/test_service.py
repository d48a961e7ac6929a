from __future__ import annotations

import io
import json
import threading
from collections import Counter
from contextlib import redirect_stdout
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tesserae.sources import service

KNOWN = {f"h{i:03}": (i, i * 2, i * 3) for i in range(200)}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = parse_qs(urlsplit(self.path).query)
            key = tuple(asked["info_hash"])
            with lock:
                asks[key] += 1
                first = asks[key] == 1
            if self.path.startswith("/refuses"):
                code, body = 403, []
            elif self.path.startswith("/flaky") and "h007" in key and first:
                code, body = 503, []
            elif self.path.startswith("/odd"):
                code, body = 200, {"error": "no"}
            else:
                code, body = 200, [{"info_hash": h, "seeders": KNOWN[h][0], "completed": KNOWN[h][1], "leechers": KNOWN[h][2], "peers": None} for h in key if h in KNOWN] + [{"info_hash": "not asked", "seeders": 1}]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    asks, lock = Counter(), threading.Lock()
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    http.asks = asks
    yield http
    http.shutdown()


@pytest.fixture
def read(spark, server):
    service.register(spark)
    server.asks.clear()
    return lambda path="all", **options: spark.read.format("catalogue_stats").options(url=f"http://127.0.0.1:{server.server_port}/{path}", **options).load()


def rows(df):
    return sorted((r.info_hash, r.seeders, r.completed, r.leechers) for r in df.collect())


def test_filters_become_requests(read, server):
    wanted = [f"h{i:03}" for i in range(100, 220)]
    df = read(batch=25).where(F.col("info_hash").isin(wanted) & (F.col("seeders") > 150))
    assert rows(df) == [(h, *KNOWN[h]) for h in wanted if h in KNOWN and KNOWN[h][0] > 150]
    assert sorted(map(len, server.asks)) == [20, 25, 25, 25, 25] and set(server.asks.values()) == {1}
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    assert "info_hash" in out.getvalue().split("PushedFilters")[1].split("\n")[0]
    assert df.rdd.getNumPartitions() == 5
    assert rows(read().where("info_hash = 'h003' and info_hash in ('h003', 'h004')")) == [("h003", *KNOWN["h003"])]
    assert rows(read().where("info_hash = 'none'")) == []
    assert rows(read().where("info_hash = 'h001' and info_hash = 'h002'")) == []


def test_only_the_failed_request_is_repeated(read, server):
    wanted = [f"h{i:03}" for i in range(20)]
    assert rows(read("flaky", batch=5).where(F.col("info_hash").isin(wanted))) == [(h, *KNOWN[h]) for h in wanted]
    assert {k[0]: n for k, n in server.asks.items()} == {"h000": 1, "h005": 2, "h010": 1, "h015": 1}


@pytest.mark.parametrize("path, options", [("refuses", {}), ("odd", {}), ("flaky", {"attempts": "1"})])
def test_failures_are_errors(read, path, options):
    with pytest.raises(Exception, match="403|no JSON array|503"):
        read(path, **options).where("info_hash = 'h007'").collect()


def test_bad_reads_are_refused(spark, read):
    with pytest.raises(Exception, match="needs a filter"):
        read().collect()
    with pytest.raises(Exception, match="needs the option url"):
        spark.read.format("catalogue_stats").load().where("info_hash = 'x'").collect()


def test_stream_polls_at_every_trigger(spark, read, server, tmp_path):
    for run in range(2):  # the second goes on from the checkpoint
        stream = spark.readStream.format("catalogue_stats").options(url=f"http://127.0.0.1:{server.server_port}/all", hashes="h001,h002,none", batch=2).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))
        try:
            for _ in range(300):
                if query.lastProgress and query.lastProgress["batchId"] >= 1 + 2 * run:
                    break
                query.awaitTermination(0.2)
        finally:
            query.stop()
    got = Counter(r[0] for r in spark.read.schema(service.STATS_SCHEMA).parquet(str(tmp_path / "out")).collect())
    assert set(got) == {"h001", "h002"} and got["h001"] == got["h002"] >= 3
