import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources.paged import PagedFeatures

N = 103


class Service(BaseHTTPRequestHandler):
    """Features by offset; every third request fails, in one of several ways."""

    asked, fail, short, lock = [], True, False, threading.Lock()

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        with self.lock:
            self.asked.append(q)
            turn = len(self.asked)
        if self.fail and turn % 3 == 0:
            self.send_response(503 if turn % 2 else 200)
            self.end_headers()
            self.wfile.write(b'{"error": {"code": 500}}' if turn % 4 else b"<html>")
            return
        if "returnCountOnly" in q:
            body = {"count": N}
        else:
            first, size = int(q["resultOffset"]), int(q["resultRecordCount"])
            last = min(N, first + size) - (1 if self.short and first else 0)
            rows = range(first, last)
            body = {"features": [{"properties": {f: {"id": i, "name": None if i % 4 == 0 else f"n{i}", "v": i / 2}[f] for f in q["outFields"].split(",") if f in ("id", "name", "v")}, "geometry": {"type": "Point", "coordinates": [i, -i]} if q["returnGeometry"] == "true" else None} for i in rows]}
        self.send_response(404 if q["where"] == "missing" else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def service(spark):
    spark.dataSource.register(PagedFeatures)
    handler = type("Own", (Service,), {"asked": [], "lock": threading.Lock()})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield handler, f"http://127.0.0.1:{server.server_port}/query"
    server.shutdown()
    server.server_close()


def load(spark, url, schema, **options):
    return spark.read.format("features").schema(schema).options(url=url, page=10, wait=0.01, **options).load()


def test_all_pages_of_a_service_that_fails_at_times(spark, service):
    handler, url = service
    df = load(spark, url, "id long, name string, v double, geometry string", system=3310)
    assert df.rdd.getNumPartitions() == 11
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(i, None if i % 4 == 0 else f"n{i}", i / 2, json.dumps({"type": "Point", "coordinates": [i, -i]})) for i in range(N)]
    pages = [q for q in handler.asked if "resultOffset" in q]
    assert {q["outSR"] for q in pages} == {"3310"} and {int(q["resultOffset"]) for q in pages} == set(range(0, N, 10))
    slim = load(spark, url, "name string")
    assert slim.count() == N and {q["outFields"] for q in handler.asked[len(pages) + 5 :] if "outFields" in q} <= {"name", "id,name,v"}


def test_short_pages_and_refusals_are_errors(spark, service):
    handler, url = service
    handler.fail, handler.short = False, True
    with pytest.raises(Exception, match="where the count says"):
        load(spark, url, "id long").collect()
    with pytest.raises(Exception, match="404"):
        load(spark, url, "id long", where="missing").collect()
    with pytest.raises(Exception, match="no answer after 2 tries"):
        load(spark, "http://127.0.0.1:9/none", "id long", tries=2).collect()
    with pytest.raises(Exception, match="columns are"):
        load(spark, url, "id date").collect()
