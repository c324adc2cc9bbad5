"""The REST source against a small server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from trustloom.sources.remote import Remote, RemoteRecords

ROWS = [{"memory_id": f"m{k}", "content": f"c{k}", "scope": "repo" if k % 2 else "global", "trust_score": 0.5} for k in range(6)]


@pytest.fixture(scope="module")
def base():
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            path, _, query = self.path.partition("?")
            if path == "/v1/health":
                return self._send({"status": "ok"})
            if path == "/v1/memories":
                return self._send({"memories": [r for r in ROWS if "scope=" not in query or f"scope={r['scope']}" in query]})
            return self._send(next(r for r in ROWS if path.endswith(r["memory_id"])))

        def do_POST(self):
            self._send({"path": self.path, "body": json.loads(self.rfile.read(int(self.headers["Content-Length"])))})

        do_PATCH = do_POST

        def do_DELETE(self):
            self._send(None)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_calls(base):
    r = Remote(base, token="t")
    assert r.health() == {"status": "ok"} and len(r.list(scope="repo")) == 1 and r.get("m3")["content"] == "c3"
    assert r.query("x", limit=3) == {"path": "/v1/query", "body": {"text": "x", "limit": 3}} and r.add(content="y")["path"] == "/v1/memories"
    assert r.correct("m1", "z")["body"] == {"content": "z"} and r.delete("m1") is None and r.ingest_path("/p", scope="repo")["body"] == {"path": "/p", "scope": "repo"}


def test_frames(spark, base):
    from trustloom.frames import reachable

    reachable(spark)
    spark.dataSource.register(RemoteRecords)
    every = spark.read.format("remote_records").option("base", base).load()
    assert sorted(x.memory_id for x in every.collect()) == [r["memory_id"] for r in ROWS]
    some = spark.read.format("remote_records").option("base", base).option("scopes", "repo,global").load()
    assert some.count() == 6 and some.rdd.getNumPartitions() == 2
