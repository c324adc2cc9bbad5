"""A REST source of records, for servers that speak the same paths: /v1/memories, /v1/query, /v1/ingest/path, /v1/health.

`RemoteRecords` is a Python data source: pages are read by Spark tasks, each an Arrow batch;
`Remote` calls the other paths from the driver.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 30  # fixed value
FIELDS = ("memory_id", "content", "source_type", "source_ref", "scope", "scope_ref", "created_at", "updated_at", "trust_score", "sensitivity", "status", "confirmations")
SCHEMA = "memory_id string, content string, source_type string, source_ref string, scope string, scope_ref string, created_at string, updated_at string, trust_score double, sensitivity string, status string, confirmations long"


class Remote:
    def __init__(self, base: str, token: str | None = None, timeout: float = TIMEOUT):
        self.base, self.token, self.timeout = base.rstrip("/"), token, timeout

    def call(self, method: str, path: str, body: dict | None = None, **query):
        given = {k: v for k, v in query.items() if v is not None}
        url = f"{self.base}{path}" + ("?" + urllib.parse.urlencode(given) if given else "")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, headers, method=method)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            text = answer.read().decode()
        return json.loads(text) if text else None

    def health(self):
        return self.call("GET", "/v1/health")

    def add(self, **record):
        return self.call("POST", "/v1/memories", record)

    def get(self, memory_id: str):
        return self.call("GET", f"/v1/memories/{memory_id}")

    def list(self, scope: str | None = None, scope_ref: str | None = None, status: str | None = None):
        return self.call("GET", "/v1/memories", scope=scope, scope_ref=scope_ref, status=status)

    def correct(self, memory_id: str, content: str):
        return self.call("PATCH", f"/v1/memories/{memory_id}", {"content": content})

    def delete(self, memory_id: str):
        return self.call("DELETE", f"/v1/memories/{memory_id}")

    def contradictions(self, memory_id: str):
        return self.call("GET", f"/v1/memories/{memory_id}/contradictions")

    def query(self, text: str, **spec):
        return self.call("POST", "/v1/query", {"text": text} | spec)

    def ingest_path(self, path: str, **where):
        return self.call("POST", "/v1/ingest/path", {"path": path} | where)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        scopes = self.options.get("scopes")
        return [InputPartition(s) for s in scopes.split(",")] if scopes else [InputPartition(self.options.get("scope"))]

    def read(self, partition):
        got = Remote(self.options["base"], self.options.get("token")).list(partition.value, self.options.get("scope_ref"), self.options.get("status"))
        for row in got["memories"] if isinstance(got, dict) else got:
            yield tuple(row.get(f) for f in FIELDS)


class RemoteRecords(DataSource):
    """spark.dataSource.register(RemoteRecords); spark.read.format("remote_records").option("base", url).load()"""

    @classmethod
    def name(cls):
        return "remote_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
