"""Tools for agents over standard input and output: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
import sys

from trustloom.operators.retrieve import SEARCH_FLOOR, SEARCH_LIMIT, Query

TOOLS = [
    {"name": "memory_search", "description": "Search records by meaning, words and trust.",
     "inputSchema": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "scope": {"type": "string"}, "scope_ref": {"type": "string"}, "min_trust": {"type": "number"}, "limit": {"type": "integer"}}}},
    {"name": "memory_add", "description": "Add a record with its source.",
     "inputSchema": {"type": "object", "required": ["content", "source_ref"], "properties": {"content": {"type": "string"}, "source_ref": {"type": "string"}, "scope": {"type": "string"}, "scope_ref": {"type": "string"}, "sensitivity": {"type": "string"}}}},
    {"name": "memory_explain", "description": "Why a record is trusted as it is.", "inputSchema": {"type": "object", "required": ["memory_id"], "properties": {"memory_id": {"type": "string"}}}},
]


def memory_search(engine, query: str, scope=None, scope_ref=None, min_trust=None, limit=None) -> dict:
    floor, most = SEARCH_FLOOR if min_trust is None else min_trust, SEARCH_LIMIT if limit is None else limit
    found = engine.query([Query("search", query, scope, scope_ref, floor, limit=most)])
    return {"results": [r.asDict(recursive=True) for r in found.orderBy("rank").collect()]}  # `limit` rows


def memory_add(engine, content: str, source_ref: str, scope: str = "global", scope_ref=None, sensitivity: str = "internal") -> dict:
    return engine.add(content, source_ref, scope=scope, scope_ref=scope_ref, sensitivity=sensitivity)


def memory_explain(engine, memory_id: str) -> dict:
    return engine.explain(memory_id)


def resource(engine, uri: str):
    """memory://scope/SCOPE[/REF] lists records; memory://record/ID is one, with its explanation."""
    kind, _, rest = uri.removeprefix("memory://").partition("/")
    if kind == "record":
        record = engine.get(rest)
        if record is None:
            raise KeyError(rest)
        return {"record": record, "explanation": engine.explain(rest)}
    scope, _, ref = rest.partition("/")
    return {"records": [r.asDict(recursive=True) for r in engine.list(scope, ref or None).drop("embedding").limit(1000).collect()]}  # a report of 1,000 rows


CALLS = {"memory_search": memory_search, "memory_add": memory_add, "memory_explain": memory_explain}


def answer(engine, message: dict) -> dict | None:
    """The reply to a message, none to a notification."""
    method, params, mid = message.get("method"), message.get("params") or {}, message.get("id")
    if mid is None:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "trustloom", "version": "0.2"}}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            found = CALLS[params["name"]](engine, **(params.get("arguments") or {}))
            result = {"content": [{"type": "text", "text": json.dumps(found, default=str, sort_keys=True)}]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params["uri"], "mimeType": "application/json", "text": json.dumps(resource(engine, params["uri"]), default=str, sort_keys=True)}]}
        else:
            return {"jsonrpc": "2.0", "id": mid, "error": {"code": -32601, "message": f"unknown method {method}"}}
    except (KeyError, ValueError, TypeError) as error:
        return {"jsonrpc": "2.0", "id": mid, "error": {"code": -32602, "message": f"{type(error).__name__}: {error}"}}
    return {"jsonrpc": "2.0", "id": mid, "result": result}


def serve(engine, lines=None, out=None) -> None:
    out = out or sys.stdout
    for line in lines or sys.stdin:
        if line.strip():
            reply = answer(engine, json.loads(line))
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)
