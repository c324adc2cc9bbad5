"""Command line: python -m trustloom.cli COMMAND ... ; --json prints rows as JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from trustloom import context
from trustloom.engine import build, discover, init_project


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trustloom")
    p.add_argument("--json", action="store_true")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, /, *arguments, **options):
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else str)

    command("init", name=None)
    for name in ("add", "remember"):
        command(name, "content", source="user://cli", scope="global", scope_ref=None, sensitivity="internal", expires=None)
    command("ingest", "path", scope=None, scope_ref=None)
    command("query", "text", scope=None, scope_ref=None, min_trust=0.0, max_sensitivity="internal", limit=5)
    command("show", "memory_id")
    command("list", scope=None, scope_ref=None, status=None)
    command("contradictions", memory_id=None)
    command("resolve", "old_id", "new_id")
    command("correct", "memory_id", "content")
    command("rm", "memory_id")
    command("capture-file", "path")
    command("capture-pending", status="pending")
    command("capture-approve", candidate_id=None, scope_ref="project", min_confidence=0.7)
    command("capture-reject", "candidate_id")
    command("capture-clear-rejected")
    command("context-generate")
    command("context-update")
    command("context-diff")
    command("context-approve")
    command("context-watch", interval=5.0, rounds=0)
    command("sync")
    command("status")
    command("doctor", strict=False)
    command("mcp")
    command("demo")
    return p


def demo(engine) -> list[dict]:
    """A transcript becomes candidates, these records, and a question finds the newest."""
    path = os.path.join(engine.root, "demo.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write("user: We moved from FastAPI to Flask.\nuser: Use pnpm instead of npm.\nuser: The API key is sk-test-1234567890abcdef.\n")
    engine.capture(path)
    engine.approve()
    return [r.asDict(recursive=True) for r in engine.query("What backend does the project use?").collect()]


def act(engine, a, root: str):
    """What a command gives: a frame, a dict, a list, text or nothing."""
    name = a.command
    if name in ("add", "remember"):
        return engine.add(a.content, a.source, scope=a.scope, scope_ref=a.scope_ref, sensitivity=a.sensitivity, expires=a.expires)
    if name == "ingest":
        where = {k: v for k, v in (("scope", a.scope), ("scope_ref", a.scope_ref)) if v is not None}
        good, bad = engine.ingest_path(a.path, **where)
        return {"records": good.count(), "failures": [r.asDict() for r in bad.limit(100).collect()]}
    if name == "query":
        return engine.query(a.text, scope=a.scope, scope_ref=a.scope_ref, min_trust=a.min_trust, max_sensitivity=a.max_sensitivity, limit=a.limit)
    if name == "show":
        return engine.explain(a.memory_id)
    if name == "list":
        return engine.list(a.scope, a.scope_ref, a.status).drop("embedding")
    if name == "contradictions":
        return engine.contradictions(a.memory_id)
    if name == "resolve":
        return engine.resolve(a.old_id, a.new_id)
    if name == "correct":
        return {"memory_id": engine.correct(a.memory_id, a.content)}
    if name == "rm":
        return engine.delete(a.memory_id)
    if name == "capture-file":
        return engine.capture(a.path)
    if name == "capture-pending":
        return engine.pending(a.status)
    if name == "capture-approve":
        return {"approved": engine.approve([a.candidate_id] if a.candidate_id else None, a.scope_ref, a.min_confidence)}
    if name == "capture-reject":
        return engine.reject(a.candidate_id)
    if name == "capture-clear-rejected":
        return {"removed": engine.clear_rejected()}
    if name in ("context-generate", "context-update"):
        return context.diff(engine.context_plan(root))
    if name == "context-diff":
        return context.status(root)["pending_diff"]
    if name == "context-approve":
        return context.approve(root)
    if name == "sync":
        engine.context_plan(root)
        return context.approve(root)
    if name == "context-watch":
        done = 0
        while not a.rounds or done < a.rounds:
            if context.diff(plan := engine.context_plan(root)):
                print("\n".join(f["path"] for f in plan["files"] if f["current"] != f["proposed"]))
            done += 1
            if not a.rounds or done < a.rounds:
                time.sleep(max(1.0, a.interval))
        return {"rounds": done}
    if name == "status":
        return engine.status() | {"context": context.status(root)["files"]}
    if name == "doctor":
        worst, checks = engine.doctor()
        if worst == "error" or (a.strict and worst == "warn"):
            raise SystemExit(json.dumps(checks))
        return checks
    if name == "mcp":
        from trustloom.server import serve

        return serve(engine)
    return demo(engine)


def shown(found, as_json: bool) -> None:
    if found is None:
        return
    if hasattr(found, "toJSON"):
        if not as_json:
            found.show(50, truncate=80)
            return
        found = [json.loads(line) for line in found.toJSON().toLocalIterator()]
    if isinstance(found, str):
        print(found)
    elif isinstance(found, list):
        for row in found:
            print(json.dumps(row, default=str, sort_keys=True))
    else:
        print(json.dumps(found, default=str, sort_keys=True))


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        shown(init_project(a.root, a.name), a.json)
        return 0
    config = discover(a.root) or init_project(a.root)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("trustloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        shown(act(build(spark, config["root"]), a, a.root), a.json)
    except (KeyError, ValueError, FileNotFoundError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
