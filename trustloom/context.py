"""Context files: what a project's records say, without secrets, in a managed block of a few Markdown files.

The sections are rows until the end: each is capped at `ITEMS` before anything comes to
the driver, so what is collected is bounded by the number of sections.
"""

from __future__ import annotations

import difflib
import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.frames import stored
from trustloom.functions import decisions, detect
from trustloom.functions.text import collapsed, has_any
from trustloom.operators.lifecycle import classified, lineage

# fixed values
FILES = ("AGENTS.md", "CLAUDE.md")
START, END = "<!-- trustloom:start -->", "<!-- trustloom:end -->"
ITEMS, COMMANDS, NOTES, READ, PARAGRAPH = 24, 18, 12, 80_000, 500
SECTIONS = ("Project Overview", "Tech Stack", "Commands", "Architecture", "Coding Rules", "Important Decisions", "Deprecated/Outdated Decisions", "Things Agents Must Avoid")
EMPTY = {
    "Tech Stack": ["Unknown. Add or ingest project metadata."], "Commands": ["Run the project-specific checks documented in README.md."],
    "Architecture": ["No architecture notes recorded yet."], "Coding Rules": ["Follow existing repository patterns and keep changes local-first."],
    "Important Decisions": ["No active decisions yet."], "Deprecated/Outdated Decisions": ["None recorded."],
    "Things Agents Must Avoid": ["Do not introduce external LLM/API dependencies into OSS local runtime paths.",
                                 "Do not store raw chat logs or secret values in generated context files.",
                                 "Do not cross the documented open-core boundary from OSS packages into commercial packages."],
}
TECH = ("backend_framework", "package_manager", "database", "database_local", "database_cloud", "frontend_framework", "deployment_target")
BUILT = ("backend_framework", "database", "database_local", "database_cloud", "frontend_framework", "deployment_target")
SHELL = ("uv ", "pnpm ", "npm ", "yarn ", "python ", "pytest ", "ruff ")


def memory_line(records: DataFrame, gave_way: DataFrame | None) -> DataFrame:
    """Add line: a decision's label and value with what became of it (of the lineage, if there is one), else the content; secrets cut, the source named."""
    c = F.col
    r = records.select("*", F.explode(F.array(decisions.found(c("content")))).alias("_d"))  # worked out once, however often it is named
    r = r.withColumn("_newer", F.lit(None).cast("string")) if gave_way is None else r.join(gave_way.select("memory_id", F.col("value").alias("_newer")), "memory_id", "left")
    source = F.when(F.coalesce("source_ref", F.lit("")) != "", F.concat(F.lit(" (source: "), detect.redact(c("source_ref")), F.lit(")"))).otherwise("")
    name, value = decisions.label(c("_d.key")), detect.redact(c("_d.value"))
    was = F.concat(name, F.lit(" was previously "), value, F.lit("; "))
    decided = F.when(c("status") == "superseded", F.concat(was, F.coalesce(F.concat(F.lit("superseded by "), detect.redact(c("_newer")), F.lit(".")), F.lit("superseded.")), source)).when(
        c("status") == "outdated", F.concat(was, F.lit("outdated."), source)).otherwise(F.concat(name, F.lit(": "), value, source))
    suffix = F.when(c("status") == "superseded", F.coalesce(F.concat(F.lit(" [superseded by "), c("superseded_by"), F.lit("]")), F.lit(" [superseded]"))).when(
        c("status") == "outdated", " [outdated]").otherwise("")
    return r.withColumn("line", F.when(c("_d").isNotNull(), decided).otherwise(F.concat(detect.redact(c("content")), source, suffix))).withColumnRenamed("_d", "decision").drop("_newer")


def section_rows(records: DataFrame) -> DataFrame:
    """(section, place, line): keep-first by the collapsed lower-cased line, at most `ITEMS` of a section.

    records: memory_id, content, source_ref, status, sensitivity, superseded_by, created_s
    """
    c = F.col
    # only superseded records look up what they gave way to, so that the others' texts are not dealt out
    gave_way, old = lineage(records), F.coalesce(c("status") == "superseded", F.lit(False))
    r = memory_line(classified(records.filter(~old)), None).unionByName(memory_line(classified(records.filter(old)), gave_way))
    key = c("decision.key")
    about = lambda *needles: has_any(c("content"), needles)
    within = lambda keys: F.coalesce(key.isin(*keys), F.lit(False))
    of = [
        ("Project Overview", c("active") & about("project", "product", "overview", "trustloom")),
        ("Tech Stack", c("active") & within(TECH)), ("Commands", c("active") & within(("test_command",))),
        ("Architecture", c("active") & (about("architecture", "package", "module", "api", "dashboard", "cli") | within(BUILT))),
        ("Coding Rules", c("active") & about("use ", "prefer", "must", "should", "rule", "test", "lint") & ~within(("package_manager", "test_command"))),
        ("Important Decisions", c("active")), ("Deprecated/Outdated Decisions", c("deprecated")), ("Things Agents Must Avoid", c("avoid")),
    ]
    digest = F.sha2(F.lower("line"), 256)
    some = lambda line: F.explode(F.filter(F.array(collapsed(line)), lambda x: x != "")).alias("line")
    sections = F.array_compact(F.array(*[F.when(w, F.lit(s)) for s, w in of]))
    told = r.select("created_s", "memory_id", sections.alias("_of"), some(c("line"))).select("created_s", "memory_id", digest.alias("_key"), F.explode("_of").alias("section"))
    note = F.concat(F.lit("Sensitive memory omitted from generated context."), F.when(F.coalesce("source_ref", F.lit("")) != "", F.concat(F.lit(" (source: "), detect.redact(c("source_ref")), F.lit(")"))).otherwise(""))
    hidden = classified(records).filter("omitted")
    notes = hidden.select("created_s", "memory_id", some(note)).select("created_s", "memory_id", digest.alias("_key"), F.lit("Important Decisions").alias("section"))
    every = told.withColumn("_late", F.lit(0)).unionByName(notes.withColumn("_late", F.lit(1)))
    # keep-first by the line's digest: whole lines are read again for those few that stay
    first = every.groupBy("section", "_key").agg(F.min(F.struct("_late", "created_s", "memory_id")).alias("f"))
    order = Window.partitionBy("section").orderBy("f", "_key")
    kept = stored(first.withColumn("place", F.row_number().over(order)).filter(c("place") <= ITEMS).select("section", "place", "_key", "f.*"))
    again = memory_line(records.join(F.broadcast(kept.select("memory_id").distinct()), "memory_id", "left_semi"), gave_way)
    lines = again.select("memory_id", F.explode(F.array(F.struct(F.lit(0).alias("_late"), "line"), F.struct(F.lit(1).alias("_late"), note.alias("line")))).alias("l"))
    lines = lines.select("memory_id", "l._late", collapsed(c("l.line")).alias("line")).withColumn("_key", digest)
    return kept.join(lines, ["memory_id", "_late", "_key"]).groupBy("section", "place").agg(F.min("line").alias("line"))


@dataclass
class Repo:
    name: str
    overview: str = ""
    tech: list[str] = field(default_factory=list)
    commands: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read(READ)
    except OSError:
        return ""


def unique(items) -> list[str]:
    out = {}
    for item in items:
        flat = " ".join(str(item).split())
        if flat:
            out.setdefault(flat.lower(), flat)
    return list(out.values())


def paragraph(text: str) -> str:
    """The first paragraph of prose: headings, markup, images and code apart."""
    got, code = [], False
    for line in map(str.strip, text.splitlines()):
        fence = line.startswith("```")
        code ^= fence
        if line.startswith("#") or fence:
            continue
        if not line or code or line.startswith(("<", "![")):
            if got:
                break
        else:
            got.append(line)
    return " ".join(got)[:PARAGRAPH]


def fenced_commands(text: str) -> list[str]:
    out, code = [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("```"):
            code = not code
        elif code and (command := line.removeprefix("$").strip()).startswith(SHELL):
            out.append(command)
    return out


def scan_repo(root: str) -> Repo:
    """What a few small files of a repository say; read on the driver."""
    at = lambda name: os.path.join(root, name)
    repo = Repo(os.path.basename(os.path.abspath(root)))
    readme = _read(at("README.md")) or _read(at("readme.md"))
    repo.overview = paragraph(readme)
    repo.commands += fenced_commands(readme)
    try:
        package = json.loads(_read(at("package.json")) or "{}")
    except ValueError:
        package = {}
    if isinstance(package, dict):
        repo.name = str(package.get("name") or repo.name)
        repo.commands += [f"pnpm {s}" for s in ("dev", "build", "test", "lint") if s in (package.get("scripts") or {})]
        needs = {**(package.get("dependencies") or {}), **(package.get("devDependencies") or {})}
        repo.tech += [d for d in ("react", "next", "vite", "typescript", "turbo") if d in needs]
    project = _read(at("pyproject.toml")).lower()
    if project:
        repo.tech += ["Python"] + [name for word, name in (("typer", "Typer CLI"), ("fastapi", "FastAPI")) if word in project]
        repo.commands += [command for word, command in (("pytest", "uv run pytest"), ("ruff", "uv run ruff check .")) if word in project]
        try:
            tomllib.loads(project)
        except tomllib.TOMLDecodeError:
            pass
    repo.tech += [name for file, name in (("pnpm-workspace.yaml", "pnpm workspace"), ("turbo.json", "Turborepo")) if os.path.isfile(at(file))]
    for name in ("docs/architecture.md", "docs/getting-started.md", "CONTRIBUTING.md"):
        text = _read(at(name))
        if said := paragraph(text):
            repo.notes.append(f"{name}: {said}")
        repo.commands += fenced_commands(text)
    repo.tech, repo.commands, repo.notes = unique(repo.tech), unique(repo.commands)[:COMMANDS], unique(repo.notes)[:NOTES]
    return repo


def _redacted(spark: SparkSession, items: list[str]) -> list[str]:
    if not items:
        return []
    rows = spark.createDataFrame(list(enumerate(items)), "k int, t string")
    return [r.t for r in rows.select("k", detect.redact(F.col("t")).alias("t")).orderBy("k").collect()]


def render(root: str, records: DataFrame, generated: str) -> str:
    spark, repo = records.sparkSession, scan_repo(root)
    of: dict[str, list[str]] = {s: [] for s in SECTIONS}
    for r in section_rows(records).orderBy("section", "place").collect():  # at most ITEMS of each section
        of[r.section].append(r.line)
    own = {"Project Overview": [repo.overview or f"{repo.name} project."], "Tech Stack": repo.tech, "Commands": repo.commands, "Architecture": repo.notes}
    lines = ["# Project Context", "", f"Generated: {generated}", ""]
    for section in SECTIONS:
        items = unique(_redacted(spark, own.get(section, [])) + of[section]) or EMPTY.get(section, [])
        lines += [f"## {section}", "", *(f"- {item}" for item in items[:ITEMS]), ""]
    return "\n".join(lines)


def in_block(current: str, body: str) -> str:
    """current with its managed block replaced, or with the block added at the end."""
    block = f"{START}\n{body}{END}\n"
    a, b = current.find(START), current.find(END)
    if 0 <= a < b:
        rest = current[b + len(END):]
        rest = rest[2:] if rest.startswith("\r\n") else rest.removeprefix("\n")
        return current[:a] + block + rest
    if not current:
        return block
    return current + ("" if current.endswith("\n") else "\n") + "\n" + block


def plan(root: str, records: DataFrame, generated: str) -> dict:
    body = render(root, records, generated)
    files = []
    for name in FILES:
        current = _read(os.path.join(root, name))
        files.append({"path": name, "current": current, "proposed": in_block(current, body)})
    return {"generated_at": generated, "files": files}


def diff(plan_: dict) -> str:
    parts = []
    for f in plan_["files"]:
        if f["current"] != f["proposed"]:
            parts += difflib.unified_diff(f["current"].splitlines(), f["proposed"].splitlines(), f"a/{f['path']}", f"b/{f['path']}", lineterm="")
    return "\n".join(parts) + ("\n" if parts else "")


def _state(root: str, name: str) -> str:
    return os.path.join(root, ".trustloom", name)


def write_pending(root: str, plan_: dict) -> None:
    os.makedirs(_state(root, ""), exist_ok=True)
    with open(_state(root, "pending.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps(plan_, indent=2, sort_keys=True) + "\n")


def pending(root: str) -> dict | None:
    try:
        with open(_state(root, "pending.json"), encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) and isinstance(found.get("files"), list) else None
    except (OSError, ValueError):
        return None


def approve(root: str) -> list[str]:
    """Write the changed files of the pending plan, then forget it and note when it was made."""
    plan_ = pending(root)
    if plan_ is None:
        raise FileNotFoundError("nothing is pending")
    changed = [f for f in plan_["files"] if f["current"] != f["proposed"]]
    for f in changed:
        path = os.path.join(root, f["path"])
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(f["proposed"])
    os.remove(_state(root, "pending.json"))
    with open(_state(root, "state.json"), "w", encoding="utf-8") as out:
        out.write(json.dumps({"last_sync_time": plan_["generated_at"]}, indent=2, sort_keys=True) + "\n")
    return [f["path"] for f in changed]


def status(root: str) -> dict:
    files = []
    for name in FILES:
        path, text = os.path.join(root, name), _read(os.path.join(root, name))
        files.append({"path": name, "exists": os.path.isfile(path), "managed": START in text and END in text, "size": os.path.getsize(path) if os.path.isfile(path) else 0})
    try:
        with open(_state(root, "state.json"), encoding="utf-8") as f:
            last = json.load(f).get("last_sync_time")
    except (OSError, ValueError):
        last = None
    waiting = pending(root)
    return {"files": files, "last_sync_time": last, "pending_files": [f["path"] for f in waiting["files"] if f["current"] != f["proposed"]] if waiting else [], "pending_diff": diff(waiting) if waiting else ""}
