"""Candidates for records out of transcripts: sentences, rules, dedup, and their queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions import decisions, detect
from trustloom.functions.text import has_any

# fixed values
NAME = r"([A-Za-z][A-Za-z0-9_.+-]*)"
NAMES = r"([A-Za-z][A-Za-z0-9_.+-]*(?:\s+[A-Za-z][A-Za-z0-9_.+-]*)?)"
SPEAKER = r"(?i)^(user|assistant|codex|cursor|claude)\s*:\s*"
NOISE = r"(?i)\b(maybe|scratch|temporary|for now only|try this|experiment|not sure|could use|let's test|failed approach|did not work)\b"
RULE = r"(?i)\b(do not|don't|never|must not|avoid|prefer|always|must|should)\b"
DURABLE = ("dependency", "dependencies", "api", "llm", "secret", "store", "commit", "agent")
MOVED = rf"(?i)\bmoved\s+from\s+{NAME}\s+to\s+{NAME}\b"
INSTEAD = rf"(?i)\b(?:use|uses|using)\s+{NAMES}\s+instead\s+of\s+{NAMES}\b"
REPLACED = rf"(?i)\b(?:replaced|replace)\s+{NAME}\s+with\s+{NAME}\b"
TWO_DATABASES = rf"(?i)\blocal\s+dev\s+uses\s+{NAME}\s+but\s+production\s+uses\s+{NAME}\b"
DEPLOY = rf"(?i)\bdeploy\s+this\s+on\s+{NAME}\b"
DEAD = rf"(?i)\b(?:previous|old)\s+{NAME}\s+plan\s+is\s+(?:dead|outdated|deprecated)\b"
SHORTEST, SAFE = 8, 0.70
OMITTED = "Sensitive value omitted from captured transcript."
CONFIDENCE = {"databases": 0.90, "decision": 0.86, "deploy": 0.82, "dead": 0.78, "rule": 0.74, "replacement": 0.70, "omitted": 0.0}


def sentences(transcripts: DataFrame) -> DataFrame:
    """(source_ref, source_type, line, part, chunk) of transcripts (source_ref, source_type, text); lines from 1."""
    lines = transcripts.select("source_ref", "source_type", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]")).alias("at", "raw"))
    said = F.regexp_replace(F.regexp_replace("raw", r"^\s+|\s+$", ""), SPEAKER, "")
    parts = lines.select("source_ref", "source_type", (F.col("at") + 1).alias("line"), F.posexplode(F.split(said, r"(?<=[.!?])\s+")).alias("part", "piece"))
    return parts.select("source_ref", "source_type", "line", "part", F.regexp_replace("piece", r"^[ \-\t]+|[ \-\t]+$", "").alias("chunk")).filter(F.length("chunk") >= SHORTEST)


def supersedes_value(chunk: Column) -> Column:
    part = lambda pattern, g: F.nullif(F.regexp_extract(chunk, pattern, g), F.lit(""))
    return F.coalesce(part(MOVED, 1), part(INSTEAD, 2), part(REPLACED, 1))


def rewritten(chunk: Column) -> Column:
    """'moved from A to B' is read as a backend decision for B."""
    moved, deployed = F.regexp_extract(chunk, MOVED, 2), F.regexp_extract(chunk, DEPLOY, 1)
    return F.when(moved != "", F.concat(F.lit("Backend framework is "), moved, F.lit("."))).when(
        deployed != "", F.concat(F.lit("Deployment target is "), deployed, F.lit("."))).otherwise(chunk)


def content_of(key: Column, value: Column, old: Column) -> Column:
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    out = say(decisions.label(key), " is ", value, ".")
    plain = {"backend_framework": "The backend framework is ", "package_manager": "Package manager is ", "database_local": "Local database is ", "database_cloud": "Cloud database is ",
             "frontend_framework": "Frontend framework is ", "deployment_target": "Deployment target is ", "test_command": "The test command is "}
    for name, start in plain.items():
        out = F.when(key == name, say(start, value, ".")).otherwise(out)
    out = F.when((key == "backend_framework") & old.isNotNull(), say("The backend framework now uses ", value, " instead of ", old, ".")).otherwise(out)
    return F.when((key == "package_manager") & old.isNotNull(), say("The project now uses ", value, " instead of ", old, ".")).otherwise(out)


def extract(transcripts: DataFrame) -> DataFrame:
    """Candidates of every transcript, keep-first by (key, value or content, file name).

    A chunk with a secret gives an omitted row that holds none of it; noise gives nothing.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = sentences(transcripts).withColumn("secret", detect.contains_secret(F.col("chunk")))
    rows = rows.filter(F.col("secret") | ~F.col("chunk").rlike(NOISE))
    c = F.col("chunk")
    # worked out once, behind a generator: what reads it would else repeat it, and outgrow a compiled method
    read = F.struct(decisions.found(rewritten(c)).alias("decision"), decisions.trimmed(supersedes_value(c)).alias("old"))
    rows = rows.select("source_ref", "source_type", "line", "part", "chunk", "secret", F.explode(F.array(read)).alias("read")).select("*", "read.decision", "read.old").drop("read")
    old = F.col("old")

    def decided(key, value, confidence, old=none("string")):
        return F.struct(key.alias("decision_key"), value.alias("value"), old.alias("supersedes_value"), F.lit(confidence).alias("confidence") if isinstance(confidence, float) else confidence.alias("confidence"),
                        F.lit("internal").alias("sensitivity"), F.lit("memory").alias("action"), none("string").alias("content"))

    def said(key, value, confidence, tier, action, content):
        return F.struct(key.alias("decision_key"), value.alias("value"), none("string").alias("supersedes_value"), F.lit(confidence).alias("confidence"),
                        F.lit(tier).alias("sensitivity"), F.lit(action).alias("action"), content.alias("content"))

    part = lambda pattern, g: F.regexp_extract(c, pattern, g)
    dead = decisions.trimmed(part(DEAD, 1))
    made = F.when(F.col("secret"), F.array(said(none("string"), none("string"), CONFIDENCE["omitted"], "secret", "omit_sensitive", F.lit(OMITTED)))).when(
        c.rlike(TWO_DATABASES), F.array(decided(F.lit("database_local"), part(TWO_DATABASES, 1), CONFIDENCE["databases"]), decided(F.lit("database_cloud"), part(TWO_DATABASES, 2), CONFIDENCE["databases"]))).when(
        c.rlike(DEPLOY), F.array(decided(F.lit("deployment_target"), part(DEPLOY, 1), CONFIDENCE["deploy"]))).when(
        c.rlike(DEAD), F.array(said(F.lit("deprecated_value"), dead, CONFIDENCE["dead"], "internal", "mark_outdated", F.concat(dead, F.lit(" is deprecated/outdated."))))).when(
        F.col("decision").isNotNull(), F.array(decided(F.col("decision.key"), F.col("decision.value"),
                                                      F.when(F.col("decision.key") == "replacement", F.lit(CONFIDENCE["replacement"])).otherwise(F.lit(CONFIDENCE["decision"])), old))).when(
        c.rlike(RULE) & has_any(c, DURABLE), F.array(said(F.lit("coding_rule"), none("string"), CONFIDENCE["rule"], "internal", "coding_rule",
                                                        F.concat(F.regexp_replace(detect.redact(c), r"\.+$", ""), F.lit(".")))))
    rows = rows.withColumn("evidence", detect.redact(c)).select("source_ref", "source_type", "line", "part", "evidence", F.posexplode(made).alias("nth", "m"))
    rows = rows.select("source_ref", "source_type", "line", "part", "nth", "evidence", "m.*")
    # a decision's value is cleaned once, behind a generator, for the texts that name it
    memory, key_, value = F.col("action") == "memory", F.col("decision_key"), F.col("value")
    clean = F.when(memory, decisions.trimmed(detect.redact(value))).otherwise(value)
    rows = rows.select(*[c_ for c_ in rows.columns if c_ != "value"], F.explode(F.array(clean)).alias("value"))
    rows = rows.withColumns({"canonical": F.when(memory, F.concat(decisions.label(key_), F.lit(": "), value)).otherwise(F.col("content")), "content": F.when(memory, content_of(key_, value, F.col("supersedes_value"))).otherwise(F.col("content"))})
    rows = rows.withColumn("source", F.concat("source_ref", F.when(F.col("source_ref") != "", "#L").otherwise("L"), F.col("line").cast("string")))
    name = F.lower(F.regexp_extract(F.regexp_replace("source_ref", "#.*$", ""), r"([^/]*)$", 1))
    key = [F.coalesce("decision_key", F.lit("")), F.lower(F.coalesce(F.nullif("value", F.lit("")), "content")), name]
    # keep-first of one transcript's file; partial limit before the shuffle
    first = Window.partitionBy(*key).orderBy("source_ref", "line", "part", "nth")
    rows = rows.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    return rows.withColumn("candidate_id", F.sha2(F.concat_ws("\u0001", "source", "part", "nth", F.coalesce("decision_key", F.lit("")), "content"), 256)).withColumn("status", F.lit("pending"))


def safe(queue: DataFrame, least: float = SAFE) -> Column:
    c = F.col
    return (c("status") == "pending") & (c("confidence") >= least) & ~c("sensitivity").isin("secret", "pii") & ~detect.contains_secret(c("content")) & ~detect.contains_secret(c("evidence"))


def appended(queue: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if queue is None else queue.unionByName(new, allowMissingColumns=True)


def approved(queue: DataFrame, which: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, records to create, values to outdate). Only pending, not sensitive candidates can be approved."""
    c = F.col
    can = which & (c("status") == "pending") & ~c("sensitivity").isin("secret", "pii") & ~detect.contains_secret(c("content"))
    chosen = queue.filter(can)
    new = chosen.filter("action <> 'mark_outdated'").select(
        c("candidate_id").alias("memory_id"), "content", F.lit("file").alias("source_type"), c("source").alias("source_ref"), F.lit("project").alias("scope"),
        F.lit("internal").alias("sensitivity"), F.array(F.lit("capture")).alias("tags"),
        F.to_json(F.struct(c("candidate_id").alias("capture_candidate_id"), c("source_type").alias("capture_source_type"), c("evidence").alias("capture_evidence"),
                           "decision_key", c("value").alias("decision_value"), "supersedes_value")).alias("metadata"))
    gone = chosen.filter("action = 'mark_outdated'").select("value")
    return queue.withColumn("status", F.when(can, "approved").otherwise(c("status"))), new, gone


def rejected(queue: DataFrame, which: Column) -> DataFrame:
    return queue.withColumn("status", F.when(which, "rejected").otherwise(F.col("status")))


def cleared(queue: DataFrame) -> DataFrame:
    return queue.filter("status <> 'rejected'")
