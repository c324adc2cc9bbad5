"""Audit events: redaction of nested JSON, reduction of sensitive ones, and a JSON lines log."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.frames import reachable
from trustloom.sources.files import json_lines

# fixed values
REDACTED = "[REDACTED]"
KEYS = ("secret", "password", "passwd", "token", "apikey", "accesskey", "secretkey", "privatekey", "credential", "authorization", "auth", "key")
PROTECTED = ("secret", "pii")
_OTHER = re.compile("[^a-z0-9]")
LOG = "event string, query_id string, memory_id string, query string, sensitivity string, content string, reasons string, used_ids array<string>, rejected_ids array<string>, ts timestamp"


def secret_key(name: str) -> bool:
    plain = _OTHER.sub("", name.lower())
    return any(k in plain for k in KEYS)


def masked(value):
    """Values under keys that sound secret are masked at any depth."""
    if isinstance(value, dict):
        return {k: REDACTED if secret_key(str(k)) else masked(v) for k, v in value.items()}
    return [masked(v) for v in value] if isinstance(value, list) else value


def protected(payload) -> bool:
    return isinstance(payload, dict) and str(payload.get("sensitivity")).strip().lower() in PROTECTED


def reduced(event: dict) -> dict:
    """Masked; a sensitive event also loses its content, its nested memory all but id and reasons."""
    out = masked(event)
    if protected(event) or protected(event.get("memory")):
        if "content" in out:
            out |= {"content": REDACTED, "sensitivity_redacted": True}
        if isinstance(out.get("memory"), dict):
            out["memory"] = {k: out["memory"][k] for k in ("memory_id", "reasons") if k in out["memory"]} | {"content": REDACTED, "sensitivity_redacted": True}
    return out


def redact_events(events: DataFrame, column: str = "event") -> DataFrame:
    """events with the JSON objects of `column` redacted, keys sorted; nesting of any depth needs Python, batches come by Arrow.

    Text that is no JSON object becomes null.
    """

    reachable(events.sparkSession)

    def one(text):
        try:
            event = json.loads(text) if text else None
        except ValueError:
            return None
        return json.dumps(reduced(event), sort_keys=True) if isinstance(event, dict) else None

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            yield batch.set_column(k, column, pa.array([one(t) for t in batch.column(k).to_pylist()], pa.string()))

    return events.mapInArrow(run, events.schema)


def masked_map(members, keys=KEYS):
    """The same rule for a flat map column, in column functions."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    return F.transform_values(members, lambda k, v: F.when(F.exists(F.array(*map(F.lit, keys)), lambda s: plain(k).contains(s)), F.lit(REDACTED)).otherwise(v))


def reduced_columns(events: DataFrame) -> DataFrame:
    """Flat events (sensitivity, content, ...): the content of protected ones is replaced."""
    hit = F.lower(F.trim("sensitivity")).isin(*PROTECTED)
    hit = F.coalesce(hit, F.lit(False))
    return events.withColumn("content", F.when(hit & F.col("content").isNotNull(), REDACTED).otherwise(F.col("content"))).withColumn("sensitivity_redacted", hit & F.col("content").isNotNull())


class Log:
    """An append-only folder of JSON lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, events: DataFrame) -> None:
        """Append events, each a JSON object of its columns, redacted first."""
        rows = events.select(F.to_json(F.struct(*events.columns)).alias("event"))
        redact_events(rows).filter("event is not null").select(F.col("event").alias("value")).write.mode("append").text(self.path)

    def events(self, schema: str = LOG) -> DataFrame:
        return json_lines(self.spark, self.path, schema)


class Silent:
    def record(self, events: DataFrame) -> None:
        pass
