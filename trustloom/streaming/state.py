"""Records kept as keyed state of a stream: confirmations add up, edges gather, and records expire when they are due.

Events are (memory_id, kind, ts, expires_at, other_id): `create` brings an expiry or none,
`confirm` counts, `link` names a record that contradicts, `delete` ends the record. What a
record is does not depend on the order in which its events come: late ones are taken in, up to
the watermark's delay, beyond which the engine drops them.
An event-time timer fires when the watermark passes the expiry, whether events come for
the record or not. Every change is a row; the last one of a record is what holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trustloom.frames import reachable
from trustloom.streaming.events import LATE

EVENT = "memory_id string, kind string, ts timestamp, expires_at timestamp, other_id string"
CHANGE = "memory_id string, turn long, status string, confirmations long, n_contradicts long"
STATE = "turn long, created boolean, deleted boolean, expired boolean, expires_ms long, confirmations long, others array<string>"
NEW = (0, False, False, False, None, 0, [])


def _status(created: bool, deleted: bool, expired: bool) -> str:
    return "deleted" if deleted else "unknown" if not created else "expired" if expired else "active"


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, created, deleted, expired, expires, confirmations, others = state.get if state.exists else NEW
    others = set(others)
    if state.hasTimedOut:
        expired = True
    for batch in [] if state.hasTimedOut else batches:
        due = batch.expires_at[(batch.kind == "create") & batch.expires_at.notna()]
        if len(due):
            first = min(int(t.timestamp() * 1000) for t in due)
            expires = first if expires is None else min(expires, first)
        created, deleted = created or bool((batch.kind == "create").any()), deleted or bool((batch.kind == "delete").any())
        confirmations += int((batch.kind == "confirm").sum())
        others |= set(batch.other_id[(batch.kind == "link") & batch.other_id.notna()])
    mark = state.getCurrentWatermarkMs()
    if expires is not None and not expired:
        expired = expires <= mark
    if expires is not None and not expired:
        state.setTimeoutTimestamp(expires)
    state.update((turn + 1, created, deleted, expired, expires, confirmations, sorted(others)))
    yield pd.DataFrame([(key[0], turn + 1, _status(created, deleted, expired), confirmations, len(others))], columns=["memory_id", "turn", "status", "confirmations", "n_contradicts"])


def changes(events: DataFrame, delay: str = LATE) -> DataFrame:
    """(memory_id, turn, status, confirmations, n_contradicts): a row each change of a record, by a stream of events."""
    reachable(events.sparkSession)
    seen = events.filter("memory_id is not null").withWatermark("ts", delay)
    return seen.groupBy("memory_id").applyInPandasWithState(_change, CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_change(rows: DataFrame) -> DataFrame:
    """What holds of every record, of the rows that `changes` has written."""
    last = F.max_by(F.struct("status", "confirmations", "n_contradicts"), "turn").alias("r")
    return rows.groupBy("memory_id").agg(last).select("memory_id", "r.*")


def settled(events: DataFrame, mark_s: int) -> DataFrame:
    """The same of a batch of events, when the watermark stands at `mark_s`."""
    of = lambda kind: F.col("kind") == kind
    out = events.filter("memory_id is not null").groupBy("memory_id").agg(
        F.bool_or(of("create")).alias("created"), F.bool_or(of("delete")).alias("deleted"), F.min(F.when(of("create"), F.unix_millis("expires_at"))).alias("expires"),
        F.count_if(of("confirm")).alias("confirmations"), F.count_distinct(F.when(of("link"), F.col("other_id"))).alias("n_contradicts"))
    status = F.when(F.col("deleted"), "deleted").when(~F.col("created"), "unknown").when(F.col("expires") <= mark_s * 1000, "expired").otherwise("active")
    return out.select("memory_id", status.alias("status"), "confirmations", "n_contradicts")
