"""The engine as one object: a store, an audit log, policies and inspectors, with the verbs that a client has."""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom import audit, context
from trustloom.frames import settle
from trustloom.functions import detect, embed, text, trust
from trustloom.functions.text import source_type_of
from trustloom.operators import capture as capturing, contradict, lifecycle, retrieve
from trustloom.operators.retrieve import Query
from trustloom.registry import flags
from trustloom.schema import complete
from trustloom.sources import files
from trustloom.store import Store

QUEUE = "candidate_id:string,source_ref:string,source_type:string,source:string,evidence:string,decision_key:string,value:string,supersedes_value:string,confidence:double,sensitivity:string,action:string,content:string,canonical:string,status:string"


class Engine:
    """Frames in, frames out; single values only where a caller names a single record."""

    def __init__(self, spark: SparkSession, root: str, *, store: Store | None = None, log=None, policies: list[tuple[str, Column]] = (), inspectors=(detect.inspect_poison, detect.inspect_sensitive),
                 now=lambda: datetime.now(UTC), given: dict[str, bool] | None = None):
        self.spark, self.root, self.now = spark, root, now
        self.store = store or Store(spark, f"{root}/store")
        self.log = log if log is not None else audit.Log(spark, f"{root}/audit")
        self.policies, self.inspectors, self.flags = list(policies), inspectors, given or flags()

    # -- the state as the operators take it

    def _now_s(self) -> Column:
        return F.lit(int(self.now().timestamp()))

    def records(self) -> DataFrame:
        r = embed.embed(self.store.hydrated())
        member = lambda name: F.get_json_object("metadata", f"$.{name}")
        return settle(r.withColumns({
            "created_s": F.unix_seconds("created_at"), "expires_s": F.unix_seconds("expires_at"), "n_contradicts": trust.unresolved(F.col("contradicts")).cast("long"), "trust": F.col("trust_score"),
            "correction": F.coalesce(member("correction"), member("correction_kind")), "corrections": member("corrections").try_cast("long"),
            "superseded_by": member("superseded_by"), "supersedes": trust.listed(member("supersedes"))}))

    def _save(self, after: DataFrame, before: DataFrame) -> None:
        """Write back rows whose trust, status, edges or lineage changed, and new ones."""
        meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
        lineage = F.map_filter(F.create_map(F.lit("superseded_by"), F.col("superseded_by"), F.lit("supersedes"), F.when(F.size("supersedes") > 0, F.to_json("supersedes")),
                                            F.lit("correction"), F.col("correction")), lambda k, v: v.isNotNull())
        merged = F.map_concat(F.map_filter(meta, lambda k, v: ~F.map_contains_key(lineage, k)), lineage)
        rows = after.withColumns({"metadata": F.when(F.size(lineage) > 0, F.to_json(merged)).otherwise(F.col("metadata")), "trust_score": F.col("trust"),
                                  "created_at": F.timestamp_seconds("created_s"), "embedding": F.col("embedding")})
        rows = rows.withColumn("updated_at", F.greatest("updated_at", "created_at"))
        state = ("trust_score", "status", "contradicts", "metadata", "content", "sensitivity")
        old = before.select("memory_id", F.struct(*[F.col(s) for s in state]).alias("_old"))
        changed = rows.join(old, "memory_id", "left").filter(F.col("_old").isNull() | ~F.struct(*[F.col(s) for s in state]).eqNullSafe(F.col("_old")))
        changed = complete(changed)
        self.store.put(changed)

    # -- verbs

    def create(self, rows: DataFrame) -> DataFrame:
        """Add records (content, source_type, source_ref, ...); returns them as they stand after evaluation and policy."""
        now = self.now()
        given = rows if "memory_id" in rows.columns else rows.withColumn("memory_id", F.uuid())
        moments = {m: F.lit(now) for m in ("created_at", "updated_at") if m not in rows.columns}
        path = f"{self.root}/staged-{uuid.uuid4().hex}"  # ids are settled once
        complete(given.withColumns(moments)).write.parquet(path)
        fresh, before = self.spark.read.parquet(path), self.records()
        new = embed.embed(fresh).withColumns({"created_s": F.unix_seconds("created_at"), "expires_s": F.unix_seconds("expires_at"), "trust": F.lit(0.0), "n_contradicts": F.lit(0).cast("long"),
                                             "correction": F.lit(None).cast("string"), "corrections": F.lit(None).cast("long"), "superseded_by": F.lit(None).cast("string"), "supersedes": F.array().cast("array<string>")})
        for step in self.inspectors:
            new = new.transform(step)
        after, events = lifecycle.create(new, before, self._now_s(), self.policies)
        self._save(after, before)
        if self.policies:
            self.log.record(events)
        ids = fresh.select("memory_id").collect() if fresh.count() <= 10_000 else None
        self.store._fs.delete(self.store._path(path), True)
        return self.store.hydrated() if ids is None else self.store.hydrated().filter(F.col("memory_id").isin([r[0] for r in ids]))

    def add(self, content: str, source_ref: str, source_type: str | None = None, scope: str = "global", scope_ref: str | None = None, sensitivity: str = "internal", tags=(), expires: str | None = None) -> dict:
        row = self.spark.createDataFrame([(content, source_ref, source_type, scope, scope_ref, sensitivity, list(tags), expires)],
                                         "content string, source_ref string, source_type string, scope string, scope_ref string, sensitivity string, tags array<string>, expires string")
        row = row.withColumn("source_type", F.coalesce("source_type", source_type_of(F.col("source_ref")))).withColumn("expires_at", text.expiry(F.col("expires"), F.lit(self.now()))).drop("expires")
        return self.create(row).first().asDict(recursive=True)

    def ingest_path(self, path: str, **where) -> tuple[DataFrame, DataFrame]:
        good, bad = files.path_records(self.spark, path, **where)
        return self.create(good.drop("chunk_index")), bad

    def query(self, queries: list[Query] | str, **spec) -> DataFrame:
        """Results of one question or several; one audit event each, also where a limit leaves nothing."""
        asked = [Query(uuid.uuid4().hex, queries, **spec)] if isinstance(queries, str) else list(queries)
        live = [q for q in asked if q.limit > 0]
        records = self.records()
        if not live:
            found, every = retrieve.retrieve(records.limit(0), [Query("none", "", limit=1)], self._now_s())
        else:
            found, every = retrieve.retrieve(records, live, self._now_s(), self.query_policies())
        self.log.record(retrieve.audit_events(found, every, asked))
        return found.select("query_id", "rank", "memory_id", "content", "relevance", F.col("rerank_trust").alias("trust"), "final_rank", "reasons")

    def query_policies(self):
        return [(name, lambda allowed=allowed: allowed) for name, allowed in self.policies]

    def get(self, memory_id: str) -> dict | None:
        row = self.store.hydrated().filter(F.col("memory_id") == memory_id).first()
        return row.asDict(recursive=True) if row else None

    def list(self, scope: str | None = None, scope_ref: str | None = None, status: str | None = None) -> DataFrame:
        return self.store.scan(scope=scope, scope_ref=scope_ref, status=status)

    def correct(self, memory_id: str, content: str) -> str:
        if self.get(memory_id) is None:
            raise KeyError(memory_id)
        new_id, before = str(uuid.uuid4()), self.records()
        change = self.spark.createDataFrame([(memory_id, new_id, content)], "memory_id string, new_id string, content string")
        after = lifecycle.correct(before, change, self._now_s())
        after = trust.signals(after.drop("trust"), self._now_s()).withColumn("trust", F.round("trust", 6))
        self._save(after, before)
        return new_id

    def resolve(self, old_id: str, new_id: str) -> None:
        for i in (old_id, new_id):
            if self.get(i) is None:
                raise KeyError(i)
        before = self.records()
        self._save(lifecycle.resolve(before, self.spark.createDataFrame([(old_id, new_id)], "old_id string, new_id string")), before)

    def delete(self, memory_id: str) -> None:
        self.store.soft_delete(memory_id)

    def explain(self, memory_id: str) -> dict:
        rows = self.records()
        mine = rows.filter(F.col("memory_id") == memory_id)
        if not mine.limit(1).count():
            raise KeyError(memory_id)
        listed = mine.select(F.explode("contradicts").alias("other_id"))
        read = contradict.read(rows)
        pairs = contradict.detect(contradict.as_side(read.filter(F.col("memory_id") == memory_id), "a").join(
            contradict.as_side(read, "b"), F.array_contains("a.contradicts", F.col("b.memory_id"))))
        edge = listed.select(F.lit(memory_id).alias("memory_id"), "other_id").join(
            pairs.select(F.col("b.memory_id").alias("other_id"), F.coalesce("conflict.reason", F.lit("no conflict")).alias("reason"), "confidence"), "other_id", "left")
        out = lifecycle.explain(rows, edge, self._now_s()).filter(F.col("memory_id") == memory_id).collect()
        first = out[0].asDict(recursive=True)
        drop = ("other_id", "other_status", "other_ref", "reason", "confidence")
        return {k: v for k, v in first.items() if k not in drop} | {
            "contradictions": [{"memory_id": r.other_id, "status": r.other_status, "source_ref": r.other_ref, "reason": r.reason, "confidence": r.confidence} for r in out if r.other_id]}

    def contradictions(self, memory_id: str | None = None) -> DataFrame:
        return contradict.listing(self.store.edges(), memory_id)

    # -- capture

    def _queue_path(self) -> str:
        return f"{self.root}/capture.json"

    def pending(self, status: str | None = None) -> DataFrame:
        rows = files.json_queue(self.spark, self._queue_path(), "candidates", QUEUE)
        return rows if status is None else rows.filter(F.col("status") == status)

    def _write_queue(self, rows: DataFrame) -> None:
        from trustloom.store import write_queue

        write_queue(rows.select(*[f.split(":")[0] for f in QUEUE.split(",")]), self._queue_path(), "candidates")

    def capture(self, path: str, source_type: str = "file") -> DataFrame:
        found = capturing.extract(files.transcripts(self.spark, path, self.root, source_type))
        self._write_queue(capturing.appended(self.pending(), found.select(*[f.split(":")[0] for f in QUEUE.split(",")])))
        return found

    def approve(self, candidate_ids: list[str] | None = None, scope_ref: str = "project", least: float = capturing.SAFE) -> int:
        """The named candidates, or all safe ones; returns how many were approved. A named one that cannot be approved raises."""
        queue = self.pending()
        which = capturing.safe(queue, least) if candidate_ids is None else F.col("candidate_id").isin(candidate_ids)
        after, new, gone = capturing.approved(queue, which)
        chosen = after.filter("status = 'approved'").count() - queue.filter("status = 'approved'").count()
        if candidate_ids is not None and chosen != len(set(candidate_ids)):
            raise ValueError("a candidate is unknown, not pending, or sensitive")
        if new.limit(1).count():
            self.create(new.drop("memory_id").withColumn("scope_ref", F.lit(scope_ref)))
        if gone.limit(1).count():
            before = self.records()
            self._save(lifecycle.outdate(before, gone), before)
        self._write_queue(after)
        return chosen

    def reject(self, candidate_id: str) -> None:
        if not self.pending().filter(F.col("candidate_id") == candidate_id).limit(1).count():
            raise KeyError(candidate_id)
        self._write_queue(capturing.rejected(self.pending(), F.col("candidate_id") == candidate_id))

    def clear_rejected(self) -> int:
        queue = self.pending()
        kept = capturing.cleared(queue)
        removed = queue.count() - kept.count()
        self._write_queue(kept)
        return removed

    # -- context and state

    def context_plan(self, root: str) -> dict:
        plan = context.plan(root, self.records(), self.now().isoformat())
        context.write_pending(root, plan)
        return plan

    def status(self) -> dict:
        counts = {r.status: r["count"] for r in self.store.table("records").groupBy("status").count().collect()}
        queue = {r.status: r["count"] for r in self.pending().groupBy("status").count().collect()}
        old = ("corrected", "disputed", "expired", "outdated", "superseded")
        return {"total": sum(counts.values()), "active": counts.get("active", 0), "deprecated": sum(counts.get(s, 0) for s in old), "deleted": counts.get("deleted", 0),
                "pending": queue.get("pending", 0), "rejected": queue.get("rejected", 0),
                "next": "review pending candidates" if queue.get("pending") else ("add records" if not counts else "query")}

    def doctor(self) -> tuple[str, list[dict]]:
        """(the worst of ok, warn, error; each check)."""
        checks = []

        def check(name, level, said):
            checks.append({"check": name, "level": level, "said": said})

        try:
            n = self.store.count()
            check("store", "ok", f"{n} records")
        except Exception as error:  # a health report says what is wrong
            check("store", "error", str(error).splitlines()[0])
        check("audit", "ok" if not isinstance(self.log, audit.Silent) else "warn", type(self.log).__name__)
        check("flags", "ok", ", ".join(k for k, v in self.flags.items() if v))
        check("folder", "ok" if os.access(self.root, os.W_OK) or "://" in self.root else "warn", self.root)
        order = ("ok", "warn", "error")
        return max((c["level"] for c in checks), key=order.index), checks


def discover(start: str) -> dict | None:
    """The nearest .trustloom/config.json above a folder; a relative root in it is beside the file."""
    at = os.path.abspath(start)
    while True:
        path = os.path.join(at, ".trustloom", "config.json")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            config["root"] = os.path.normpath(os.path.join(os.path.dirname(path), config.get("root", "data")))
            return config
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


def init_project(folder: str, name: str | None = None) -> dict:
    path = os.path.join(folder, ".trustloom", "config.json")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps({"project": name or os.path.basename(os.path.abspath(folder)), "root": "data"}, indent=2) + "\n")
    return discover(folder)


def build(spark: SparkSession, root: str, **parts) -> Engine:
    """An engine with the defaults, any part replaced by name."""
    os.makedirs(root, exist_ok=True) if "://" not in root else None
    return Engine(spark, root, **parts)
