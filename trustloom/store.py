"""Records, kept as bucketed Parquet files behind a numbered log of manifests.

A commit is one manifest, log/<number>.json, that names the folder of every bucket of
every table; it is made whole beside the log and put in place only if no manifest of that
number is there. Readers take the highest number, so they see all of a commit or none of
it, records and edges alike, and go on reading its files whatever is committed meanwhile.
Files are never written twice. A writer that dies leaves files that no manifest names,
which `vacuum` removes.

Rows are dealt to buckets by their id; a change rewrites the buckets of its ids and reads
no others. A writer whose number is taken looks at what the others changed: where they
kept to other buckets, its own are put on top of theirs, else it does its work again on
what they left. So no change is lost, and checks (known ids, unknown ids) hold for the
state that a change is put on.

Within a bucket rows are sorted by scope, reference and status, and ids have a Bloom
filter, so that scans and lookups skip row groups. Edges and vectors are derived into the
records' columns `contradicts` and `embedding`.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from trustloom.schema import RECORD, complete, split_valid

EDGES = StructType([StructField("memory_id", StringType()), StructField("other_id", StringType()), StructField("detected_at", TimestampType()), StructField("reason", StringType())])
TABLES = {"records": RECORD, "edges": EDGES}
LAYOUT = {"records": ["scope", "scope_ref", "status", "memory_id"], "edges": ["memory_id", "other_id"]}
BUCKETS = 16  # of a new store; a store of terabytes wants thousands
ATTEMPTS = 20
CODEC = "zstd"  # of stored texts: less to write than Spark's own


class Conflict(RuntimeError):
    """Others kept changing the same buckets."""


class Log:
    """A folder's numbered manifests: the highest is what holds."""

    def __init__(self, spark: SparkSession, root: str, first: dict):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        if self.version() is None:
            if self._listed("data"):
                raise ValueError(f"{self.root} holds files but no log")
            self._publish({"version": 0, "did": "create"} | first)

    def _listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name in self._listed("log") if re.fullmatch(r"\d+\.json", name))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/log/{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _step(self, name: str) -> None:
        """Called between the steps of a change; tests stop writers here."""

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest in place, whole, unless its number is taken."""
        beside, target = (self._path(f"{self.root}/log/{name}") for name in (f".{uuid.uuid4().hex}", f"{manifest['version']:020d}.json"))
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        self._step("beside")
        try:
            return self._put_in_place(beside, target)
        finally:
            self._fs.delete(beside, False)

    def _put_in_place(self, beside, target) -> bool:
        if self._fs.getScheme() == "file":  # a local rename would replace what is there, a link does not
            try:
                os.link(*(p.toUri().getPath() for p in (beside, target)))
            except FileExistsError:
                return False
            return True
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), no_overwrite)
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        return True

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _named(self, manifest: dict) -> set[str]:
        """Names under data/ that a manifest reads."""
        raise NotImplementedError

    def vacuum(self, keep: int = 2, older_than_s: float = 86400) -> list[str]:
        """Drop manifests but the last `keep`, and folders that none of those names and that are older than a writer may need."""
        numbers = self.versions()
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{number:020d}.json"), False)
        named = {name for number in numbers[-keep:] for name in self._named(self.manifest(number))}
        gone = []
        for folder in ("data", "staged"):
            for name in self._listed(folder):
                path = self._path(f"{self.root}/{folder}/{name}")
                if name not in named and self._fs.getFileStatus(path).getModificationTime() / 1000 <= time.time() - older_than_s:
                    self._fs.delete(path, True)
                    gone.append(name)
        return gone


class Store(Log):
    def __init__(self, spark: SparkSession, root: str, id_pattern: str | None = None, buckets: int = BUCKETS):
        super().__init__(spark, root, {"buckets": buckets, "tables": {name: {} for name in TABLES}, "changed": {}})
        self.id_pattern, self.buckets = id_pattern, self.manifest()["buckets"]

    def _named(self, manifest: dict) -> set[str]:
        return {p.split("/")[1] for at in manifest["tables"].values() for p in at.values()}

    def _commit(self, did: str, change: Callable[[dict], dict[str, dict[str, str | None]] | None]) -> int:
        """Run `change` on the latest manifest and publish what it made: folders by table and bucket, None for no rows.

        It runs again where others changed buckets that it read. Returns the version that holds.
        """
        for _ in range(ATTEMPTS):
            base = self.manifest()
            made = change(base)
            if not made:
                return base["version"]
            self._step("written")
            touched = {bucket for buckets in made.values() for bucket in buckets}
            while True:
                tables = {name: {b: p for b, p in (base["tables"][name] | made.get(name, {})).items() if p} for name in TABLES}
                mine = base | {"version": base["version"] + 1, "tables": tables, "changed": {name: sorted(buckets) for name, buckets in made.items()}, "did": did}
                if self._publish(mine):
                    return mine["version"]
                last, kept = self.version(), set(self.versions())
                others = range(base["version"] + 1, last + 1)
                if any(v not in kept or touched & {b for buckets in self.manifest(v)["changed"].values() for b in buckets} for v in others):
                    break
                base = self.manifest(last)
        raise Conflict(f"{did}: {ATTEMPTS} attempts met others' changes")

    # -- scans

    def _bucket(self, memory_id: Column) -> Column:
        return (F.crc32(memory_id.cast("binary")) % self.buckets).cast("int")

    def _at(self, manifest: dict, name: str, buckets=None) -> DataFrame:
        paths = [f"{self.root}/{p}" for b, p in sorted(manifest["tables"][name].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as the latest commit, or an earlier one that is still kept, has it."""
        return self._at(self.manifest(version), name)

    def scan(self, *, scope: str | None = None, scope_ref: str | None = None, status: str | None = None) -> DataFrame:
        """Rows under optional equalities, deleted ones too; the filters reach the Parquet scan. In order of creation."""
        rows = self.table("records")
        for name, value in (("scope", scope), ("scope_ref", scope_ref), ("status", status)):
            if value is not None:
                rows = rows.filter(F.col(name) == value)
        return rows.orderBy("created_at", "memory_id")

    def get(self, memory_id: str) -> DataFrame:
        """The row of an id, deleted or not; no row for an unknown one. Only its bucket is read."""
        bucket = str(zlib.crc32(memory_id.encode()) % self.buckets)
        return self._at(self.manifest(), "records", {bucket}).filter(F.col("memory_id") == memory_id)

    def edges(self) -> DataFrame:
        return self.table("edges")

    def hydrated(self) -> DataFrame:
        """Records with `contradicts` gathered from the edges of the same commit, sorted."""
        at = self.manifest()
        linked = self._at(at, "edges").groupBy("memory_id").agg(F.array_sort(F.collect_set("other_id")).alias("contradicts"))
        rows = self._at(at, "records").drop("contradicts").join(linked, "memory_id", "left")
        return rows.withColumn("contradicts", F.coalesce("contradicts", F.array().cast("array<string>"))).select(*RECORD.fieldNames())

    def count(self) -> int:
        return self.table("records").count()

    # -- changes

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Checked rows, settled once; the first broken one raises."""
        folder = f"staged/{uuid.uuid4().hex}"
        complete(rows).withColumn("bucket", self._bucket(F.col("memory_id"))).write.option("compression", CODEC).parquet(f"{self.root}/{folder}")
        staged = self.spark.read.parquet(f"{self.root}/{folder}")
        _, bad = split_valid(staged, self.id_pattern) if self.id_pattern else split_valid(staged)
        twice = staged.groupBy("memory_id").count().filter("count > 1").select("memory_id", F.array(F.lit("stands twice")).alias("violations"))
        first = bad.select("memory_id", "violations").unionByName(twice).orderBy("memory_id").limit(1).collect()
        if first:
            self._drop(folder)
            raise ValueError(f"{first[0].memory_id}: {', '.join(first[0].violations)}")
        return staged, folder

    def _written(self, name: str, rows: DataFrame, buckets: set[str]) -> dict[str, str | None]:
        """Write whole buckets to a folder of their own; large buckets become several files."""
        laid = rows.select(*TABLES[name].fieldNames()).withColumn("bucket", self._bucket(F.col("memory_id"))).hint("rebalance", "bucket")
        return self._put_down(name, laid, buckets)

    def _replaced(self, old: DataFrame, new: DataFrame, buckets: set[str]) -> DataFrame:
        """old with new in place of the rows of its ids, dealt out by buckets; whole rows are sent once and not joined."""
        pieces = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(buckets)))
        both = old.withColumn("_new", F.lit(False)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(True)))
        both = both.withColumns({"bucket": self._bucket(F.col("memory_id")), "_piece": F.pmod(F.xxhash64("memory_id"), F.lit(pieces))}).repartition("bucket", "_piece")
        last = F.max("_new").over(Window.partitionBy("bucket", "_piece", "memory_id"))
        return both.withColumn("_last", last).filter("_new = _last").drop("_new", "_last", "_piece")

    def _put_down(self, name: str, laid: DataFrame, buckets: set[str]) -> dict[str, str | None]:
        """Write rows that were dealt out by bucket."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        laid = laid.sortWithinPartitions("bucket", *LAYOUT[name])
        laid.write.option("parquet.bloom.filter.enabled#memory_id", "true").option("compression", CODEC).partitionBy("bucket").parquet(f"{self.root}/{folder}")
        there = {n.split("=")[1] for n in self._listed(folder) if n.startswith("bucket=")}
        return {b: f"{folder}/bucket={b}" if b in there else None for b in buckets}

    def _changed(self, did: str, rows: DataFrame, refuse: str | None) -> None:
        """Put rows in place of those of their ids; of `refuse`, known or unknown ids raise. New ones keep the edges that others' changes gave them."""
        staged, folder = self._staged(rows)
        buckets = {str(r.bucket) for r in staged.select("bucket").distinct().collect()}  # no more than the store has

        def change(base):
            old, edges = self._at(base, "records", buckets), self._at(base, "edges", buckets)
            found = staged.join(old, "memory_id", "left_semi" if refuse == "known" else "left_anti").select("memory_id").limit(1).collect() if refuse else []
            if found:
                raise ValueError(f"{refuse} memory_id {found[0][0]}")
            made = staged.select("memory_id", F.explode("contradicts").alias("other_id")).distinct().join(edges, ["memory_id", "other_id"], "left").select(
                "memory_id", "other_id", F.coalesce("detected_at", F.current_timestamp()).alias("detected_at"), "reason")
            kept = edges if refuse == "known" else edges.join(staged.select("memory_id"), "memory_id", "left_anti")
            if refuse == "known":  # nothing to replace
                records = self._written("records", old.unionByName(staged.select(*old.columns)), buckets)
            else:
                records = self._put_down("records", self._replaced(old, staged, buckets), buckets)
            return {"records": records,
                    "edges": self._written("edges", kept.unionByName(made).dropDuplicates(["memory_id", "other_id"]), buckets)}

        try:
            if buckets:
                self._commit(did, change)
        finally:
            self._drop(folder)

    def add(self, rows: DataFrame) -> None:
        """Append valid rows of new ids; an id that is known or stands twice raises and nothing is written."""
        self._changed("add", rows, "known")

    def update(self, rows: DataFrame) -> None:
        """Replace whole rows of known ids, and all their edges; those that stay keep when they were found."""
        self._changed("update", rows, "unknown")

    def put(self, rows: DataFrame) -> None:
        """Replace rows of known ids and add the others, in one commit."""
        self._changed("put", rows, None)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Those rows whose ids the store does not have."""
        return rows.join(self.table("records").select("memory_id"), "memory_id", "left_anti")

    def soft_delete(self, which: str | DataFrame) -> None:
        """The status of an id, or of a frame's ids, becomes deleted and nothing else changes; unknown ids are passed over."""
        ids = self.spark.createDataFrame([(which,)], "memory_id string") if isinstance(which, str) else which.select("memory_id").distinct()
        buckets = {str(zlib.crc32(which.encode()) % self.buckets)} if isinstance(which, str) else {str(r[0]) for r in ids.select(self._bucket(F.col("memory_id"))).distinct().collect()}

        def change(base):
            old = self._at(base, "records", buckets)
            hit = old.join(ids, "memory_id", "left_semi").filter("status <> 'deleted'").select(self._bucket(F.col("memory_id")).alias("bucket")).distinct().collect()
            mine = {str(r.bucket) for r in hit}
            gone = self._at(base, "records", mine).join(ids.withColumn("_gone", F.lit(True)), "memory_id", "left")
            return mine and {"records": self._written("records", gone.withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))), mine)}

        self._commit("soft_delete", change)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by order; aggregates before it shuffles, so that a common key is no matter."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, order).alias("_r")).select("_r.*")


def packed(vector: Column) -> Column:
    """A vector as text, [a,b,...], with 32-bit numbers."""
    return F.to_json(vector.cast("array<float>"))


def unpacked(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def as_wire(records: DataFrame) -> DataFrame:
    """(memory_id, wire): a JSON object with ISO moments, without nulls left out."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    columns = [iso(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in records.schema.fields if f.name != "embedding"]
    return records.select("memory_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("wire"))


def from_wire(rows: DataFrame, column: str = "wire") -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD.fields if f.name != "embedding")
    return rows.select(F.from_json(column, fields).alias("r")).select("r.*")


def write_queue(rows: DataFrame, path: str, member: str) -> None:
    """One JSON file {member: [...]}, keys sorted, written beside and then moved. For queues, which are small."""
    import os
    import tempfile

    items = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns))).collect()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps({member: items}, indent=2, sort_keys=True) + "\n")
    os.replace(beside, path)
