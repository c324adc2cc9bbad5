"""Model versions: an index with the newest row of every (model, version), resolved by semantic version; flags choose components."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.text import semver_key
from trustloom.sources.files import json_queue
from trustloom.store import latest, write_queue

ENTRY = "model_id:string,task:string,version:string,metrics:map<string,double>,uri:string,sha256:string,size:bigint,created_at:string"
# fixed values
OPEN = ("local_store hybrid_retrieval basic_trust basic_contradiction mcp_server local_dashboard local_embedder reranker heuristic_reranker "
        "rule_contradiction basic_poison_detector basic_sensitive_detector deterministic_trust").split()
PAID = ("cloud_store cloud_auth workspaces teams audit_log policy_engine review_queue advanced_trust poisoning_detection pii_detection billing admin_console "
        "advanced_embeddings learned_reranker learned_contradiction advanced_poison_detection advanced_pii_model learned_trust_model model_serving hosted_inference model_analytics").split()


def registered(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new versions in place of those of the same model and version."""
    rows = index.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return latest(rows, ["model_id", "version"], F.struct("_age", "created_at")).drop("_age")


def newest(index: DataFrame) -> DataFrame:
    """The highest version of every model; what is no version takes no part."""
    keyed = index.withColumn("_key", semver_key(F.col("version"))).filter("_key is not null")
    return latest(keyed, ["model_id"], F.struct("_key", "version")).drop("_key")


def resolve(index: DataFrame, model_id: str, version: str | None = None) -> DataFrame:
    mine = index.filter(F.col("model_id") == model_id)
    return newest(mine) if version in (None, "latest") else mine.filter(F.col("version") == version)


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def index(self) -> DataFrame:
        return json_queue(self.spark, self.path, "versions", ENTRY)

    def register(self, new: DataFrame) -> None:
        write_queue(registered(self.index(), new), self.path, "versions")

    def resolve(self, model_id: str, version: str | None = None):
        rows = resolve(self.index(), model_id, version).collect()  # one row at most
        if not rows:
            raise KeyError(f"{model_id} {version or 'latest'}")
        return rows[0]


def flags(environ: dict | None = None, prefix: str = "TRUSTLOOM_") -> dict[str, bool]:
    """Open ones on and others off, unless the environment says otherwise."""
    environ = os.environ if environ is None else environ
    out = dict.fromkeys(OPEN, True) | dict.fromkeys(PAID, False)
    for name in out:
        said = environ.get(prefix + name.upper())
        if said is not None:
            out[name] = said.strip().lower() in ("1", "true", "yes", "on")
    return out


@dataclass
class Components:
    """Factories by task; another than the default is taken only where its flag is on and it is registered."""

    defaults: dict[str, Callable] = field(default_factory=dict)
    others: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    given: dict[str, bool] = field(default_factory=flags)
    made: dict[str, object] = field(default_factory=dict)

    def active(self, task: str) -> bool:
        return task in self.others and self.given.get(self.others[task][0], False)

    def get(self, task: str):
        if task not in self.made:
            self.made[task] = self.others[task][1]() if self.active(task) else self.defaults[task]()
        return self.made[task]


def serve(component: Callable[[DataFrame], DataFrame], inputs: DataFrame) -> DataFrame:
    """Run a component, a function of frames, over a frame of inputs."""
    return inputs.transform(component)
