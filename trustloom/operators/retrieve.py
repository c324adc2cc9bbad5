"""Two-stage retrieval for a stated set of queries: candidates, blend, rerank, policy, final order, audit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.frames import settle
from trustloom.functions import decisions, embed, text, trust
from trustloom.functions.detect import contains_secret
from trustloom.operators import search
from trustloom.schema import tier_rank

# fixed values
BLEND = (0.6, 0.3, 0.1)  # vector, keyword, recency
RELEVANCE = (0.6, 0.4)  # semantic, lexical
FINAL = (0.5, 0.5)  # relevance, trust
LEAST_RELEVANCE, LEAST_TRUST, ASKED = 0.1, 0.3, 0.98
EXCLUDED = ("expired", "deleted", "superseded", "outdated")
DEAD = ("deleted", "expired")
SEARCH_FLOOR, SEARCH_LIMIT = 0.5, 5


@dataclass(frozen=True)
class Query:
    query_id: str
    text: str
    scope: str | None = None
    scope_ref: str | None = None
    min_trust: float = 0.0
    max_sensitivity: str = "internal"
    limit: int = 10

    @property
    def pool(self) -> int:
        """How many candidates each signal and the first stage keep."""
        return max(5 * self.limit, self.limit + 20) if self.limit > 0 else 0


#: name, condition under which a record is allowed; the default allows all
Policy = tuple[str, Callable[[], Column]]


def query_frame(spark: SparkSession, queries: list[Query]) -> DataFrame:
    rows = [(q.query_id, q.text, q.scope, q.scope_ref, float(q.min_trust), q.max_sensitivity, int(q.limit), q.pool) for q in queries if q.limit > 0]
    return spark.createDataFrame(rows, "query_id string, query string, q_scope string, q_scope_ref string, min_trust double, max_sensitivity string, limit int, pool int")


def min_max(value: Column, group: str = "query_id") -> Column:
    """0 to 1 within the group; all alike count as 1."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), None).when(high <= low, F.lit(1.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def candidates(records: DataFrame, queries: list[Query]) -> DataFrame:
    """(query_id, memory_id, score): the strongest keyword score, if any, of each record that one of three signals found.

    The signals look at all records, deleted ones and those of other scopes too; their limits count them.
    """
    spark = records.sparkSession
    frame = F.broadcast(query_frame(spark, queries))
    most = max(q.pool for q in queries)
    asked = embed.embed(query_frame(spark, queries).select("query_id", "query"), "query")
    near = search.nearest(asked, records, most).join(frame.select("query_id", "pool"), "query_id").filter("rank <= pool")
    words = search.keyword(records, [(q.query_id, q.text) for q in queries if q.limit > 0], most).join(frame.select("query_id", "pool"), "query_id").filter("rank <= pool")
    newest = search.recent(records.select("memory_id", "created_s"), most)
    newest = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_s"), F.desc("memory_id"))))  # `most` rows
    newest = newest.join(frame.select("query_id", "pool"), F.col("rank") <= F.col("pool"))
    none = F.lit(None).cast("double").alias("score")
    every = near.select("query_id", "memory_id", none).unionByName(words.select("query_id", "memory_id", "score")).unionByName(newest.select("query_id", "memory_id", none))
    return every.groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))


def first_stage(records: DataFrame, queries: list[Query]) -> DataFrame:
    """Records of each query's pool with vector_sim, keyword_score, recency, first_stage and rank.

    records: memory_id, content, tags, cells, created_s, scope, scope_ref, ...
    """
    spark = records.sparkSession
    frame = query_frame(spark, queries)
    asked = embed.embed(frame, "query").withColumnRenamed("cells", "q_cells").drop("embedding")
    embed.check_width(records, embed.WIDTH, "cells")
    found = candidates(records, queries).join(F.broadcast(asked), "query_id").join(records, "memory_id")
    in_scope = (F.col("q_scope").isNull() | (F.col("scope") == F.col("q_scope"))) & (F.col("q_scope_ref").isNull() | (F.col("scope_ref") == F.col("q_scope_ref")))
    found = found.filter(F.coalesce(in_scope, F.lit(False))).withColumn("cosine", F.round(embed.cosine(F.col("cells"), F.col("q_cells")), 6))
    found = found.withColumns({
        "vector_sim": embed.vector_signal(F.col("cosine"), F.col("cells").isNotNull()),
        "keyword_score": F.coalesce(min_max(F.col("score")), F.lit(0.0)),
        "recency": min_max(F.col("created_s").cast("double")),
    })
    wv, wk, wr = BLEND
    found = found.withColumn("first_stage", F.round(wv * F.col("vector_sim") + wk * F.col("keyword_score") + wr * F.col("recency"), 9))
    order = [F.desc("first_stage"), F.desc("created_s"), F.desc("memory_id")]
    return settle(search.ranked(found, order, 1 << 30).filter(F.col("rank") <= F.col("pool")))


def rerank(found: DataFrame, now_s: Column) -> DataFrame:
    """Add relevance, rerank_trust, usable, rerank_reason and combined, by the whole pool."""
    c = F.col
    lexical = embed.jaccard(F.array_distinct(text.words(c("query"))), F.array_distinct(text.words(c("content"))))
    whole = lambda v: F.exists(v, lambda x: x != 0)
    meaning = embed.semantic(c("cosine"), c("cells").isNotNull() & whole(c("cells")) & whole(c("q_cells")))
    age, life = (now_s - c("created_s")) / 86400.0, (c("expires_s") - c("created_s")) / 86400.0
    ws, wl = RELEVANCE
    out = found.withColumns({
        "relevance": F.round(ws * meaning + wl * lexical, 9),
        "rerank_trust": F.round(trust.rerank_trust(c("trust"), trust.source_authority(c("source_type")), trust.freshness(age, life), trust.confirmation(c("confirmations")),
                                                   trust.contradiction_penalty(c("n_contradicts")), trust.sensitivity_penalty(c("sensitivity"))), 6),
    })
    usable = (c("relevance") >= LEAST_RELEVANCE) & (c("rerank_trust") >= LEAST_TRUST) & ~c("status").isin(*DEAD)
    out = out.withColumn("usable", usable).withColumn("combined", F.round(0.5 * c("relevance") + 0.5 * c("rerank_trust"), 10))
    parts = F.array_compact(F.array(
        F.when(c("relevance") >= 0.6, "strong relevance match").when(c("relevance") >= 0.25, "moderate relevance match")
        .when(c("relevance") > 0, "weak relevance match").otherwise("no relevance overlap"),
        F.concat(F.when(c("rerank_trust") >= 0.7, "high").when(c("rerank_trust") >= 0.4, "medium").otherwise("low"), F.lit(" trust")),
        F.when(c("n_contradicts") > 0, "has contradictions"),
        F.when(c("status").isin(*DEAD), F.concat(F.lit("excluded ("), c("status"), F.lit(")")))))
    return out.withColumn("rerank_reason", F.concat(F.array_join(parts, "; "), F.lit(" -> "), F.when(c("usable"), "surface memory").otherwise("skip memory")))


def judged(reranked: DataFrame, policies: list[Policy] = ()) -> DataFrame:
    """Add `rejected_by` (null where a row passes), boosted relevance and final_rank.

    Gates in order: another decision than the one asked for, usability, scope, status, secret
    content, sensitivity ceiling, trust floor, policies.
    """
    c = F.col
    out = reranked.withColumns({"asked": decisions.asked_keys(c("query")), "decision": decisions.found(c("content"))})
    about = (F.size("asked") > 0) & c("decision").isNotNull()
    same = about & F.array_contains("asked", c("decision.key"))
    gates = [
        ("intent", about & ~same), ("usability", ~c("usable")),
        ("scope", (c("q_scope").isNotNull() & ~c("scope").eqNullSafe(c("q_scope"))) | (c("q_scope_ref").isNotNull() & ~c("scope_ref").eqNullSafe(c("q_scope_ref")))),
        ("status", c("status").isin(*EXCLUDED)), ("secret", contains_secret(c("content"))),
        ("sensitivity", tier_rank(c("sensitivity")) > tier_rank(c("max_sensitivity"))), ("trust", c("rerank_trust") < c("min_trust")),
        *[(name, ~F.coalesce(allowed(), F.lit(False))) for name, allowed in policies],
    ]
    rejected = F.lit(None).cast("string")
    for name, bad in reversed(gates):
        rejected = F.when(bad, F.lit(name)).otherwise(rejected)
    wr, wt = FINAL
    out = out.withColumn("rejected_by", rejected).withColumn("intent", same)
    out = out.withColumn("relevance", F.when(same, F.greatest(c("relevance"), F.lit(ASKED))).otherwise(c("relevance")))
    return out.withColumn("final_rank", F.round(wr * trust.clamp01(c("relevance")) + wt * trust.clamp01(c("rerank_trust")), 10))


def reasons() -> Column:
    c = F.col
    intent = F.when(c("intent"), F.concat(F.lit("answers "), decisions.label(c("decision.key")), F.lit("; "))).otherwise(F.lit(""))
    return F.array_compact(F.array(
        F.concat(intent, c("rerank_reason")), F.concat(F.lit("source: "), c("source_ref")),
        F.concat(F.lit("trust "), text.two_places(c("rerank_trust")), F.lit(" >= min_trust "), text.two_places(c("min_trust"))),
        F.concat(F.lit("sensitivity '"), c("sensitivity"), F.lit("' within ceiling '"), c("max_sensitivity"), F.lit("'")),
        F.when(c("q_scope").isNotNull(), F.concat(F.lit("in scope "), c("scope"), F.lit("/"), F.coalesce("scope_ref", F.lit("-"))))))


def results(passed: DataFrame) -> DataFrame:
    """Rows that no gate rejected, by final_rank, then combined, then id; `limit` of each query."""
    order = [F.desc("final_rank"), F.desc("combined"), "memory_id"]
    kept = search.ranked(passed.filter("rejected_by is null").drop("rank"), order, 1 << 30).filter(F.col("rank") <= F.col("limit"))
    return kept.withColumn("reasons", reasons())


def retrieve(records: DataFrame, queries: list[Query], now_s: Column, policies: list[Policy] = ()) -> tuple[DataFrame, DataFrame]:
    """(results, every judged candidate). Queries with a limit under 1 give no rows."""
    every = judged(rerank(first_stage(records, queries), now_s), policies)
    return results(every), every


def audit_events(found: DataFrame, every: DataFrame, queries: list[Query]) -> DataFrame:
    """One row a query, those without results included: used ids, their reasons, rejected ids, the query itself as JSON."""
    spark = every.sparkSession
    asked = spark.createDataFrame([(q.query_id, q.text, json.dumps({"scope": q.scope, "scope_ref": q.scope_ref, "min_trust": q.min_trust,
                                                                  "max_sensitivity": q.max_sensitivity, "limit": q.limit})) for q in queries], "query_id string, query string, spec string")
    used = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "memory_id", "reasons"))).alias("used"))
    rejected = every.filter("rejected_by is not null").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("memory_id", "rejected_by"))).alias("rejected"))
    out = asked.join(used, "query_id", "left").join(rejected, "query_id", "left")
    return out.select(F.lit("retrieval_query").alias("event"), "query_id", "query", "spec",
                      F.coalesce(F.transform("used", lambda x: x["memory_id"]), F.array().cast("array<string>")).alias("used_ids"),
                      F.coalesce(F.transform("rejected", lambda x: x["memory_id"]), F.array().cast("array<string>")).alias("rejected_ids"),
                      F.coalesce(F.map_from_entries(F.transform("used", lambda x: F.struct(x["memory_id"], x["reasons"]))), F.create_map().cast("map<string,array<string>>")).alias("reasons"),
                      F.coalesce(F.map_from_entries(F.transform("rejected", lambda x: F.struct(x["memory_id"], x["rejected_by"]))), F.create_map().cast("map<string,string>")).alias("rejected_reasons"))
