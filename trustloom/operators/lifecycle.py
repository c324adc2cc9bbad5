"""What becomes of records: evaluation, supersession, correction, expiry, explanation.

`evaluate` is set-oriented: all pairs are judged against the same state, and where an
order would matter the record created later (then of the larger id) counts as the newer.

`evaluate_in_order` gives what evaluating new records one after another gives. A record is
held against those before it, so which pairs conflict is settled by contents and the order
alone; what changes on the way is how many conflicts a record has, and with that its
trust. Both follow, for every moment, from running counts over a record's conflicts in
order, and so does who gives way to whom; nothing has to be run through again.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.frames import settle, stored
from trustloom.functions import decisions, detect as detectors, needles, trust
from trustloom.operators import contradict

LEAST_USER_TRUST = 0.45  # fixed value


def newer_supersedes(newer: str, older: str, read: bool = False) -> Column:
    """Whether the newer side's decision replaces the older side's: same place, another value, and a reason to believe it.

    Sides that are `read` have cue instead of content.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    dn, do = col(newer, "decision"), col(older, "decision")
    place = (col(newer, "scope") == col(older, "scope")) & col(newer, "scope_ref").eqNullSafe(col(older, "scope_ref"))
    split = (do["key"] == "database") & dn["key"].isin("database_local", "database_cloud")
    trusted_user = (col(newer, "source_type") == "user") & (col(newer, "trust") >= LEAST_USER_TRUST)
    return F.coalesce((col(newer, "created_s") >= col(older, "created_s")) & place & (F.lower(dn["value"]) != F.lower(do["value"]))
                      & ((dn["key"] == do["key"]) | split) & (split | (col(newer, "cue") if read else decisions.has_cue(col(newer, "content"))) | trusted_user), F.lit(False))


def evaluate(records: DataFrame, pairs: DataFrame, now_s: Column) -> DataFrame:
    """records with n_contradicts, contradicts, trust, status, superseded_by and supersedes after a scan's pairs.

    Of a pair, the one superseded becomes that; else the one of lower trust (the candidate, side a,
    on a tie) becomes disputed if it is active. Deleted records keep their status.
    """
    edge = contradict.edges(pairs)
    degree = edge.groupBy("memory_id").agg(F.array_sort(F.collect_set("other_id")).alias("contradicts"))
    base = records.drop("contradicts", "n_contradicts", "trust").join(degree, "memory_id", "left")
    base = base.withColumn("contradicts", F.coalesce("contradicts", F.array().cast("array<string>"))).withColumn("n_contradicts", F.size("contradicts").cast("long"))
    scored = trust.signals(base, now_s).withColumn("trust", F.round("trust", 6))
    score = scored.select("memory_id", "trust")
    side = lambda name: score.select(F.col("memory_id").alias(f"{name}_id"), F.col("trust").alias(f"{name}_trust"))
    both = pairs.select("a", "b", F.col("a.memory_id").alias("a_id"), F.col("b.memory_id").alias("b_id")).join(side("a"), "a_id").join(side("b"), "b_id")
    read = "cue" in pairs.schema["a"].dataType.names
    told = "cue" if read else "content"
    both = both.withColumns({n: F.struct(*[F.col(f"{n}.{f}") for f in ("memory_id", told, "scope", "scope_ref", "source_type", "created_s", "decision", "status")], F.col(f"{n}_trust").alias("trust")) for n in "ab"})
    # a candidate may itself be a neighbor of another candidate: each unordered pair is judged once, with the newer as a
    later = F.struct("a.created_s", "a.memory_id") >= F.struct("b.created_s", "b.memory_id")
    both = both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("b")).dropDuplicates()
    over, under = newer_supersedes("a", "b", read), newer_supersedes("b", "a", read)
    say = lambda who, to, by=None: F.struct(F.col(f"{who}.memory_id").alias("memory_id"), F.lit(to).alias("to"), (F.col(f"{by}.memory_id") if by else F.lit(None).cast("string")).alias("by"))
    verdict = F.when(over, say("b", "superseded", "a")).when(under, say("a", "superseded", "b")).when(
        F.col("a.trust") <= F.col("b.trust"), say("a", "disputed")).otherwise(say("b", "disputed"))
    verdicts = both.select(verdict.alias("v")).select("v.*")
    change = verdicts.groupBy("memory_id").agg(F.max("to").alias("to"), F.max("by").alias("_by"))  # superseded > disputed
    made = verdicts.filter("by is not null").groupBy(F.col("by").alias("memory_id")).agg(F.array_sort(F.collect_set("memory_id")).alias("_over"))
    out = scored.join(change, "memory_id", "left").join(made, "memory_id", "left")
    status = F.when((F.col("status") != "deleted") & (F.col("to") == "superseded"), "superseded").when(
        (F.col("status") == "active") & (F.col("to") == "disputed"), "disputed").otherwise(F.col("status"))
    none = F.array().cast("array<string>")
    before = lambda name, kind: F.col(name) if name in records.columns else kind
    return out.withColumns({"status": status, "superseded_by": F.coalesce(F.col("_by"), before("superseded_by", F.lit(None).cast("string"))),
                            "supersedes": F.array_union(F.coalesce(before("supersedes", none), none), F.coalesce("_over", none))}).drop("to", "_by", "_over")


def evaluate_in_order(records: DataFrame, new: Column, now_s: Column) -> DataFrame:
    """records after those that `new` says have been evaluated one by one, by (created_s, memory_id).

    Each is held against its nearest among the records that are not new and those new ones before it; both sides of a
    conflict name each other and are scored with the conflicts that they have by then; the later record may replace the
    earlier or give way to it; else the one of lower trust (the new one on a tie) is disputed if it is active. Of several
    that replace a record the last is named. Records that no conflict meets keep their trust; deleted ones their status.
    """
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    given = lambda name, other: F.coalesce(F.col(name), other) if name in records.columns else other
    base = stored(records.withColumns({"_new": new, "_given": given("contradicts", none), "_trust": given("trust", F.lit(0.0)), "superseded_by": given("superseded_by", text), "supersedes": given("supersedes", none)}).withColumn(
        "_order", F.when(F.col("_new"), F.col("created_s")).otherwise(F.lit(-(1 << 62)))))
    pairs = contradict.scan(base.drop("contradicts", "n_contradicts", "trust"), F.col("_new"), order="_order")
    when = F.struct(F.col("a._order").alias("at"), F.col("a.memory_id").alias("id"))
    events = stored(pairs.select("a", "b", when.alias("when"), "nth"))
    side = lambda one, other: events.select(F.col(f"{one}.memory_id").alias("memory_id"), F.col(f"{other}.memory_id").alias("other_id"), "when", (~F.array_contains(f"{one}._given", F.col(f"{other}.memory_id"))).cast("long").alias("fresh"))
    met = side("a", "b").unionByName(side("b", "a"))
    # a record's own conflicts are of one moment, and all count in it
    counted = met.withColumn("n", F.sum("fresh").over(Window.partitionBy("memory_id").orderBy("when"))).select("memory_id", "when", "n").distinct()

    def scored(one):
        at = events.select("when", "nth", F.col(f"{one}.memory_id").alias("memory_id"), F.col(f"{one}").alias("r")).join(counted, ["memory_id", "when"])
        row = at.select("when", "nth", F.col("memory_id").alias("_id"), "r.*", "n").withColumn("n_contradicts", F.size("_given") + F.col("n"))
        row = trust.signals(row, now_s)
        fields = ("memory_id", "cue", "scope", "scope_ref", "source_type", "created_s", "decision", "status")
        return row.select("when", F.col("_id").alias(f"{one}_id"), "nth", F.struct(*fields, F.round("trust", 6).alias("trust")).alias(one))

    both = scored("a").join(scored("b").withColumnRenamed("nth", "_nth"), "when").filter("nth = _nth").drop("_nth")
    over, under = newer_supersedes("a", "b", True), newer_supersedes("b", "a", True)
    say = lambda who, to, by=None: F.struct(F.col(f"{who}.memory_id").alias("memory_id"), F.lit(to).alias("to"), (F.col(f"{by}.memory_id") if by else text).alias("by"), F.struct("when", "nth").alias("turn"))
    verdict = F.when(over, say("b", "superseded", "a")).when(under, say("a", "superseded", "b")).when(F.col("a.trust") <= F.col("b.trust"), say("a", "disputed")).otherwise(say("b", "disputed"))
    verdicts = settle(both.select(verdict.alias("v")).select("v.*"))
    change = verdicts.groupBy("memory_id").agg(F.max("to").alias("_to"), F.max_by("by", F.when(F.col("by").isNotNull(), F.col("turn"))).alias("_by"))
    made = verdicts.filter("by is not null").groupBy(F.col("by").alias("memory_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "memory_id"))).alias("o")).select("memory_id", F.col("o.memory_id").alias("_over"))
    linked = met.groupBy("memory_id").agg(F.collect_set("other_id").alias("_linked"))
    out = base.drop("trust", "contradicts", "n_contradicts").join(linked, "memory_id", "left").join(change, "memory_id", "left").join(made, "memory_id", "left")
    out = out.withColumn("contradicts", F.array_sort(F.array_union("_given", F.coalesce("_linked", none)))).withColumn("n_contradicts", F.size("contradicts").cast("long"))
    status = F.when((F.col("status") != "deleted") & (F.col("_to") == "superseded"), "superseded").when((F.col("status") == "active") & (F.col("_to") == "disputed"), "disputed").otherwise(F.col("status"))
    return trust.signals(out, now_s).withColumns({
        "trust": F.when(F.col("_new") | F.col("_linked").isNotNull(), F.round("trust", 6)).otherwise(F.col("_trust")), "status": status,
        "superseded_by": F.coalesce("_by", "superseded_by"), "supersedes": F.array_union("supersedes", F.coalesce("_over", none))}).drop("_new", "_given", "_trust", "_order", "_linked", "_to", "_by", "_over")


def expire_due(records: DataFrame, now_s: Column) -> DataFrame:
    """Active records past their expiry become expired."""
    return records.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_s") <= now_s), "expired").otherwise(F.col("status")))


def correct(records: DataFrame, corrections: DataFrame, now_s: Column) -> DataFrame:
    """records with corrections (memory_id, new_id, content) made: the old row stays as corrected, a new one inherits its source.

    The two name each other as superseded_by and supersedes. Unknown ids raise when the rows are written.
    """
    known = corrections.join(records.select("memory_id").withColumn("_known", F.lit(True)), "memory_id", "left")
    known = known.withColumn("memory_id", F.when(F.col("_known"), F.col("memory_id")).otherwise(F.raise_error(F.concat(F.lit("unknown memory_id "), F.col("memory_id")))))
    change = known.select("memory_id", "new_id", F.col("content").alias("_content"))
    given = lambda name, other: F.col(name) if name in records.columns else other
    joined = records.join(change, "memory_id", "left")
    old = joined.withColumns({
        "status": F.when(F.col("new_id").isNotNull(), "corrected").otherwise(F.col("status")), "superseded_by": F.coalesce("new_id", given("superseded_by", F.lit(None).cast("string"))),
        "correction": F.when(F.col("new_id").isNotNull(), "supersede").otherwise(F.col("correction"))})
    new = joined.filter("new_id is not null").withColumns({
        "supersedes": F.array("memory_id"), "content": F.col("_content"), "status": F.lit("active"), "created_s": now_s.cast("long"), "correction": F.lit(None).cast("string")})
    new = new.withColumn("memory_id", F.col("new_id"))
    return old.drop("new_id", "_content").unionByName(new.drop("new_id", "_content"), allowMissingColumns=True)


def resolve(records: DataFrame, choices: DataFrame) -> DataFrame:
    """records after choices (old_id, new_id): the old ones superseded, the new ones active again if they were out of use.

    What a record superseded before stays in its list; where `records` has contradicts, both sides of a choice name each other there.
    """
    old = choices.groupBy(F.col("old_id").alias("memory_id")).agg(F.max("new_id").alias("_by"))
    new = choices.groupBy(F.col("new_id").alias("memory_id")).agg(F.array_sort(F.collect_set("old_id")).alias("_over"))
    out = records.join(old, "memory_id", "left").join(new, "memory_id", "left")
    status = F.when(F.col("_by").isNotNull(), "superseded").when(F.col("_over").isNotNull() & F.col("status").isin("disputed", "superseded", "outdated"), "active").otherwise(F.col("status"))
    none = F.array().cast("array<string>")
    given = lambda name, other: F.coalesce(F.col(name), other) if name in records.columns else other
    out = out.withColumns({"status": status, "superseded_by": F.coalesce("_by", given("superseded_by", F.lit(None).cast("string"))), "supersedes": F.array_union(given("supersedes", none), F.coalesce("_over", none))}).drop("_by", "_over")
    if "contradicts" not in records.columns:
        return out
    both = choices.select(F.col("old_id").alias("memory_id"), F.col("new_id").alias("other")).unionByName(choices.select(F.col("new_id").alias("memory_id"), F.col("old_id").alias("other")))
    met = both.groupBy("memory_id").agg(F.collect_set("other").alias("_met"))
    linked = F.array_sort(F.array_union(F.coalesce("contradicts", none), F.coalesce("_met", none)))
    return out.join(met, "memory_id", "left").withColumn("contradicts", F.when(F.col("_met").isNull(), F.col("contradicts")).otherwise(linked)).drop("_met")


def ingest_policy(records: DataFrame, policies: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(records, audit events): those that a policy does not allow are deleted softly, with the first policy's name."""
    first = F.coalesce(*[F.when(~F.coalesce(allowed, F.lit(False)), F.lit(name)) for name, allowed in policies], F.lit(None).cast("string"))
    judged = records.withColumn("_rejected", first)
    events = judged.filter("_rejected is not null").select(F.lit("ingest_rejected").alias("event"), "memory_id", F.array("_rejected").alias("reasons"), "sensitivity")
    return judged.withColumn("status", F.when(F.col("_rejected").isNotNull(), "deleted").otherwise(F.col("status"))).drop("_rejected"), events


def create(new: DataFrame, records: DataFrame, now_s: Column, policies: list[tuple[str, Column]] = ()) -> tuple[DataFrame, DataFrame]:
    """(all records, audit events) after new ones are inspected, added (known ids are refused), evaluated and judged by policy."""
    fresh = detectors.inspect(new.withColumn("trust_score", F.lit(0.0))).drop("trust_score").join(records.select("memory_id"), "memory_id", "left_anti")
    ids = fresh.select(F.col("memory_id").alias("_new")).distinct()
    every = records.unionByName(fresh, allowMissingColumns=True)
    asked = every.join(ids, F.col("memory_id") == F.col("_new"), "left").withColumn("_new", F.col("_new").isNotNull())
    out = evaluate_in_order(asked, F.col("_new"), now_s)
    if not policies:
        return out, out.limit(0).select(F.lit("ingest_rejected").alias("event"), "memory_id", F.array("status").alias("reasons"), "sensitivity")
    marked = out.join(ids, F.col("memory_id") == F.col("_new"), "left")
    return tuple(df.drop("_new") if "_new" in df.columns else df for df in ingest_policy(marked, [(n, F.col("_new").isNull() | a) for n, a in policies]))


def outdate(records: DataFrame, values: DataFrame) -> DataFrame:
    """Records, deleted ones apart, that hold or decide for one of the values (a stated list, which may be long) become outdated."""
    lower = values.select(F.lower("value").alias("needle")).filter("needle <> ''").distinct()
    read = settle(records.filter("status <> 'deleted'").select("memory_id", F.lower("content").alias("text"), F.lower(decisions.found(F.col("content"))["value"]).alias("needle")))
    hit = needles.holders(read, "memory_id", "text", lower).select(F.col("key").alias("_hit"))
    hit = hit.unionByName(read.join(lower, "needle", "left_semi").select(F.col("memory_id").alias("_hit"))).distinct()
    out = records.join(hit, F.col("memory_id") == F.col("_hit"), "left")
    return out.withColumn("status", F.when(F.col("_hit").isNotNull() & (F.col("status") != "deleted"), "outdated").otherwise(F.col("status"))).drop("_hit")


def explain(records: DataFrame, edge: DataFrame, now_s: Column) -> DataFrame:
    """Per record and edge (or one row without): source, signals, weights, lineage, the other's state; missing ones are said to be."""
    s = trust.signals(records, now_s)
    names = ("authority", "freshness", "confirmation", "contradiction", "tier_penalty", "corrected")
    s = s.select("memory_id", "source_type", "source_ref", "scope", "scope_ref", "status", "sensitivity", F.round("trust", 6).alias("trust"),
                 F.struct(*[F.round(n, 6).alias(n) for n in names]).alias("signals"), F.create_map(*[x for k, v in trust.WEIGHTS.items() for x in (F.lit(k), F.lit(v))]).alias("weights"),
                 *[c for c in ("supersedes", "superseded_by") if c in records.columns])
    other = records.select(F.col("memory_id").alias("other_id"), F.col("status").alias("other_status"), F.col("source_ref").alias("other_ref"), F.lit(True).alias("_found"))
    out = s.join(edge.withColumnRenamed("reason", "_reason"), "memory_id", "left").join(other, "other_id", "left")
    reason = F.when(F.col("other_id").isNull(), None).when(F.col("_found").isNull(), "linked memory not found").otherwise(F.col("_reason"))
    return out.withColumn("reason", reason).drop("_found", "_reason")


def lineage(records: DataFrame) -> DataFrame:
    """(memory_id, superseded_by, value): of every superseded decision what it gave way to.

    For a plain database decision that is the local and cloud databases of active records, if any.
    """
    # read once, and short; what decides nothing says nothing of who gave way
    decided = F.explode(F.array_compact(F.array(decisions.found(F.col("content"))))).alias("decision")
    return gave_way(stored(records.select("memory_id", "status", "superseded_by", decided)))


def gave_way(read: DataFrame) -> DataFrame:
    """`lineage` of records whose decision is known: memory_id, status, superseded_by, decision."""
    split = read.filter((F.col("status") == "active") & F.col("decision.key").isin("database_local", "database_cloud"))
    place = F.when(F.col("decision.key") == "database_local", "local ").otherwise("cloud ")
    parts = split.select(F.concat(place, F.col("decision.value")).alias("part")).distinct()
    joined = parts.agg(F.nullif(F.array_join(F.array_sort(F.collect_set("part")), " and "), F.lit("")).alias("split"))  # distinct values only
    newer = read.select(F.col("memory_id").alias("superseded_by"), F.col("decision.value").alias("newer"))
    old = read.filter((F.col("status") == "superseded") & F.col("decision").isNotNull())
    out = old.join(newer, "superseded_by", "left").join(F.broadcast(joined))
    return out.select("memory_id", "superseded_by", F.when(F.col("decision.key") == "database", F.coalesce("split", "newer")).otherwise(F.col("newer")).alias("value"))


def chains(records: DataFrame) -> DataFrame:
    """(memory_id, final, steps, cyclic): whom each superseded record was replaced by in the end, after how many steps.

    Pointers are doubled: a round joins every open record with the one that it points at, so that a chain of n steps takes
    log n rounds. Records that run into a circle have no final one; a successor that is not there ends a chain.
    """
    none = F.lit(None).cast("string")
    at = settle(records.filter("superseded_by is not null").select("memory_id", F.col("superseded_by").alias("next"), F.lit(1).cast("long").alias("steps")))
    n, reached = at.count(), 1
    while True:
        to = at.select(F.col("memory_id").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"))
        open_ = at.join(to, "next", "left").select("memory_id", "next", "steps", "after", "more")
        if reached > n or not open_.filter("after is not null").limit(1).count():
            break  # all have come to an end, or gone farther than there are records
        reached *= 2
        at = settle(open_.select("memory_id", F.coalesce("after", "next").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    cyclic = F.col("after").isNotNull()
    return open_.select("memory_id", F.when(~cyclic, F.col("next")).otherwise(none).alias("final"), F.when(~cyclic, F.col("steps")).alias("steps"), cyclic.alias("cyclic"))


def classified(records: DataFrame) -> DataFrame:
    """Add omitted, usable, active, deprecated and avoid: overlapping classes by status, tier, secrets and words."""
    from trustloom.functions.text import has_any

    c = F.col
    alive = c("status") != "deleted"
    secret = c("sensitivity").isin("secret", "pii") | detectors.contains_secret(c("content"))
    out = records.withColumn("omitted", alive & secret).withColumn("usable", alive & ~secret)
    old = c("status").isin("corrected", "expired", "disputed", "superseded", "outdated") | has_any(c("content"), ("deprecated", "outdated", "superseded", "do not use"))
    shun = has_any(c("content"), ("avoid", "never", "do not", "don't", "must not", "deprecated"))
    return out.withColumns({"active": c("usable") & (c("status") == "active"), "deprecated": c("usable") & old, "avoid": c("usable") & shun})


def any_of(conditions) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))
