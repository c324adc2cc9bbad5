"""Set-similarity joins: Jaccard bounds by prefix and length filters, and top k by shared members.

Members are put in order of how many sets hold them, the rarest first. Two sets of Jaccard
t or more share a member among the first n - ceil(t n) + 1 of each, and neither has under
t times the other's size; so only prefixes are joined, on (member, place), and pairs of
fitting sizes are verified on the whole sets. A member that very many prefixes hold is
joined by `hot` parts: its rows are dealt to parts on one side and repeated on the other.

Sets hold distinct members; empty ones and null ones are like nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.frames import settle
from trustloom.operators.search import ranked

HOT = 20_000  # prefixes of one member that one part takes
MOST_PARTS = 1024
SLACK = 1e-9


def prefixes(sets: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, place, size, member, n of its holders): the first members of every set, rarest first."""
    each = sets.select("id", "place", F.size("tokens").alias("size"), F.explode("tokens").alias("member")).join(counts, "member")
    # back to a row a set: what a set holds bounds a group
    ordered = each.groupBy("id", "place", "size").agg(F.array_sort(F.collect_list(F.struct("n", "member"))).alias("m"))
    keep = F.col("size") - F.ceil(F.lit(least) * F.col("size") - SLACK) + 1
    return ordered.select("id", "place", "size", F.explode(F.slice("m", F.lit(1), keep.cast("int"))).alias("p")).select("id", "place", "size", "p.member")


def join(asked: DataFrame, rows: DataFrame, least: float, within: str | None = None) -> DataFrame:
    """(query_id, memory_id, score): pairs of asked and rows (memory_id, tokens) of Jaccard `least` or more, of one `within` if it is named; ids stand once."""
    place = F.col(within) if within else F.lit(None).cast("string")
    sets = lambda df: settle(df.select(F.col("memory_id").alias("id"), place.alias("place"), F.array_distinct("tokens").alias("tokens")).filter(F.size("tokens") > 0))
    a, b = sets(asked), sets(rows)
    counts = settle(a.unionByName(b).select(F.explode("tokens").alias("member")).groupBy("member").agg(F.count("*").alias("n")))
    pa_, pb = settle(prefixes(a, counts, least)), settle(prefixes(b, counts, least))
    # members whose prefixes are many are parted; what is counted is a row a member and place
    key = ["place", "member"]
    load = pb.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") > HOT).select(*[F.col(k).alias(f"_{k}") for k in key], F.least(F.ceil(F.col("held") / HOT), F.lit(MOST_PARTS)).cast("int").alias("parts"))
    same = lambda df: df["place"].eqNullSafe(load["_place"]) & (df["member"] == load["_member"])
    parted = lambda df, part: df.join(load, same(df), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).drop("_place", "_member", "parts")
    left = parted(pa_, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("id").alias("query_id"), F.col("place").alias("p"), F.col("size").alias("m"), F.col("member").alias("w"), F.col("part").alias("k"))
    right = parted(pb, F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")).select("id", "place", "size", "member", "part")
    fits = (F.col("size") >= F.lit(least) * F.col("m") - SLACK) & (F.col("m") >= F.lit(least) * F.col("size") - SLACK)
    on = (F.col("w") == F.col("member")) & (F.col("k") == F.col("part"))
    met = left.join(right, on & F.col("p").eqNullSafe(F.col("place")) & fits).select("query_id", "id").distinct()
    whole = met.join(a.select(F.col("id").alias("query_id"), F.col("tokens").alias("s")), "query_id").join(b.select("id", F.col("tokens").alias("t")), "id")
    shared = F.size(F.array_intersect("s", "t"))
    score = shared / (F.size("s") + F.size("t") - shared)
    return whole.select("query_id", F.col("id").alias("memory_id"), score.alias("score")).filter(F.col("score") >= least - SLACK)


def top(asked: DataFrame, rows: DataFrame, k: int, least: float = 0.0, digits: int = 6) -> DataFrame:
    """(query_id, rank, memory_id, score): the k rows (memory_id, tokens) of highest Jaccard with each of few stated sets (query_id, tokens).

    Postings of the members asked for are counted, partly before they are shuffled; sizes alone then give the scores,
    so that no set is held against another. Rows that share nothing, or score under `least`, are no results; ties go to the smaller id.
    """
    q = asked.select("query_id", F.array_distinct("tokens").alias("q"))
    members = F.broadcast(q.select("query_id", F.size("q").alias("m"), F.explode("q").alias("member")))  # of stated sets, few
    wanted = q.select(F.explode("q").alias("member")).agg(F.collect_set("member").alias("w")).first().w
    t = rows.select("memory_id", F.array_distinct("tokens").alias("t"))
    held = t.select("memory_id", F.size("t").alias("size"), F.explode(F.array_intersect("t", F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))).alias("member"))
    shared = held.join(members, "member").groupBy("query_id", "memory_id", "m", "size").agg(F.count("*").alias("n"))
    enough = F.col("n") * (1 + F.lit(least)) >= F.lit(least) * (F.col("m") + F.col("size")) - SLACK - 10.0 ** -digits * (F.col("m") + F.col("size"))  # the count that the bound asks for
    scored = shared.filter(enough).select("query_id", "memory_id", F.round(F.col("n") / (F.col("m") + F.col("size") - F.col("n")), digits).alias("score")).filter(F.col("score") >= least)
    return ranked(scored, [F.desc("score"), "memory_id"], k).select("query_id", "rank", "memory_id", "score")
