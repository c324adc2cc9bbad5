"""Operator 12: the prefix trie of rebuilt conversations, totalled by leaf-peeling message passing.

Turns become digests and word counts before anything is shuffled. A prefix is known by the
exclusive or, over its turns, of four 64-bit words of (digest, depth): 256 bits that a
running window gives, so equal sequences meet and others do not but by chance.

A node is named by its smallest member and its depth. Nodes of one smallest member lie
below each other, a branch, which hangs on a node of another branch (the root's apart). Branches, not nodes, pass messages: each has a
counter of the branches that hang on it and are not complete, and complete ones send
their totals to the branch that they hang on until only the root's is left. A branch that
waits for one other alone takes over what that one has and waits for whom it waits for, so
that long chains halve each round: conversations that grow turn by turn, saved each time,
need rounds by the logarithm of their turns. A node's own totals are then running sums up
its branch.

Null roles and texts count as empty, rows with a null conv_id take no part. Of equal turn
numbers the one of the smaller SHA-256 of "<length of role>:<role><text>" comes first;
repeated rows are turns of their own. A base that is not there gives no turns. An empty
table has no nodes, not even a root. Other columns are not looked at, whatever their
names. A conversation's turns, without their texts, are put in order by one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.common import cut, hot_join, table

WORD = r"[^\x20\x09-\x0D]+"
EVERY, MOST = 20, 4  # conversations that share a base; turns taken from it are fewer than MOST
IDS = 4096  # conversation ids of a stretch that one string of a node's ends may hold
KEY = ["k0", "k1", "k2", "k3"]
NONE = hashlib.sha256(b"").hexdigest()


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, mark, words): turns in order, their texts as digests."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    thin = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return thin.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "mark")).alias("pos"), "mark", "words")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k0..k3, p0..p3 of the prefix one turn shorter, words of the last turn, ends): every prefix of rebuilt conversations but the empty one."""
    base = turns.filter((F.col("conv_id") % EVERY == 0) & (F.col("pos") < MOST)).withColumnRenamed("conv_id", "base")
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"), taken(F.col("conv_id")).alias("h")).filter("h > 0")
    front = asked.join(base, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "mark", "words")
    back = turns.filter(F.col("pos") > taken(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "pos", "mark", "words")
    w = Window.partitionBy("conv_id").orderBy("part", "pos")
    rows = front.unionByName(back).withColumn("depth", F.row_number().over(w)).withColumn("ends", F.lead("pos").over(w).isNull())
    word = {k: F.xxhash64(F.lit(i), "mark", "depth") for i, k in enumerate(KEY)}
    rows = rows.withColumns({f"w{k}": v for k, v in word.items()})
    rows = rows.withColumns({k: F.bit_xor(f"w{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in KEY})
    return rows.select("conv_id", "depth", "ends", "words", *KEY, *[F.col(k).bitwiseXOR(F.col(f"w{k}")).alias(k.replace("k", "p")) for k in KEY])


def digests(ends: DataFrame) -> DataFrame:
    """(depth, k0..k3, ends_sha256) of (conv_id, depth, k0..k3): ids of a node in order, in strings of bounded length, hashed as a stream."""
    key = ["depth", *KEY]
    part = ends.groupBy(*key, F.floor(F.col("conv_id") / IDS).alias("stretch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    schema = pa.schema([("depth", pa.int32()), *[(k, pa.int64()) for k in KEY], ("ends_sha256", pa.string())])

    def run(batches):
        now, hashed, out = None, None, []
        for batch in batches:
            for *at, ids in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if at == now:
                    hashed.update(b",")
                else:
                    if now:
                        out.append((*now, hashed.hexdigest()))
                    now, hashed = at, hashlib.sha256()
                hashed.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)
            out.clear()
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, hashed.hexdigest()), schema)], schema=schema)

    stream = part.repartition(*key).sortWithinPartitions(*key, "stretch").select(*key, "ids")
    return stream.mapInArrow(run, "depth int, k0 long, k1 long, k2 long, k3 long, ends_sha256 string")


def peeled(state: DataFrame) -> DataFrame:
    """(conv_id, parent, at, leaves, saved): totals of every branch and all that hangs on it.

    state has each branch's own sums and `left`, the number of branches that hang on it, and
    `rest`, the exclusive or of their names, which is the name of the last one when one is left.
    """
    parts, sums = [], ("leaves", "saved")
    state = cut(state)
    while True:
        finished, waiting = state.filter("left = 0"), state.filter("left > 0")
        parts.append(finished.select("conv_id", "parent", "at", *sums))
        n = state.agg(F.count_if(F.col("left") > 1).alias("counting"), F.count_if(F.col("left") == 1).alias("pointing")).first()
        after = []
        if n.counting:
            sent = finished.filter("parent is not null").groupBy(F.col("parent").alias("to")).agg(
                F.count("*").alias("n"), F.bit_xor("conv_id").alias("gone"), *[F.sum(s).alias(f"s_{s}") for s in sums])
            zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
            after.append(waiting.filter("left > 1").join(sent, F.col("conv_id") == F.col("to"), "left").select(
                "conv_id", "parent", "at", (F.col("left") - zero("n")).alias("left"), F.col("rest").bitwiseXOR(zero("gone")).alias("rest"), *[(F.col(s) + zero(f"s_{s}")).alias(s) for s in sums]))
        if n.pointing:
            one = waiting.filter("left = 1")
            of = lambda rows: rows.select(F.col("conv_id").alias("rest"), F.col("rest").alias("next"), *[F.col(s).alias(f"s_{s}") for s in sums])
            more = [(F.col(s) + F.coalesce(f"s_{s}", F.lit(0).cast("long"))).alias(s) for s in sums]
            # those that wait for a complete one are complete; only the others may take over
            met = hot_join(one, of(finished), "rest")
            met = cut(met.select("conv_id", "parent", "at", F.lit(0).cast("long").alias("left"), "rest", *more))
            still = one.join(met.select("conv_id"), "conv_id", "left_anti")
            jump = hot_join(still, of(still), "rest")
            jump = cut(jump.select("conv_id", "parent", "at", "left", F.col("next").alias("rest"), *more))
            after += [met, jump, still.join(jump.select("conv_id"), "conv_id", "left_anti").select(*met.columns)]
        if not after:
            break
        state = after[0]
        for other in after[1:]:
            state = state.unionByName(other)
        state = cut(state)
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row each node."""
    long = lambda value: F.lit(value).cast("long")
    turns = cut(ordered(rows))
    convs = turns.select("conv_id").distinct()
    top = convs.agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).first()
    if not top.n:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = cut(prefixes(turns, convs))
    grown = paths.groupBy("depth", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), *[F.first(k.replace("k", "p")).alias(k.replace("k", "p")) for k in KEY])
    root = rows.sparkSession.range(1).select(F.lit(0).alias("depth"), *[long(0).alias(k) for k in KEY], long(top.c).alias("conv_id"), long(top.n).alias("n_convs"), long(0).alias("words"), *[long(0).alias(k.replace("k", "p")) for k in KEY])
    nodes = cut(grown.unionByName(root))

    # where each branch hangs; many may hang on one node
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("d"), F.min_by(F.struct("p0", "p1", "p2", "p3"), "depth").alias("p")).filter("d > 0")
    key = F.struct((F.col("d") - 1).alias("d"), *[F.col(f"p.p{i}").alias(f"k{i}") for i in range(4)])
    named = nodes.filter("depth > 0").select(F.struct(F.col("depth").alias("d"), *KEY).alias("key"), F.col("conv_id").alias("parent"))
    deep = hot_join(first.filter("d > 1").select("conv_id", "d", key.alias("key")), named, "key")
    branches = cut(deep.select("conv_id", "parent", (F.col("d") - 1).alias("at")).unionByName(first.filter("d = 1").select("conv_id", long(top.c).alias("parent"), F.lit(0).alias("at"))))

    hung = branches.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("left"), F.bit_xor("conv_id").alias("rest"), F.max("at").alias("lowest"))
    own = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.max("depth").alias("last"))
    leaf = F.when(F.coalesce("lowest", F.lit(-1)) < F.col("last"), 1).otherwise(0).cast("long")
    state = own.join(hung, "conv_id", "left").join(branches, "conv_id", "left").select(
        "conv_id", "parent", "at", F.coalesce("left", long(0)).alias("left"), F.coalesce("rest", long(0)).alias("rest"), leaf.alias("leaves"), "saved")
    sent = peeled(state).filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    ended = paths.filter("ends").select("conv_id", "depth", *KEY)
    bare = convs.join(ended, "conv_id", "left_anti").select("conv_id", F.lit(0).alias("depth"), *[long(0).alias(k) for k in KEY])
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    total = lambda value: F.sum(value).over(up.rowsBetween(Window.unboundedPreceding, 0))
    zero = lambda name: F.coalesce(F.col(name), long(0))
    out = nodes.join(digests(ended.unionByName(bare)), ["depth", *KEY], "left").join(sent, ["conv_id", "depth"], "left")
    out = out.join(branches.select("conv_id", (F.col("at") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    last = F.row_number().over(up) == 1
    out = out.withColumn("last", last).withColumns({
        "n_children": zero("n") + F.when(F.col("last"), 0).otherwise(1), "n_leaves": total(zero("leaves") + F.when(F.col("last") & F.col("n").isNull(), 1).otherwise(0)),
        "saved_tokens": total(zero("saved") + (F.col("n_convs") - 1) * F.col("words")), "parent_conv_id": F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))})
    return out.select("conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda e, i: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END))) % 4 AS h
  FROM t
), r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), s AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY part, pos) AS seq FROM r GROUP BY conv_id
  UNION ALL SELECT conv_id, [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r)
), p AS (
  SELECT conv_id, d AS depth, len(seq) AS n, list_slice(seq, 1, d) AS prefix, seq[d].x AS last FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, prefix
), own AS (
  SELECT *, (n_convs - 1) * len(regexp_extract_all(coalesce(last, ''), '[^\\x20\\x09-\\x0D]+')) AS saved FROM nodes
), below AS (
  SELECT a.conv_id, a.depth, n.depth AS d, n.saved, n.conv_id AS n_conv FROM own a JOIN own n ON a.depth <= n.depth AND a.prefix = list_slice(n.prefix, 1, a.depth)
), inner_ AS (SELECT DISTINCT conv_id, depth FROM below WHERE d = depth + 1
), sums AS (
  SELECT b.conv_id, b.depth, count(*) FILTER (WHERE d = b.depth + 1) AS n_children, count(*) FILTER (WHERE i.conv_id IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM below b LEFT JOIN inner_ i ON i.conv_id = n_conv AND i.depth = d GROUP BY b.conv_id, b.depth
), above AS (SELECT n_conv AS conv_id, d AS depth, conv_id AS parent_conv_id FROM below WHERE d = depth + 1)
SELECT o.conv_id, o.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM own o JOIN sums USING (conv_id, depth) LEFT JOIN above USING (conv_id, depth)
"""
