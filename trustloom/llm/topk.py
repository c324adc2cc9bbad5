"""Operator 3: exact top-k by inner product, ball-tree branch and bound per shard.

Each shard (an Arrow batch of rows) gets a ball tree. A query's inner product with any
vector of a node is at most q.c + |q| r. Nodes are descended from the highest bound, and
a node is left when its bound is below the query's current k-th score. That score is
shared: it starts from an exact pass over a small seed set, and each task hands it on
from shard to shard. Queries travel in blocks of about `BLOCK`; of several blocks, each
is answered and its results written before the next one leaves the driver.

Components become floor(1024 x). Null vectors and vectors that hold null or non-finite
components take no part, on either side; neither do rows with a null id or another width
than the widest's. Repeated ids are candidates of their own, except that no row is one
for a query of its own id; of queries that share an id the least vector asks. Ties go to
the smaller id. Scores are exact as long as they fit 64 bits. An empty table, or one
without a usable vector, gives no rows. Only the two columns named are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.common import cut, table

LEAF = 256
SHARD_ROWS = 16384
BLOCK = 8192  # queries per broadcast
SEED_ROWS = 2048
LEAST = -(1 << 62)  # stands for no score yet; its negative is a number too


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))


class BallTree:
    """Median splits along the widest dimension; nodes hold a slice of `order`, a centre and a radius."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes, todo = [], [(0, len(x), None)]
        while todo:
            lo, hi, parent = todo.pop()
            part = x[self.order[lo:hi]]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            me = len(self.nodes)
            self.nodes.append([lo, hi, centre, radius, []])
            if parent is not None:
                self.nodes[parent][4].append(me)
            if hi - lo > leaf:
                axis = int(np.ptp(part, axis=0).argmax())
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], mid)]
                todo += [(lo, lo + mid, me), (lo + mid, hi, me)]
        self.centres = np.stack([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where every sum stays under 2**53."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search(x, ids, q, q_ids, k, best_s, best_i):
    """Improve each query's best scores and ids (sorted, padded by the least score) with the shard's rows."""
    tree = BallTree(x.astype(np.float64))
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))

    def bound(rows, nodes):
        b = q[rows].astype(np.float64) @ tree.centres[nodes].T + norm[rows, None] * tree.radii[nodes]
        return b + 1e-9 * np.abs(b) + 1.0  # floats never cut a true score off

    # down the levels, leaving nodes below the current k-th score
    front, leaves = [(0, np.arange(len(q)))], []
    while front:
        node, rows = front.pop()
        b = bound(rows, [node])[:, 0]
        open_ = b >= best_s[rows, -1]
        rows, b = rows[open_], b[open_]
        if len(rows):
            if tree.nodes[node][4]:
                front += [(child, rows) for child in tree.nodes[node][4]]
            else:
                leaves.append((node, rows, b))
    if not leaves:
        return
    node = np.concatenate([np.full(len(r), n) for n, r, _ in leaves])
    row, b = np.concatenate([r for _, r, _ in leaves]), np.concatenate([b for *_, b in leaves])
    by = np.lexsort((-b, row))
    node, row, b = node[by], row[by], b[by]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    for t in range(int(turn.max()) + 1):  # t-th best leaf of every query at once
        now = np.flatnonzero(turn == t)
        now = now[b[now] >= best_s[row[now], -1]]
        for leaf in np.unique(node[now]):
            rows = row[now[node[now] == leaf]]
            lo, hi = tree.nodes[leaf][:2]
            at = tree.order[lo:hi]
            s = _product(q[rows], x[at])
            i = np.broadcast_to(ids[at], s.shape)
            s = np.where(i == q_ids[rows, None], LEAST, s)
            all_s, all_i = np.c_[best_s[rows], s], np.c_[best_i[rows], i]
            if all_s.shape[1] > 4 * k:  # ties at the cut are kept until ordered by id
                cut = -np.partition(-all_s, k - 1, axis=1)[:, k - 1:k]
                wide = int((all_s >= cut).sum(axis=1).max())
                if wide < all_s.shape[1]:
                    top = np.argpartition(-all_s, wide - 1, axis=1)[:, :wide]
                    all_s, all_i = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            first = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all rows but its own id's."""
    spark = rows.sparkSession
    vectors = quantised(rows)
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = vectors.filter(F.size("v") == width)
    queries = cut(vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = queries.count()
    blocks = -(-n // BLOCK)
    seed = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).collect()
    seed_x, seed_i = np.array([r.v for r in seed], np.int64), np.array([r.vec_id for r in seed], np.int64)
    out = None
    for block in range(blocks):
        # about n / blocks queries: BLOCK and a little, whatever the table's size
        mine = sorted((r.vec_id, r.v) for r in queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect())
        if not mine:
            continue
        q, q_ids = np.array([m[1] for m in mine], np.int64), np.array([m[0] for m in mine], np.int64)
        s, i = np.full((len(q), k), LEAST), np.full((len(q), k), -1)
        search(seed_x, seed_i, q, q_ids, k, s, i)
        sent = spark.sparkContext.broadcast((q, q_ids, s[:, -1].copy()))

        def run(batches, sent=sent):
            q_, ids_, floor = sent.value
            # one below the seed's k-th score: a score that ties with it may still win by its id
            pad = np.where(floor == LEAST, LEAST, floor - 1)[:, None]
            s_ = np.repeat(pad, k, axis=1)
            i_ = np.full((len(q_), k), -1)
            held = []

            def flush():
                ids = np.concatenate([h[0] for h in held])
                search(np.concatenate([h[1] for h in held]), ids, q_, ids_, k, s_, i_)
                held.clear()

            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), width)))
                    if sum(len(h[0]) for h in held) >= SHARD_ROWS:
                        flush()
            if held:
                flush()
            r, c = np.nonzero(s_ > pad)
            yield pa.RecordBatch.from_arrays([pa.array(ids_[r]), pa.array(i_[r, c]), pa.array(s_[r, c])], ["query_id", "vec_id", "score"])

        part = vectors.mapInArrow(run, schema)
        if blocks > 1:
            part = cut(ranked(part, k).select("query_id", "vec_id", "score"))
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
