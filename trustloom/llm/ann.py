"""Operator 11: approximate nearest neighbours by stable projections, a kd-tree and a chi-square test.

The largest inner product is the nearest point once every vector x gets one more component,
sqrt(M^2 - |x|^2), where M is the largest length, and every query a zero: the squared
distance is then |q|^2 + M^2 - 2 q.x. All points are projected on `DIMENSIONS` Gaussian
directions. A projected squared distance over the true one is chi-square distributed with
so many degrees of freedom; so a point as near as the k-th found so far lies, with
probability `SURE`, within the projected radius r of r^2 = quantile(SURE) * d_k^2. Points
are verified in order of their projected distance, one leaf of a kd-tree after another,
until the next leaf is farther than r, which shrinks as d_k does.

The upper levels of the kd-tree part the table: cells, fitted on `SAMPLE` rows, every row
dealt to its cell and cells of many rows to shards of bounded size, whatever
the number of copies of a vector. A query starts from its k-th nearest of the sample, and goes
to the shards of the cells whose boxes its radius meets. A task reads a sorted stream, a
shard's rows before its queries, builds the lower levels and answers queries in blocks.

Vectors that are null, zero, or hold null or non-finite components take no part, on either
side; neither do rows with a null id. Vectors of different widths never meet. Repeated ids
are candidates of their own, except that no row is one for a query of its own id; of
queries that share an id the least vector asks. Scores are inner products of the original
vectors in double precision. Ties go to the smaller id; rows of one id and
one score count once. An empty table gives no rows. Only the two columns named are looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.common import cut, list_array, table

DIMENSIONS = 8  # even
SURE = 0.97
SAMPLE = 16384
CELLS = 256
SHARD_ROWS = 1024, 16384  # least and most: a few shards for every core, as far as these allow
QUERY_BLOCK = 1024
LEAF = 64
SEED = 11
ROUNDING = 1e-9


def chi_square(x: float, degrees: int = DIMENSIONS) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(sure: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < sure else (low, middle)
    return high


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


def directions(width: int) -> np.ndarray:
    """Gaussian directions of a width's vectors and their added component."""
    return np.random.default_rng((SEED, width)).standard_normal((width + 1, DIMENSIONS))


def projected(x: np.ndarray, longest: float) -> np.ndarray:
    """Projections of rows, the added component at the end; of queries, with longest 0, it is zero."""
    added = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0)) if longest else np.zeros(len(x))
    return np.c_[x, added] @ directions(x.shape[1])


class Tree:
    """The leaves of a kd-tree by medians of the widest axis: slices of `order`, and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order, self.leaves, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            part = points[self.order[lo:hi]]
            spread = np.ptp(part, axis=0)
            axis = int(spread.argmax())
            if hi - lo <= leaf or spread[axis] == 0:
                self.leaves.append((lo, hi))
            else:
                middle = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], middle)]
                todo += [(lo, lo + middle), (lo + middle, hi)]
        of = [points[self.order[lo:hi]] for lo, hi in self.leaves]
        self.low, self.high = np.array([p.min(axis=0) for p in of]), np.array([p.max(axis=0) for p in of])


class Cells:
    """The upper levels of one width's tree: half-open regions that part all space."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits, self.low, self.high = [], [], []
        full = np.full(points.shape[1], np.inf)
        todo = [(points, -full, full, max(1, cells), None)]
        while todo:
            part, low, high, n, link = todo.pop()
            axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            left = part[:, axis] < at
            if n == 1 or not left.any():
                name = ~len(self.low)
                self.low.append(low)
                self.high.append(high)
            else:
                name = len(self.splits)
                self.splits.append([axis, at, 0, 0])
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = at
                todo += [(part[left], low, below, n // 2, (name, 2)), (part[~left], above, high, n - n // 2, (name, 3))]
            if link:
                self.splits[link[0]][link[1]] = name
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if self.splits else -1)
        for k, (axis, value, left, right) in enumerate(self.splits):  # parents come before their children
            here = at == k
            at[here] = np.where(points[here, axis] < value, left, right)
        return ~at


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of every query to every box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        out += np.maximum(np.maximum(low[None, :, k] - q[:, k, None], q[:, k, None] - high[None, :, k]), 0) ** 2
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, alike for like rows wherever they stand."""
    return (a * b).sum(axis=1)


def keep_best(best_s, best_i, s, i, k: int):
    """The k highest of what is held and what is new, ties to the smaller id; by query, sorted."""
    all_s, all_i = np.c_[best_s, s], np.c_[best_i, i]
    first = np.lexsort((all_i, -all_s), axis=1)[:, :k]
    return np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)


class Shard:
    """Rows of a shard under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        tree = Tree(projected(x, longest), LEAF)
        self.ids, self.x, self.longest = ids[tree.order], x[tree.order], longest
        self.low, self.high, self.leaves = tree.low, tree.high, tree.leaves
        self.verified = 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, far: float) -> tuple[np.ndarray, np.ndarray]:
        """Each query's k best scores and ids here; floor is a score that k rows elsewhere reach."""
        best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        length = (q * q).sum(axis=1) + self.longest ** 2
        margin = length * ROUNDING
        d = box_distance(projected(q, 0.0), self.low, self.high)
        order = np.argsort(d, axis=1, kind="stable")
        active = np.arange(len(q))
        for turn in range(len(self.leaves)):
            kth = np.maximum(best_s[active, -1], floor[active])
            reach = far * (length[active] - 2 * kth) * (1 + ROUNDING) + ROUNDING
            leaf = order[active, turn]
            active, leaf = (a[d[active, leaf] <= reach] for a in (active, leaf))
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            heads = np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1]))
            for rows in np.split(by, heads[1:]):  # the queries that take this leaf now
                at, (lo, hi) = active[rows], self.leaves[leaf[rows[0]]]
                s = q[at] @ self.x[lo:hi].T
                self.verified += s.size
                i = np.broadcast_to(self.ids[lo:hi], s.shape)
                near = (s >= np.maximum(best_s[at, -1], floor[at])[:, None] - margin[at, None]) & (i != q_ids[at, None])
                r, c = np.nonzero(near)
                s = np.full(s.shape, -np.inf)
                s[r, c] = inner(q[at[r]], self.x[lo + c])  # the product of matrices may differ between copies
                best_s[at], best_i[at] = keep_best(best_s[at], best_i[at], s, i, k)
        return best_s, best_i


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest inner products found among all rows but its own id's."""
    spark, far = rows.sparkSession, quantile(SURE)
    vectors = usable(rows)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bounds = {r.width: (r.longest, r.n) for r in vectors.groupBy(F.size("v").alias("width")).agg(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"), F.count("*").alias("n")).collect()}
    if not bounds:
        return empty
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()
    total = sum(n for _, n in bounds.values())
    shard_rows = min(max(total // (3 * spark.sparkContext.defaultParallelism), SHARD_ROWS[0]), SHARD_ROWS[1])
    cells, seeds = {}, {}
    for width in bounds:
        mine = [r for r in sample if len(r.v) == width]
        x = np.array([r.v for r in mine]).reshape(len(mine), width)
        cells[width] = Cells(projected(x, bounds[width][0]) if len(x) else np.zeros((0, DIMENSIONS)), min(CELLS, -(-bounds[width][1] // shard_rows)))
        seeds[width] = (np.array([r.vec_id for r in mine], np.int64), x)
    model = spark.sparkContext.broadcast((bounds, cells, seeds))

    # rows: the cell of each, and its place in its task's batch, by which cells are dealt to shards
    def place(batches):
        bounds_, cells_, _ = model.value
        seen = 0
        for batch in batches:
            lists = batch.column(1)
            widths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            cell = np.zeros(len(widths), np.int64)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)
                cell[at] = cells_[width].of(projected(x, bounds_[width][0]))
            yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array(cell, pa.int32()), pa.array(seen + np.arange(len(widths))), batch.column(0), lists], ["width", "cell", "turn", "vec_id", "v"])
            seen += len(widths)

    placed = cut(vectors.mapInArrow(place, "width int, cell int, turn long, vec_id long, v array<double>"))
    sizes = placed.groupBy("width", "cell").count().collect()  # no more than CELLS a width
    first, shards = {}, 0
    for r in sorted(sizes, key=lambda r: (r.width, r.cell)):
        n = -(-r["count"] // shard_rows)
        first[r.width, r.cell] = (shards, n)
        shards += n
    index = spark.createDataFrame([(w, c, s, n) for (w, c), (s, n) in first.items()], "width int, cell int, first int, n int")
    dealt = placed.join(F.broadcast(index), ["width", "cell"]).select((F.col("first") + F.col("turn") % F.col("n")).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("floor"))

    where = spark.sparkContext.broadcast(first)

    def route(batches):
        bounds_, cells_, seeds_ = model.value
        for batch in batches:
            lists = batch.column(1)
            widths, ids = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int), batch.column(0).to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                q = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)
                seed_ids, x = seeds_[width]
                s = np.where(seed_ids == ids[at, None], -np.inf, q @ x.T)
                floor = -np.partition(-s, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(q), -np.inf)
                reach = far * ((q * q).sum(axis=1) + bounds_[width][0] ** 2 - 2 * floor) * (1 + ROUNDING) + ROUNDING
                met = box_distance(projected(q, 0.0), cells_[width].low, cells_[width].high) <= reach[:, None]
                r, c = np.nonzero(met)
                spans = [where.value.get((int(width), int(cell)), (0, 0)) for cell in range(met.shape[1])]
                start, n = np.array([p[0] for p in spans])[c], np.array([p[1] for p in spans])[c]
                r, shard = np.repeat(r, n), np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for some in range(0, len(r), 4096):
                    part = slice(some, some + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(shard[part], pa.int32()), pa.array(np.ones(len(r[part]), np.int32)), pa.array(ids[at][r[part]]),
                                                      list_array(q[r[part]].ravel(), [int(width)] * len(r[part]), pa.float64()), pa.array(floor[r[part]])], ["shard", "kind", "vec_id", "v", "floor"])

    shape = "shard int, kind int, vec_id long, v array<double>, floor double"
    queries = cut(vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    stream = dealt.unionByName(queries.mapInArrow(route, shape)).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "kind")

    def answer(batches):
        bounds_, *_ = model.value
        now, held, shard, waiting = None, [], None, []

        def blocks(least):
            nonlocal shard
            while sum(len(w[0]) for w in waiting) >= least and waiting:
                ids, q, floor = (np.concatenate([w[j] for w in waiting]) for j in range(3))
                waiting.clear()
                if len(ids) > QUERY_BLOCK and least > 1:
                    waiting.append((ids[QUERY_BLOCK:], q[QUERY_BLOCK:], floor[QUERY_BLOCK:]))
                    ids, q, floor = ids[:QUERY_BLOCK], q[:QUERY_BLOCK], floor[:QUERY_BLOCK]
                if shard is None:
                    shard = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bounds_[q.shape[1]][0])
                    held.clear()
                s, i = shard.search(ids, q, floor, k, far)
                r, c = np.nonzero((s > -np.inf) & (s >= floor[:, None] - ROUNDING * np.maximum(1, np.abs(floor))[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(i[r, c]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])

        for batch in batches:
            shards_, kinds = (batch.column(j).to_numpy() for j in (0, 1))
            heads = np.flatnonzero(np.append(True, (shards_[1:] != shards_[:-1]) | (kinds[1:] != kinds[:-1]))) if len(kinds) else []
            for lo, hi in zip(heads, [*heads[1:], len(kinds)]):
                if shards_[lo] != now:
                    yield from blocks(1)
                    now, held, shard = shards_[lo], [], None
                part = batch.slice(lo, hi - lo)
                v = part.column(3)
                x = v.flatten().to_numpy().reshape(len(v), -1)
                if kinds[lo] == 0:
                    held.append((part.column(2).to_numpy(), x))
                else:
                    waiting.append((part.column(2).to_numpy(), x, part.column(4).to_numpy()))
                    yield from blocks(QUERY_BLOCK)
        yield from blocks(1)

    def from_sample(batches):
        _, _, seeds_ = model.value
        for batch in batches:
            for q_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                q = v.values.to_numpy()
                ids, x = seeds_[len(q)]
                rough = np.where(ids == q_id, -np.inf, x @ q)
                at = np.flatnonzero((rough > -np.inf) & (rough >= (-np.partition(-rough, k - 1)[k - 1] if len(x) >= k else -np.inf)))
                s = inner(x[at], q[None])
                first = np.lexsort((ids[at], -s))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([q_id] * len(first), pa.int64()), pa.array(ids[at][first]), pa.array(s[first])], ["query_id", "vec_id", "score"])

    # what the sample holds is found too, though its cells be far; the rest of the plan keeps to one shuffle by query
    shape = "query_id long, vec_id long, score double"
    found = stream.mapInArrow(answer, shape).unionByName(queries.mapInArrow(from_sample, shape)).repartition("query_id").dropDuplicates()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
