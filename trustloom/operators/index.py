"""A keyword index that is kept: positional postings in blocks, top k by the blocks' best scores.

Records of an `add` are a segment. In it they are numbered, and every `STRETCH` numbers in
a row share a stretch; a block holds a term's postings of one stretch (numbers, counts,
record sizes, places; Parquet codes the integers as deltas) and, in columns of their own,
how many there are, the highest count and the smallest size. Blocks of all terms begin and
end at the same numbers, so the best score that a stretch can give a query follows from
short columns alone. A few stretches of the highest bounds are scored first; of the others
only those whose bound reaches the k-th score so far are read.

Sizes and counts of terms change with every commit, so blocks store no scores, but what
bounds them. Removed records stay in their blocks until `compact`; their numbers are listed and left out,
also where a term's records are counted. An `add` of ids that are there replaces them.
Commits are those of `store.Log`: whole, or not at all.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.frames import reachable, settle
from trustloom.operators.search import B, K1, LEAST_IDF, phrases, ranked, terms
from trustloom.store import Conflict, Log

STRETCH = 4096
ROWS = 4096  # of parts, sent on at a time
SEEDS = 4  # stretches a query that are scored first
CLOSE = 1e-5  # scores are rounded to six digits
BLOCKS = ("segment int, term string, stretch long, n long, most int, least long, docs array<int>, counts array<int>, sizes array<long>, places array<array<int>>")
PARTS = "term string, stretch long, docs array<int>, counts array<int>, sizes array<long>, places array<array<int>>"
PLACES = 1 << 20  # of terms that a part is made of, and those of one more batch
DOCS = "segment int, doc long, memory_id string, size long"


def bm25(f: Column, size: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * size / average))


def _parts(batches, size: int, most: int):
    """Parts of blocks, of records (doc, size, a, b) in the order of their numbers: places counted through a, a gap, so that no phrase runs over both, and b."""
    held, n = [], 0
    for batch in batches:
        stretch = batch.column(0).to_numpy() // size
        for at in np.unique(stretch):
            mine = pa.array(np.flatnonzero(stretch == at))
            if held and (held[0][0] != at or n > most):
                yield from _part(held, size)
                held, n = [], 0
            rows = batch.take(mine)
            held.append((at, rows))
            n += len(pc.list_flatten(rows.column(2))) + len(pc.list_flatten(rows.column(3)))
    if held:
        yield from _part(held, size)


def _part(held, stretch: int):
    rows = pa.Table.from_batches([r for _, r in held]).combine_chunks()
    first = lambda name: rows.column(name).combine_chunks()
    doc, size, a, b = first("doc").to_numpy(), first("size").to_numpy(), first("a"), first("b")
    sizes_a = pc.list_value_length(a).to_numpy(zero_copy_only=False)
    row, place, words = [], [], []
    for column, start in ((a, np.zeros(len(doc), np.int64)), (b, sizes_a + 1)):
        n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(doc)), n)
        row.append(owner)
        place.append(np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + start[owner])
        words.append(pc.list_flatten(column))
    code = pa.concat_arrays(words).dictionary_encode()
    if not len(code):
        return
    term, row, place = code.indices.to_numpy(), np.concatenate(row), np.concatenate(place).astype(np.int32)
    by = np.lexsort((place, doc[row], term))
    term, row, place = term[by], row[by], place[by]
    begins = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])))  # a posting's first place
    ends = np.append(begins[1:], len(term))
    of, which = term[begins], row[begins]
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))  # a term's first posting
    bounds = pa.array(np.append(heads, len(of)).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(bounds, values)
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(term)).astype(np.int32)), pa.array(place))
    out = pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(of[heads])), pa.array(np.full(len(heads), held[0][0], np.int64)), listed(pa.array((doc[which] % stretch).astype(np.int32))),
                                      listed(pa.array((ends - begins).astype(np.int32))), listed(pa.array(size[which])), listed(places)], ["term", "stretch", "docs", "counts", "sizes", "places"])
    for at in range(0, out.num_rows, ROWS):
        yield out.slice(at, ROWS)


class Index(Log):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, {"segments": [], "gone": []})

    def _named(self, manifest: dict) -> set[str]:
        return {s["folder"] for s in manifest["segments"]} | set(manifest["gone"])

    # -- what is kept

    def _read(self, manifest: dict, name: str, shape: str) -> DataFrame:
        paths = [f"{self.root}/data/{s['folder']}/{name}" for s in manifest["segments"]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _gone(self, manifest: dict) -> DataFrame:
        shape = "segment int, doc long"
        paths = [f"{self.root}/data/{folder}" for folder in manifest["gone"]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _live(self, manifest: dict) -> DataFrame:
        return self._read(manifest, "docs", DOCS).join(self._gone(manifest), ["segment", "doc"], "left_anti")

    # -- changes

    def _segment(self, rows: DataFrame, number: int, folder: str) -> None:
        at = f"{self.root}/data/{folder}"
        a, b = terms(F.coalesce("content", F.lit(""))), terms(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
        read = rows.select("memory_id", a.alias("a"), b.alias("b")).withColumn("doc", F.monotonically_increasing_id()).withColumn("size", (F.size("a") + F.size("b")).cast("long"))
        read.write.parquet(f"{at}/staged")  # numbers hold from here on
        read = self.spark.read.parquet(f"{at}/staged")
        read.select(F.lit(number).alias("segment"), "doc", "memory_id", "size").write.parquet(f"{at}/docs")
        # what a task reads in a row is put in blocks there; only parts of blocks are dealt out, not each place of a term
        reachable(self.spark)
        read.select("doc", "size", "a", "b").mapInArrow(functools.partial(_parts, size=STRETCH, most=PLACES), PARTS).write.parquet(f"{at}/parts")
        part = F.struct("docs", "counts", "sizes", "places")
        of = self.spark.read.schema(PARTS).parquet(f"{at}/parts").repartitionByRange("term", "stretch").groupBy("term", "stretch").agg(F.array_sort(F.collect_list(part)).alias("r"))
        whole = of.select("term", "stretch", *[F.flatten(F.col(f"r.{name}")).alias(name) for name in ("docs", "counts", "sizes", "places")])
        block = whole.select(F.lit(number).alias("segment"), "term", "stretch", F.size("docs").cast("long").alias("n"), F.array_max("counts").alias("most"), F.array_min("sizes").alias("least"),
                             "docs", "counts", "sizes", "places")
        out = block.sortWithinPartitions("term", "stretch").write.option("parquet.writer.version", "v2").option("parquet.bloom.filter.enabled#term", "true")
        out.parquet(f"{at}/blocks")
        self._drop(f"data/{folder}/staged")
        self._drop(f"data/{folder}/parts")

    def _commit(self, did: str, change) -> int:
        """Publish what `change` adds; segments and removals of others stand beside it, unless segments were put together."""
        for _ in range(20):
            base = self.manifest()
            made = change(base)
            if not made:
                return base["version"]
            new = base | made | {"version": base["version"] + 1, "did": did}
            if self._publish(new):
                return new["version"]
        raise Conflict(did)

    def _removal(self, base: dict, ids: DataFrame) -> str | None:
        folder = f"gone-{uuid.uuid4().hex}"
        hit = self._live(base).join(ids.select("memory_id").distinct(), "memory_id", "left_semi").select("segment", "doc")
        hit.write.parquet(f"{self.root}/data/{folder}")
        if self.spark.read.schema("segment int, doc long").parquet(f"{self.root}/data/{folder}").limit(1).count():
            return folder
        self._drop(f"data/{folder}")
        return None

    def add(self, rows: DataFrame) -> None:
        """Index rows (memory_id, content, tags); of ids that are there the new row replaces the old one. Ids stand once in rows."""
        def change(base):
            number, folder = max([s["number"] for s in base["segments"]], default=-1) + 1, f"segment-{uuid.uuid4().hex}"
            self._segment(rows, number, folder)
            removed = self._removal(base, self.spark.read.parquet(f"{self.root}/data/{folder}/docs")) if base["segments"] else None
            return {"segments": base["segments"] + [{"number": number, "folder": folder}], "gone": base["gone"] + ([removed] if removed else [])}

        self._commit("add", change)

    def delete(self, ids: DataFrame) -> None:
        """Take out ids; unknown ones are passed over."""
        def change(base):
            removed = self._removal(base, ids)
            return removed and {"gone": base["gone"] + [removed]}

        self._commit("delete", change)

    def compact(self) -> None:
        """All segments as one, without removed records; their stretches keep their numbers, spread by segment."""
        def change(base):
            if len(base["segments"]) < 2 and not base["gone"]:
                return None
            number, folder = max(s["number"] for s in base["segments"]) + 1, f"segment-{uuid.uuid4().hex}"
            at, live = f"{self.root}/data/{folder}", self._live(base)
            # numbers anew, dense again; blocks follow their records
            live.select(F.monotonically_increasing_id().alias("doc"), "segment", F.col("doc").alias("old"), "memory_id", "size").write.parquet(f"{at}/staged")
            numbered = self.spark.read.parquet(f"{at}/staged")
            numbered.select(F.lit(number).alias("segment"), "doc", "memory_id", "size").write.parquet(f"{at}/docs")
            each = opened(self._read(base, "blocks", BLOCKS)).withColumnRenamed("doc", "old").join(numbered.select("segment", "old", "doc"), ["segment", "old"])
            row = F.struct((F.col("doc") % STRETCH).cast("int").alias("doc"), "count", "size", "places")
            block = each.groupBy("term", F.floor(F.col("doc") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(row)).alias("r"))
            block = block.select(F.lit(number).alias("segment"), "term", "stretch", F.size("r").cast("long").alias("n"), F.array_max("r.count").alias("most"), F.array_min("r.size").alias("least"),
                                 F.col("r.doc").alias("docs"), F.col("r.count").alias("counts"), F.col("r.size").alias("sizes"), F.col("r.places").alias("places"))
            block.repartitionByRange("term", "stretch").sortWithinPartitions("term", "stretch").write.option("parquet.writer.version", "v2").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{at}/blocks")
            self._drop(f"data/{folder}/staged")
            return {"segments": [{"number": number, "folder": folder}], "gone": []}

        self._commit("compact", change)

    # -- questions

    def _blocks(self, manifest: dict, wanted: list[str]) -> DataFrame:
        return self._read(manifest, "blocks", BLOCKS).filter(F.col("term").isin(wanted))

    def top(self, queries: list[tuple[str, str]], k: int) -> DataFrame:
        """(query_id, rank, memory_id, score): BM25 over records that hold every phrase, ties to the smaller id."""
        spark, at = self.spark, self.manifest()
        asked = phrases(spark, queries).collect()  # of stated queries, few
        nothing = spark.createDataFrame([], "query_id string, rank int, memory_id string, score double")
        if not asked or k <= 0:
            return nothing
        gone = self._gone(at)
        sums = self._live(at).agg(F.count("*").alias("n"), F.avg("size").alias("average")).first()
        if not sums.n:
            return nothing
        single = {(r.query_id, r.phrase): r.term for r in asked if r.n == 1}
        lists = spark.createDataFrame([(q, p, t) for (q, p), t in single.items()], "query_id string, phrase int, term string")
        met = self._blocks(at, sorted(set(single.values()))).join(F.broadcast(lists), "term")
        shape = ["query_id", "phrase", "segment", "stretch", "n", "most", "least", "docs", "counts", "sizes"]
        blocks = met.select(*shape)
        long = [r for r in asked if r.n > 1]
        if long:  # places of several terms in a row, read whole and put in blocks of the same shape
            parts = F.broadcast(spark.createDataFrame([(r.query_id, r.phrase, r.j, r.term, r.n) for r in long], "query_id string, phrase int, j int, term string, k int"))
            each = opened(self._blocks(at, sorted({r.term for r in long}))).join(parts, "term").select("query_id", "phrase", "k", "j", "segment", "doc", "size", F.explode("places").alias("at"))
            starts = each.groupBy("query_id", "phrase", "k", "segment", "doc", "size", (F.col("at") - F.col("j")).alias("start")).agg(F.count_distinct("j").alias("met")).filter("met = k")
            often = starts.groupBy("query_id", "phrase", "segment", "doc", "size").agg(F.count("*").cast("int").alias("count"))
            row = F.struct((F.col("doc") % STRETCH).cast("int").alias("doc"), "count", "size")
            made = often.groupBy("query_id", "phrase", "segment", F.floor(F.col("doc") / STRETCH).alias("stretch")).agg(F.array_sort(F.collect_list(row)).alias("r"))
            made = settle(made.select("query_id", "phrase", "segment", "stretch", F.size("r").cast("long").alias("n"), F.array_max("r.count").alias("most"), F.array_min("r.size").alias("least"),
                                      F.col("r.doc").alias("docs"), F.col("r.count").alias("counts"), F.col("r.size").alias("sizes")))
            blocks = blocks.unionByName(made)
        # records of every phrase, without removed ones: these only in the stretches that have some
        have = blocks.groupBy("query_id", "phrase").agg(F.sum("n").alias("n"))
        if at["gone"]:
            touched = gone.select("segment", F.floor(F.col("doc") / STRETCH).alias("stretch")).distinct()
            lost = opened(blocks.join(touched, ["segment", "stretch"], "left_semi"), ("query_id", "phrase")).join(gone, ["segment", "doc"], "left_semi").groupBy("query_id", "phrase").agg(F.count("*").alias("lost"))
            have = have.join(lost, ["query_id", "phrase"], "left").select("query_id", "phrase", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
        N, average = F.lit(sums.n), F.lit(sums.average)
        weights = have.filter("n > 0").select("query_id", "phrase", F.greatest(F.lit(LEAST_IDF), F.log((N - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("idf")).collect()  # a row a phrase
        count = {r.query_id: r.n_phrases for r in asked}
        idf = F.broadcast(spark.createDataFrame([(r.query_id, r.phrase, r.idf, count[r.query_id]) for r in weights], "query_id string, phrase int, idf double, wanted int"))
        blocks = blocks.join(idf, ["query_id", "phrase"])
        key = ["query_id", "segment", "stretch"]
        bounds = blocks.groupBy(*key).agg(F.count("*").alias("met"), F.first("wanted").alias("wanted"), F.sum(F.col("idf") * bm25(F.col("most"), F.col("least"), average)).alias("bound")).filter("met = wanted").select(*key, "bound")
        bounds = settle(bounds)
        first = ranked(bounds, [F.desc("bound"), "segment", "stretch"], SEEDS).select(*key)

        def scored(where: DataFrame) -> DataFrame:
            each = opened(blocks.join(where, key, "left_semi"), ("query_id", "idf", "wanted"))
            each = each.groupBy("query_id", "segment", "doc").agg(F.count("*").alias("met"), F.first("wanted").alias("wanted"), F.round(F.sum(F.col("idf") * bm25(F.col("count"), F.col("size"), average)), 6).alias("score"))
            return each.filter("met = wanted").join(gone, ["segment", "doc"], "left_anti").select("query_id", "segment", "doc", "score")

        best = settle(scored(first))
        kth = ranked(best, [F.desc("score"), "segment", "doc"], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        more = bounds.join(first, key, "left_anti").join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - CLOSE)).select(*key)
        self.read_stretches = bounds, first, more
        every = best.unionByName(scored(more))
        top = every.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= k)  # ties stay until their ids are known
        named = top.join(self._read(at, "docs", DOCS).select("segment", "doc", "memory_id"), ["segment", "doc"])
        return ranked(named, [F.desc("score"), "memory_id"], k).select("query_id", "rank", "memory_id", "score")


def opened(blocks: DataFrame, keep=("term",)) -> DataFrame:
    """A row each posting of blocks."""
    zipped = ["docs", "counts", "sizes"] + (["places"] if "places" in blocks.columns else [])
    p = blocks.select(*keep, "segment", "stretch", F.explode(F.arrays_zip(*zipped)).alias("p"))
    return p.select(*keep, "segment", (F.col("stretch") * STRETCH + F.col("p.docs")).alias("doc"), F.col("p.counts").alias("count"), F.col("p.sizes").alias("size"), *([F.col("p.places").alias("places")] if "places" in zipped else []))
