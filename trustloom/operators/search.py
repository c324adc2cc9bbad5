"""Vector, keyword, trigram and recency search for a stated set of queries against all rows."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.frames import reachable, stored
from trustloom.functions import embed

# fixed values
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"
#: letters with marks and the plain letters that stand for them, by their decompositions
_MARKED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c) != c]
MARKED, PLAIN = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)
QUERY_BLOCK = 4096


def ranked(rows: DataFrame, by: list, k: int, group: str = "query_id") -> DataFrame:
    """The first k of every group, with rank from 1; a partial limit runs before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, *, not_self: bool = False, vector: str = "cells") -> DataFrame:
    """(query_id, rank, memory_id, cosine): cosines rounded to six digits, ties to the smaller id.

    queries (query_id, vector) come in blocks of `QUERY_BLOCK`; rows (memory_id, vector) of another
    width than a query's, or without a vector, take no part. Zero vectors score 0.
    """
    spark = rows.sparkSession
    reachable(spark)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = "query_id string, memory_id string, cosine double"
    out = None
    for block in range(blocks if k > 0 else 0):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = sorted((str(r[0]), r[1]) for r in mine.select("query_id", vector).filter(F.size(vector) > 0).collect())
        if not got:
            continue
        width = len(got[0][1])
        ids, q = [g[0] for g in got if len(g[1]) == width], np.array([g[1] for g in got if len(g[1]) == width], np.float64)
        sent = spark.sparkContext.broadcast((ids, q))

        def run(batches, sent=sent, width=width):
            ids_, q_ = sent.value
            names = np.array(ids_)
            size = np.sqrt((q_ * q_).sum(axis=1))[:, None]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
                own = np.array(batch.column(0).to_pylist())
                length = size * np.sqrt((x * x).sum(axis=1))
                cos = embed.six(np.divide(q_ @ x.T, length, out=np.zeros(length.shape), where=length > 0))
                if not_self:
                    cos[names[:, None] == own] = -2
                m = min(k, cos.shape[1])
                least = -np.partition(-cos, m - 1, axis=1)[:, m - 1:m]  # ties at the cut go on
                r, c = np.nonzero((cos >= least) & (cos > -2))
                if len(r) > 4 * k * len(ids_):  # many ties: cut by id here
                    by = np.lexsort((own[c], -cos[r, c], r))
                    r, c = r[by], c[by]
                    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(names[r].tolist(), pa.string()), pa.array(own[c].tolist(), pa.string()), pa.array(cos[r, c])],
                                                 ["query_id", "memory_id", "cosine"])

        fits = rows.filter((F.size(vector) == width) & F.col("memory_id").isNotNull()).select(F.col("memory_id").cast("string"), vector)
        part = fits.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, [F.desc("cosine"), "memory_id"], max(k, 0)).select("query_id", "rank", "memory_id", "cosine")


def terms(text: Column) -> Column:
    """Lower-case letters and digits without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.translate(text, MARKED, PLAIN)), MARKED, PLAIN), F.lit(TOKEN), F.lit(0))


def places(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """(memory_id, size, near): how many terms content and tags have, and where the wanted ones stand.

    Places in tags follow those in content after a gap, so that no phrase runs over both.
    """
    t = rows.select("memory_id", terms(F.coalesce("content", F.lit(""))).alias("a"), terms(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")).alias("b"))
    place = lambda column, start: F.transform(column, lambda x, i: F.struct(x.alias("term"), (i + start).alias("at")))
    every = F.concat(place(F.col("a"), F.lit(0)), place(F.col("b"), F.size("a") + 1))
    return t.select("memory_id", (F.size("a") + F.size("b")).cast("long").alias("size"), F.filter(every, lambda p: p["term"].isin(wanted)).alias("near"))


def phrases(spark: SparkSession, queries: list[tuple[str, str]]) -> DataFrame:
    """(query_id, phrase, j, term, n, n_phrases): white space parts a query into phrases, marks part a phrase into terms.

    Phrases without letters or digits ask for nothing; a query of such alone finds nothing.
    """
    rows = spark.createDataFrame([(q, k, part) for q, text in queries for k, part in enumerate(text.split())], "query_id string, phrase int, part string")
    rows = rows.select("query_id", "phrase", terms(F.col("part")).alias("t")).filter(F.size("t") > 0)
    rows = rows.withColumn("n", F.size("t")).withColumn("n_phrases", F.count("*").over(Window.partitionBy("query_id")))
    return rows.select("query_id", "phrase", "n", "n_phrases", F.posexplode("t").alias("j", "term"))


def keyword(rows: DataFrame, queries: list[tuple[str, str]], k: int) -> DataFrame:
    """(query_id, rank, memory_id, score): BM25 over rows that hold every phrase, ties to the smaller id."""
    spark = rows.sparkSession
    of: dict[tuple, dict[int, str]] = {}
    for r in phrases(spark, queries).collect():  # of stated queries, few
        of.setdefault((r.query_id, r.phrase, r.n_phrases), {})[r.j] = r.term
    if not of or k <= 0:
        return spark.createDataFrame([], "query_id string, rank int, memory_id string, score double")
    # phrases are counted where a record is read: no places are shuffled, and texts are parted into terms once
    found = F.filter(F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(p).alias("phrase"), F.lit(n).cast("long").alias("n_phrases"), _often([of[q, p, n][j] for j in sorted(of[q, p, n])]).alias("f")) for q, p, n in sorted(of)]),
                     lambda h: h["f"] > 0)
    read = stored(places(rows, sorted({term for of_ in of.values() for term in of_.values()})).select("memory_id", "size", found.alias("found")))
    totals = read.agg(F.count("*").alias("N"), F.avg("size").alias("average"))
    often = read.select("memory_id", "size", F.explode("found").alias("h")).select("memory_id", "size", "h.*")
    have = often.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    whole = often.join(F.broadcast(have), ["query_id", "phrase"]).join(F.broadcast(totals))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("average")))
    scored = whole.groupBy("query_id", "memory_id", "n_phrases").agg(F.count("*").alias("met"), F.sum(part).alias("s")).filter("met = n_phrases")
    scored = scored.select("query_id", "memory_id", F.round("s", 6).alias("score"))
    return ranked(scored, [F.desc("score"), "memory_id"], k).select("query_id", "rank", "memory_id", "score")


def _often(phrase: list[str]) -> Column:
    """How often a phrase stands in `near` (term, at)."""
    follows = lambda p, j: F.exists("near", lambda x: (x["term"] == phrase[j]) & (x["at"] == p["at"] + j))

    def starts(p):
        out = p["term"] == phrase[0]
        for j in range(1, len(phrase)):
            out = out & follows(p, j)
        return out

    return F.size(F.filter("near", starts)).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of every word between two spaces before and one after."""
    padded = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def trigram(rows: DataFrame, queries: list[tuple[str, str]], k: int, least: float = 0.3) -> DataFrame:
    """(query_id, rank, memory_id, score): shared trigrams over all, those above `least`; ties to the smaller id."""
    from trustloom.operators import setsim

    asked = rows.sparkSession.createDataFrame(queries, "query_id string, text string").select("query_id", trigrams(F.col("text")).alias("tokens"))
    return setsim.top(asked, rows.select("memory_id", trigrams(F.coalesce("content", F.lit(""))).alias("tokens")), k, least)


def recent(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("created_s"), F.desc("memory_id")).limit(max(k, 0))
