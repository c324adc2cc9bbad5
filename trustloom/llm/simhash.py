"""Operator 10: near-duplicates by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at
most four bits differ in at most one bit in one of them, so they share a variant of that
segment in which one bit is a wildcard. Variants are indexed, equal variants meet, and
each meeting is verified on all 64 bits. Equal fingerprints are collapsed first. Inside
a bucket only a spanning forest of the links is kept, so rows grow with the bucket and
not with its square; buckets over `split_at` are first dealt again by five pieces of
the bits outside the segment, one of which any linked pair must share. What a bucket
holds then is distinct fingerprints alike in two parts at least, eight bytes each.

`alike` groups texts by the similarity (Jaccard) of their sets of shingles instead.
Fingerprints within four bits bring pairs from about 0.93 together; texts of 0.8 differ
in some ten of 64 bits, where no segment with one wildcard is selective any more. So it
adds candidates from bands of smallest hashes, and holds candidates of either kind
against the whole shingle sets: first few of each bucket, so many as would connect it, and
then, of buckets that this left in parts, all pairs across the parts. These are compared
where a bucket's sets meet and are never rows; what comes out is fewer links than a bucket
has nodes. So whatever meets in a bucket and is similar enough ends in one group.

Null and empty texts have fingerprint zero and no shingles, and link like any other.
Repeated rows share a fingerprint. A null doc_id takes part but names no component; a
component with no other id has a null component_id. Texts of any length are read whole.
Only doc_id and text are looked at, whatever other columns are called. Empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.llm.common import cut, cut_few, hot_join, if_small, list_array, replace_columns, schema_with, table

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
SPLIT_AT = 4096
#: of `alike`: texts of 0.8 meet in some band with a chance of 0.995, of 0.85 with 0.9999
BANDS, ROWS = 24, 7
TILE_ROWS, TILE_MEMBERS = 4096, 1 << 22  # of a part of a bucket; two parts meet in a task


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of fewer words than `width` the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    return np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, starts[width:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4, column: str = "fp") -> DataFrame:
    """Add `column` long: the fingerprint's 64 bits, read as a signed number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            bits = np.array([fingerprint(t, width) for t in texts], np.uint64)
            yield replace_columns(batch, {column: pa.array(bits.view(np.int64), pa.int64())})

    return docs.mapInArrow(run, schema_with(docs, f"{column} long"))


def _variants(column: str):
    """(segment, wildcard) and the segment with that bit cleared, as one long per variant."""
    keys = []
    for at, size in SEGMENTS:
        part = F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit((1 << size) - 1))
        for bit in range(size):
            cleared = part.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << bit)))
            keys.append(F.lit((at + bit) << 32) + cleared)
    return F.array(*keys)


def _pieces(column: str, position):
    """Five pieces of the bits outside the segment of `position`, each tagged by its place."""
    rest = None
    for at, size in SEGMENTS:
        others = [b for b in range(64) if not at <= b < at + size]
        tags = []
        for k, group in enumerate(np.array_split(others, MAX_BITS + 1)):
            mask = sum(1 << int(b) for b in group)
            signed = mask - (1 << 64) if mask >> 63 else mask
            tags.append(F.xxhash64(F.col(column).bitwiseAND(F.lit(signed)), F.lit(k)))
        rest = F.array(*tags) if rest is None else F.when(position >= at, F.array(*tags)).otherwise(rest)
    return rest


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(bits: np.ndarray, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within `limit` bits, as positions; n rows give < n links."""
    n = len(bits)
    todo = np.arange(n)
    links = []
    while len(todo):  # breadth first from the first unseen; each one is compared to the rest once
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = _popcount(bits[todo] ^ bits[at]) <= limit
            if near.any():
                found = todo[near].tolist()
                links += [(at, f) for f in found]
                queue += found
                todo = todo[~near]
    return links


def every_pair(bits: np.ndarray, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """All pairs within `limit` bits, as positions."""
    return [(i, i + 1 + j) for i in range(len(bits) - 1) for j in np.flatnonzero(_popcount(bits[i + 1:] ^ bits[i]) <= limit).tolist()]


def _bucket_links(batches, of=forest):
    """Rows sorted by (k, p); links of every run of equal keys, runs carried over batches."""
    def links(k, p, fp):
        change = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(k)]
        size = ends - starts
        a, b = [], []
        for s in starts[size == 2].reshape(1, -1):
            near = _popcount(fp[s] ^ fp[s + 1]) <= MAX_BITS
            a.append(fp[s][near])
            b.append(fp[s + 1][near])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            found = of(fp[s:e])
            if found:
                i, j = np.array(found).T
                a.append(fp[s:e][i])
                b.append(fp[s:e][j])
        a = np.concatenate(a).view(np.int64)
        b = np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[tuple] = []  # pieces of the run of the last key
    for batch in batches:
        k, p = (batch.column(i).to_numpy() for i in (0, 1))
        fp = batch.column(2).to_numpy().view(np.uint64)
        if not len(k):
            continue
        if held and (k[-1], p[-1]) == (held[-1][0][-1], held[-1][1][-1]):
            held.append((k, p, fp))
            continue
        k, p, fp = (np.concatenate(c) for c in zip(*held, (k, p, fp)))
        change = np.flatnonzero((k != k[-1]) | (p != p[-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield links(k[:last], p[:last], fp[:last])
        held = [(k[last:], p[last:], fp[last:])]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held)))


def links(distinct: DataFrame, split_at: int = SPLIT_AT, of=forest) -> DataFrame:
    """(a, b) with a < b: links that connect whatever lies within four bits of each other, or with `every_pair` all of them."""
    keyed = distinct.select("fp", F.explode(_variants("fp")).alias("k"))
    large = keyed.groupBy("k").count().filter(F.col("count") > split_at).select("k", F.lit(True).alias("large"))
    position = F.shiftright(F.col("k"), 32)
    dealt = keyed.join(large, "k", "left").select(
        "k", F.explode(F.when(F.col("large"), _pieces("fp", position)).otherwise(F.array(F.lit(0).cast("long")))).alias("p"), "fp"
    )
    return dealt.repartition("k", "p").sortWithinPartitions("k", "p").mapInArrow(lambda batches: _bucket_links(batches, of), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node with a link: alternating large and small stars to a fixed point."""
    now = cut_few(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        few = now.rdd.getNumPartitions()  # links never grow in number, so nor need the parts that a step leaves
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        down = large.filter("u < v").coalesce(few).distinct().coalesce(few)
        small_min = down.groupBy("v").agg(F.min("u").alias("m")).coalesce(few)
        small = down.join(small_min, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v").coalesce(few)
        after = cut_few(small.union(small_min.select(F.col("m").alias("u"), "v")).distinct())
        # a node under two parents, or a parent that has a parent, means another round
        open_ = after.groupBy("v").count().filter("count > 1").limit(1).count() or after.join(
            after.select(F.col("v").alias("u")).distinct(), "u", "left_semi"
        ).limit(1).count()
        if not open_:
            return after.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        now = after


def near_duplicates(docs: DataFrame, width: int = 4, split_at: int = SPLIT_AT) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    member = components(links(distinct.select("fp"), split_at))
    rooted = cut(distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_print = hot_join(rooted.select("fp", "root"), named, "root").select("fp", "component_id")
    return hot_join(prints, cut(of_print), "fp").select("doc_id", "fp", "component_id")


_FACTORS, _TERMS = (np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)).astype(np.uint32)


def _bands(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each of the smallest under ROWS permutations."""
    h, least = (h >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 256):
        m = h[at:at + 256, None] * _FACTORS
        m += _TERMS
        np.minimum(least, m.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, _text, text) without the text: the name of its set of shingles, its fingerprint and its band keys."""

    def run(batches):
        for batch in batches:
            ids, prints, keys, sizes = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_hashes(text, width)
                prints.append(majority(h))
                h = np.unique(h)
                sizes.append(len(h))
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), 5))
                keys.append(_bands(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.concatenate(keys or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], signed(ids), signed(prints), pa.array(sizes, pa.int32()), list_array(flat, [len(k) for k in keys], pa.int64())],
                                             ["doc_id", "_text", "_id", "_fp", "_n", "_keys"])

    schema = StructType(docs.schema.fields[:2] + StructType.fromDDL("_id long, _fp long, _n int, _keys array<bigint>").fields)
    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _set) of texts: the name of the set of shingles, and its hashes, 32 bits each, sorted."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), 5) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([np.sort((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in sets], pa.binary())], ["_id", "_set"])

    return docs.select("text").mapInArrow(run, "_id long, _set binary").groupBy("_id").agg(F.first("_set").alias("_set"))


def _jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of pairs whose sets are at least as similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                both = 0
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(y):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("_id").alias("a"), F.col("_set").alias("x"))
    right = sets.select(F.col("_id").alias("b"), F.col("_set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike(docs: DataFrame, width: int = 5, similarity: float = 0.8, split_at: int = SPLIT_AT) -> DataFrame:
    """(doc_id, _text, _root) per row: hash of its text, the least name of its group."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    prints = cut_few(_prints(texts, width))
    nodes = cut_few(prints.groupBy("_id").agg(F.first("_fp").alias("_fp"), F.first("_n").alias("_n"), F.first("_keys").alias("_keys"), F.min("_text").alias("_text")))
    # a bucket's first and last take part in its candidates, whatever its size
    band = nodes.select("_id", F.explode("_keys").alias("k"))
    ends = band.groupBy("k").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).filter("lo < hi")
    met = hot_join(band, cut_few(ends), "k")
    by_band = met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("_id").alias("b")), F.struct(F.col("_id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*")
    print_ends = cut_few(nodes.groupBy("_fp").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")))
    same = hot_join(nodes.select("_id", "_fp"), print_ends.filter("lo < hi"), "_fp").select(F.col("lo").alias("a"), F.col("_id").alias("b"))
    bits = cut_few(links(print_ends.select(F.col("_fp").alias("fp")), split_at))
    near = bits.join(print_ends.select(F.col("_fp").alias("a"), F.col("lo").alias("x")), "a").join(print_ends.select(F.col("_fp").alias("b"), F.col("lo").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = cut_few(by_band.union(same).union(near).filter("a < b").distinct())

    def sets_of(named):
        # only texts that take part in a candidate are read again
        wanted = cut_few(nodes.select("_id", "_text").join(named, "_id", "left_semi").select("_text").distinct())
        return _sets(texts.join(if_small(wanted), "_text", "left_semi"), width)

    def verified(pairs):
        return cut_few(_jaccard_links(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()), similarity))

    def rooted(linked):
        return cut_few(nodes.select("_id").join(components(linked).withColumnRenamed("fp", "_id"), "_id", "left").select("_id", F.coalesce("root", "_id").alias("_root")))

    linked = verified(first)
    root = rooted(linked)
    rest = cut_few(_across(nodes, root, band, bits, similarity, sets_of))
    if rest.limit(1).count():
        root = rooted(linked.union(rest))
    return hot_join(prints.select("doc_id", "_text", "_id"), root, "_id").select("doc_id", "_text", "_root")


def _across(nodes: DataFrame, root: DataFrame, band: DataFrame, bits: DataFrame, similarity: float, sets_of) -> DataFrame:
    """(a, b): links that connect roots wherever nodes of several, similar enough, meet in a band or within four bits.

    The pairs of a bucket are never rows: its nodes are sent with their sets, and compared where they meet. Large buckets
    are dealt to parts, of which any two meet in a task.
    """
    of = cut_few(nodes.select("_id", "_fp", "_n").filter("_n > 0").join(root, "_id"))

    def opened(rows, kind):
        """Rows (k, _id) of the keys whose nodes are of several roots."""
        full = cut_few(hot_join(rows, of.select("_id", "_n", "_root"), "_id"))
        parts = full.groupBy("k").agg(F.min("_root").alias("least"), F.max("_root").alias("most"), F.count("*").alias("n"), F.sum("_n").alias("members")).filter("least < most")
        parts = parts.select("k", F.ceil(F.greatest(F.col("n") / TILE_ROWS, F.col("members") / TILE_MEMBERS)).alias("parts"))
        return full.join(if_small(cut_few(parts)), "k").select(F.lit(kind).alias("kind"), "k", "_id", "parts")

    # of fingerprints that bits connect, all within four bits where this holds several roots
    group = components(bits).select(F.col("fp").alias("_fp"), F.col("root").alias("k"))
    group = group.union(group.select(F.col("k").alias("_fp"), "k").distinct()).distinct()
    loose = cut_few(opened(band, 0).union(opened(of.select(F.col("_fp").alias("k"), "_id"), 0)).union(opened(of.join(group, "_fp").select("k", "_id"), 1)))
    whole = of.join(sets_of(loose.select("_id").distinct()), "_id")
    part = F.pmod(F.xxhash64("_id"), F.col("parts"))
    dealt = loose.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = dealt.select("kind", "k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "_id").join(whole, "_id")
    key = ["kind", "k", "i", "j"]
    tiles = tiles.select(*key, "part", "_id", "_root", "_fp", "_set").repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        held = []
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in range(4)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
            found = []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                piece = batch.slice(lo, hi - lo)
                if held and any(held[0].column(n)[0] != piece.column(n)[0] for n in range(4)):
                    found += tile_links(pa.Table.from_batches(held), similarity)
                    held = []
                held.append(piece)
            yield _links_batch(found)
        if held:
            yield _links_batch(tile_links(pa.Table.from_batches(held), similarity))

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(found, np.int64).reshape(-1, 2)).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def tile_links(tile: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the roots of a tile (kind, k, i, j, part, _id, _root, _fp, _set) by pairs similar enough: fewer than it has rows."""
    near, across = tile.column(0)[0].as_py() == 1, tile.column(2)[0].as_py() != tile.column(3)[0].as_py()
    part, ids, root = (tile.column(n).to_numpy().copy() for n in (4, 5, 6))
    bits = tile.column(7).to_numpy().view(np.uint64)
    sets = [np.frombuffer(x, np.uint32) for x in tile.column(8).to_pylist()]
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    names, named = np.unique(np.concatenate(sets), return_inverse=True)
    has, links = np.zeros(len(names), bool), []
    for x in range(len(ids) - 1):
        rest = slice(x + 1, None)
        ok = (root[rest] != root[x]) & (np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]))
        if across:
            ok &= part[rest] != part[x]
        if near:
            ok &= _popcount(bits[rest] ^ bits[x]) <= MAX_BITS
        some = np.flatnonzero(ok) + x + 1
        if not len(some):
            continue
        mine = named[starts[x]:starts[x] + size[x]]
        has[mine] = True
        if 8 * len(some) > len(ids) - x:
            both = np.add.reduceat(has[named[starts[x + 1]:]], starts[x + 1:] - starts[x + 1], dtype=np.int64)[some - x - 1]
        else:
            both = np.array([has[named[starts[y]:starts[y] + size[y]]].sum() for y in some.tolist()])
        has[mine] = False
        for y in some[both >= similarity * (size[x] + size[some] - both)].tolist():
            if root[y] != root[x]:
                links.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]
    return links


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of docs alike: that of the least doc_id (null ids last), then text hash; of equal rows one."""
    named = cut(alike(docs, width, similarity))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    kept = named.groupBy("_root").agg(F.min(key).alias("r")).select(F.col("r.doc_id").alias("d"), F.col("r._text").alias("t"))
    match = F.col("_doc").eqNullSafe(F.col("d")) & (F.col("_text") == F.col("t"))
    rows = named.groupBy("doc_id", "_text").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "_doc")
    gone = cut(rows.join(kept, match, "left_anti").select(F.col("_doc").alias("d"), F.col("_text").alias("t")))
    again = cut(rows.filter("n > 1").select(F.col("_doc").alias("d"), F.col("_text").alias("t")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    chosen = marked.join(if_small(gone), match, "left_anti")
    if not again.limit(1).count():
        return chosen.select("_all.*")
    once = chosen.join(if_small(again), match, "left_anti").select("_all")
    twice = chosen.join(if_small(again), match, "left_semi").groupBy("_doc", "_text").agg(F.first("_all").alias("_all")).select("_all")
    return once.union(twice).select("_all.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
