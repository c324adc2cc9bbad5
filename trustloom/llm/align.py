"""Operator 13: cross-tokenizer alignment by a cogroup of postings.

A byte-level BPE (A, of space+text) and a piece BPE (B, of text) cut the same bytes. Where
tokens of both end, a group ends; an A and a B token whose bytes overlap are linked.

Neither tokenizer joins what lies on both sides of a place where a letter or mark is
followed by a space, a line feed or a tab: pieces of A begin there by its pattern, and no
piece of B holds such a place (`Pair` checks the vocabulary). So a text falls into units
there, and the links, groups and digests of a text are those of its units, worked out once
a distinct unit. Texts with other white space (`EXOTIC`) are units as a whole.

Pass one writes, per document, its counts and digest, and, per task and bucket of A ids,
postings: each id pair, in how many of the task's documents it is linked, in which ones
and how often. Postings are then shuffled by bucket (buckets of many are dealt to slices)
with the corpus-wide counts of the bucket's pairs, each task reads a sorted stream, the
counts before the postings, takes the maxima of its A ids, and gives every document's
share, which is summed by document.

Null and empty texts, and texts whose joined tokens are not space+text (B reads U+2581 as
a space), have zeros and an empty digest, and no links. Rows that share a doc_id, or have
none, count as documents of their own. Other columns are not looked at, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.common import cut, list_array, table

# fixed values: how the byte-level tokenizer cuts a text before it merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile("[ \n\t]+[^ \n\t]*")
#: white space, in anyone's reading, other than that at which units begin
EXOTIC = re.compile("[\r\v\f\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
BUCKETS = 32
READ = 256  # texts read at once
RUN = 512  # units that a tokenizer gets at once
FLUSH = 1_000_000  # links held before a task writes its postings
SLICE = 4_000_000  # postings of a bucket that one task takes on
REMEMBERED = 300_000, 12_000_000  # units held by a worker, and their characters
SEPARATED = ",|;\n"
_HELD: dict[tuple, object] = {}


def _byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """What is known of distinct units: counts, links and the text of their groups."""

    def __init__(self):
        self.of: dict[str, int] = {}
        self.size = 0
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.sound = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.groups: list[bytes] = []

    def add(self, names: list[str], counts, sound, pairs, groups) -> None:
        for name in names:
            self.of[name] = len(self.of)
            self.size += len(name)
        self.counts = np.concatenate([self.counts, counts])
        self.sound = np.concatenate([self.sound, sound])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts[:, 3])])
        self.groups += groups


class Pair:
    """Both tokenizers, and the alignment of runs of units."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        a = json.loads(a_file)
        vocab, marks = a["model"]["vocab"], _byte_of_mark()
        special = {t["content"] for t in a["added_tokens"]}
        ranks = {bytes(marks[m] for m in token): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in a["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of the byte-level vocabulary must follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁\n\t][▁\n\t]", p) for p in pieces):
            raise ValueError("a piece holds a place where units begin")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.width = len(pieces)
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(pieces)))]
        self.n_names = len(names)
        self.said = [n + s.encode() for s in SEPARATED for n in names]

    def align(self, texts: list[str]) -> tuple | None:
        """(counts, sound, pairs, groups) of units that may be read in one run, each begun by a space, line feed or tab; None if one is odd."""
        runs = ["".join(texts[i:i + RUN]) for i in range(0, len(texts), RUN)]
        a = [x for r in runs for x in self.a.encode_ordinary(r)]
        b = [x for r in self.b.encode(["a" + r for r in runs], num_threads=1) for x in r[1:]]
        whole = "".join(runs).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return self._aligned(np.array(a, np.int64), np.array(b, np.int64), np.cumsum([len(t.encode()) for t in texts]))

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple | None:
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        places = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two runs to merge
        places = places[np.append(True, places[1:] != places[:-1])]  # each stretch between two is one link
        at_a, at_b = np.searchsorted(a_end, places), np.searchsorted(b_end, places)
        shared = (a_end[at_a] == places) & (b_end[at_b] == places)
        groups = places[shared]
        n = len(ends)
        if not np.isin(ends, groups).all():
            return None
        per = lambda at: np.bincount(np.searchsorted(ends, at), minlength=n)
        counts = np.stack([per(a_end), per(b_end), per(groups), per(places)], axis=1)
        # the tokens of both, a group's of A before those of B; what stands after each: , | ; or a line feed
        ids, end, side = np.concatenate([a, b]), np.concatenate([a_end, b_end]), np.repeat([0, 1], [len(a), len(b)])
        by = np.argsort(np.searchsorted(groups, end) * 2 + side, kind="stable")
        ids, end, side = ids[by], end[by], side[by]
        last = np.append(side[1:] != side[:-1], True)
        mark = np.where(~last, 0, np.where(side == 0, 1, 2))
        mark[last & (side == 1) & np.isin(end, ends)] = 3
        said = b"".join(map(self.said.__getitem__, (mark * self.n_names + ids).tolist())).split(b"\n")[:-1]
        return counts, np.ones(n, bool), a[at_a] * self.width + b[at_b], said

    def alone(self, text: str) -> tuple:
        """The same of one unit, however odd."""
        a, b = self.a.encode_ordinary(text), self.b.encode("a" + text)[1:]  # of an "a" before a unit, nothing is joined to it
        whole = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            return self._aligned(np.array(a, np.int64), np.array(b, np.int64), np.array([len(whole)]))
        return np.zeros((1, 4), np.int64), np.zeros(1, bool), np.zeros(0, np.int64), [b""]


def _pair(a_file: bytes, b_file: bytes, key: str) -> Pair:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = (Pair(a_file, b_file), Units())
    return _HELD[key]


class Reader:
    """Texts of a task, one batch after another, and the links of those not written yet."""

    def __init__(self, pair: Pair, units: Units):
        self.pair, self.units = pair, units

    def _learn(self, names: list[str]) -> None:
        sound = [u for u in names if u[-1] not in " \n\t" and "▁" not in u and not EXOTIC.search(u)]
        got = self.pair.align(sound) if sound else None
        if sound and got:
            self.units.add(sound, *got)
        for u in names if sound and not got else [u for u in names if u not in self.units.of]:
            self.units.add([u], *self.pair.alone(u))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(counts, groups, pairs, which text each pair is of); a text that is not sound has none."""
        if len(self.units.of) > REMEMBERED[0] or self.units.size > REMEMBERED[1]:
            self.units.__init__()
        cut_up = [[] if not t else [" " + t] if EXOTIC.search(t) else UNIT.findall(" " + t) for t in texts]
        known = self.units
        self._learn(sorted(set().union(*cut_up).difference(known.of)))
        sizes = np.array([len(u) for u in cut_up])
        at = np.fromiter(map(known.of.__getitem__, chain.from_iterable(cut_up)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        sound = np.bincount(doc[~known.sound[at]], minlength=len(texts)) == 0
        counts = np.stack([np.bincount(doc, known.counts[at, k], len(texts)) for k in range(4)], axis=1).astype(np.int64) * sound[:, None]
        groups, start = [], 0
        for size, good in zip(sizes.tolist(), sound.tolist()):
            groups.append(b";".join(map(known.groups.__getitem__, at[start:start + size].tolist())) if good else b"")
            start += size
        keep = sound[doc]
        at, doc = at[keep], doc[keep]
        n = known.counts[at, 3]
        first = np.cumsum(n) - n
        where = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(known.start[at], n)
        pairs, of = known.pairs[where], np.repeat(doc, n)
        return counts, groups, pairs, of


def posted(pairs: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> Iterator[tuple]:
    """(bucket, pairs, documents a pair, documents, multiplicities), each bucket once."""
    key, often = np.unique(pairs * n_docs + doc, return_counts=True)
    pair, doc = key // n_docs, key % n_docs
    bucket = pair // width % BUCKETS
    for b in range(BUCKETS):
        mine = bucket == b
        if mine.any():
            distinct, runs = np.unique(pair[mine], return_counts=True)
            yield b, distinct, runs, doc[mine], often[mine]


POSTED = ("doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "bucket int, first long, pair array<long>, runs array<int>, doc array<int>, mult array<int>")


def postings(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """(rows of `POSTED`: documents, without a bucket, and postings; the number of B's ids), not settled yet."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a_file, b_file = f.read(), g.read()
    sent = docs.sparkSession.sparkContext.broadcast((a_file, b_file, hashlib.sha256(a_file + b_file).hexdigest()))
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("first", pa.int64()),
                        ("pair", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32())), ("doc", pa.list_(pa.int32())), ("mult", pa.list_(pa.int32()))])

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    def run(batches):
        pair, units = _pair(*sent.value)
        reader, first, at = Reader(pair, units), 0, TaskContext.get().partitionId() << 36
        held, links, n = [], 0, 0

        def flush():
            if links:
                for b, pairs, runs, doc, mult in posted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), n, pair.width):
                    yield rows(1, bucket=pa.array([b]), first=pa.array([at + first]), pair=list_array(pairs, [len(pairs)], pa.int64()), runs=list_array(runs, [len(runs)], pa.int32()),
                               doc=list_array(doc, [len(doc)], pa.int32()), mult=list_array(mult, [len(mult)], pa.int32()))
            held.clear()

        for batch in batches:
            for part in range(0, batch.num_rows, READ):
                some = batch.slice(part, READ)
                counts, groups, pairs, doc = reader.read(some.column(1).to_pylist())
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                yield rows(some.num_rows, doc_id=some.column(0), uid=pa.array(at + first + n + np.arange(some.num_rows)), groups_sha256=pa.array(digests, pa.string()),
                           **{name: pa.array(counts[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
                held.append((pairs, doc + n))
                links, n = links + len(pairs), n + some.num_rows
                if links >= FLUSH:
                    yield from flush()
                    first, links, n = first + n, 0, 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTED), Pair(a_file, b_file).width


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row each row of docs."""
    made, width = postings(docs, a_path, b_path)
    made = cut(made)  # row numbers of a task hold from here on
    each = made.filter("bucket is null").select("doc_id", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    lists = made.filter("bucket is not null").select("bucket", "first", "pair", "runs", "doc", "mult")
    sizes = {r.bucket: r.n for r in lists.groupBy("bucket").agg(F.sum(F.size("doc").cast("long")).alias("n")).collect()}  # no more than BUCKETS
    slices = F.element_at(F.array(*[F.lit(-(-sizes.get(b, 1) // SLICE)) for b in range(BUCKETS)]), F.col("bucket") + 1).cast("int")
    counted = lists.select("bucket", F.explode(F.arrays_zip("pair", "runs")).alias("p")).groupBy("bucket", "p.pair").agg(F.sum("p.runs").alias("n"))
    # a chunk holds ids of one rest, so it is bounded by the vocabularies
    chunks = counted.groupBy("bucket", F.pmod(F.xxhash64("pair"), F.lit(64)).alias("chunk")).agg(F.collect_list(F.struct("pair", "n")).alias("c"))
    chunks = chunks.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    none = F.lit(None)
    ints = none.cast("array<int>")
    first = chunks.select("bucket", "slice", F.lit(0).alias("kind"), none.cast("long").alias("first"), F.col("c.pair").alias("pair"), F.col("c.n").alias("n"), ints.alias("runs"), ints.alias("doc"), ints.alias("mult"))
    then = lists.select("bucket", F.pmod(F.xxhash64("first"), slices.cast("long")).cast("int").alias("slice"), F.lit(1).alias("kind"), "first", "pair", none.cast("array<long>").alias("n"), "runs", "doc", "mult")
    stream = first.unionByName(then).repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "kind")

    def run(batches):
        numbers = lambda column, i: column[i].values.to_numpy()
        now, counts, best = None, [], None
        for batch in batches:
            bucket, slice_, kind, start = (batch.column(k).to_pylist() for k in range(4))
            for i in range(batch.num_rows):
                if (bucket[i], slice_[i]) != now:
                    now, counts, best = (bucket[i], slice_[i]), [], None
                if kind[i] == 0:
                    counts.append((numbers(batch.column(4), i), numbers(batch.column(5), i)))
                    continue
                if best is None:  # all counts are in: the maxima of their A ids
                    pair, n = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
                    by = np.argsort(pair)
                    pair, n = pair[by], n[by]
                    a = pair // width
                    heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.append(heads, len(a))))
                at = np.searchsorted(pair, numbers(batch.column(4), i))
                runs, doc, mult = (numbers(batch.column(k), i) for k in (6, 7, 8))
                top = np.bincount(doc, np.repeat(best[at], runs) * mult).astype(np.int64)
                total = np.zeros(len(top), np.int64)
                np.add.at(total, doc, np.repeat(n[at], runs) * mult)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some + start[i]), pa.array(top[some]), pa.array(total[some])], ["uid", "n_best", "count_sum"])

    shares = stream.mapInArrow(run, "uid long, n_best long, count_sum long").groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return each.join(shares, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def default_vocabs() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), *default_vocabs())
