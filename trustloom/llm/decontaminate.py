"""Operator 2: benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and runs of other than letters and digits become one space. Windows
of `WINDOW` characters (the whole item if shorter) start at every character of every
benchmark item. A window within e edits of a region, e being floor(`ERRORS` * length) and
at most floor((length - Q) / Q), shares at least length - Q + 1 - Q * e >= 1 of its
q-grams with it, all on diagonals at most e from the region's. Shared q-grams are counted
in diagonal bands of 4e + 4 that overlap by half; windows that meet the bound in a band
must meet it for grams of `SHORT_Q` characters too, counted place by place, and a banded
alignment verifies them. Many documents are worked together, with gaps between them that
no alignment bridges. Windows at or over the bound are all decided, never sampled.

The benchmark is broadcast in blocks of about `BLOCK_CHARS` characters, each a pass over
the documents; of several blocks, each is finished before the next is sent. Null and
empty texts and items match nothing, nor do items under Q characters; items under 2 Q
must stand verbatim. Repeated items and rows each give their own result, null ids are
results' keys like any other. Texts of any length are read whole, in overlapping pieces.
Empty tables give empty results. Columns other than doc_id, item_id and text are not
looked at; `drop_contaminated` returns them as they are.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from trustloom.llm.common import cut, if_small, table

Q = 8
SHORT_Q = 4
RUN = 48
WINDOW = 60
ERRORS = 0.1
BLOCK_CHARS = 4_000_000
PIECE = 1 << 17
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - Q + 1, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x100000001B3) + c[k: len(c) - Q + 1 + k].astype(np.uint64)
    return h ^ (h >> np.uint64(31))


def _spread(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _short(c: np.ndarray) -> np.ndarray:
    h = np.zeros(len(c) - SHORT_Q + 1, np.uint32)
    for k in range(SHORT_Q):
        h = h * np.uint32(0x9E3779B1) + c[k: len(c) - SHORT_Q + 1 + k]
    return h


class Index:
    """q-grams of a block of items, found by the low bits of their hash."""

    def __init__(self, items: list[tuple[int, str]]):
        read = [(item, codes(normalise(text))) for item, text in items]
        read = [(item, c) for item, c in read if len(c) >= Q]
        none = [np.zeros(0, np.int64)]
        self.items = [item for item, _ in read]
        self.text = np.concatenate([c for _, c in read] or [np.zeros(0, np.uint32)])
        self.size = np.array([len(c) for _, c in read], np.int64)
        self.at_item = np.cumsum(self.size) - self.size
        self.short = _short(np.concatenate([self.text, np.zeros(SHORT_Q, np.uint32)]))
        gram = np.concatenate([grams(c) for _, c in read] or [np.zeros(0, np.uint64)])
        bits = min(24, max(16, int(8 * len(gram) + 1).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        slot = (gram & self.mask).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.gram = gram[order]
        self.slot = np.r_[0, np.cumsum(np.bincount(slot, minlength=1 << bits))].astype(np.int32)
        self.owner = np.concatenate([np.full(len(c) - Q + 1, k) for k, (_, c) in enumerate(read)] or none)[order]
        self.at = np.concatenate([np.arange(len(c) - Q + 1) for _, c in read] or none)[order]
        # of a window of each item
        self.length = np.minimum(self.size, WINDOW)
        self.errors = np.minimum((self.length * ERRORS).astype(np.int64), (self.length - Q) // Q)
        self.need = self.length - Q + 1 - Q * self.errors
        self.past = int(self.size.max(initial=0))
        #: so many cells between two texts are more than any band or alignment bridges
        self.gap = 8 * (int(self.errors.max(initial=0)) + 1) + 8

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item, edits): for each item found its fewest edits in a window."""
        return [(item, edits) for _, item, edits in self.scan([text])]

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text's place, item, edits) of all texts, long ones in pieces that overlap by more than a window."""
        found: dict[tuple[int, int], int] = {}
        held, size = [], 0

        def flush():
            for place, item, edits in self._scan(held):
                found[place, item] = min(edits, found.get((place, item), edits))

        for place, text in enumerate(texts):
            text = normalise(text)
            for start in range(0, max(1, len(text) - 2 * WINDOW), PIECE):
                held.append((place, text[start:start + PIECE + 2 * WINDOW]))
                size += len(held[-1][1])
                if size >= PIECE:
                    flush()
                    held, size = [], 0
        flush()
        return sorted((place, self.items[item], edits) for (place, item), edits in found.items())

    def _scan(self, held):
        if not held or not len(self.gram):
            return
        sizes = np.array([len(t) + self.gap for _, t in held])
        pad = 4 * self.gap + RUN + WINDOW  # no window that holds a shared gram reaches past it
        starts = np.cumsum(sizes) - sizes + pad
        c = codes("\0" * pad + ("\0" * self.gap).join(t for _, t in held) + "\0" * pad)
        g = grams(c)
        low = (g & self.mask).astype(np.int64)
        lo = self.slot[low]
        n = self.slot[low + 1] - lo
        pos = np.flatnonzero(n)
        n = n[pos]
        hit = np.repeat(lo[pos], n) + _spread(n)
        pos = np.repeat(pos, n)
        same = self.gram[hit] == g[pos]
        hit, pos = hit[same], pos[same]
        if not len(hit):
            return
        owner, at = self.owner[hit], self.at[hit]
        diagonal = pos - at + self.past  # never negative
        half = 2 * (self.errors[owner] + 1)
        bands = (len(c) + self.past) // 2 + 2
        # every diagonal is in two bands, so a region's 2e + 1 diagonals are whole in one of them
        for shift in (0, 1):
            key = owner * bands + (diagonal + shift * half) // (2 * half)
            # hits of a bucket of bands with fewer hits than a window needs are none's
            bucket = key & 0xFFFFF
            enough = np.bincount(bucket, minlength=1)[bucket] >= self.need[owner]
            # a gram of the item counts once a band however often the text repeats it
            pairs = np.sort(key[enough] * self.past + at[enough])
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
            key, at_ = pairs // self.past, pairs % self.past
            need = self.need[key // bands]
            last = np.arange(len(key)) + need - 1
            inside = np.flatnonzero(last < len(key))
            last = last[inside]
            good = (key[last] == key[inside]) & (at_[last] - at_[inside] <= self.length[key[inside] // bands] - Q)
            inside, last = inside[good], last[good]
            if not len(inside):
                continue
            key = key[inside]
            w = key // bands
            # windows that hold grams i to i + need - 1 start from at[last] + Q - length to at[i]
            first = np.maximum(at_[last] + Q - self.length[w], 0)
            n = np.maximum(np.minimum(at_[inside], self.size[w] - self.length[w]) - first + 1, 0)
            rows = np.sort(np.repeat(key * self.past + first, n) + _spread(n))
            rows = rows[np.r_[True, rows[1:] != rows[:-1]]] if len(rows) else rows
            key, start = rows // self.past, rows % self.past
            w, band = key // bands, key % bands
            e = self.errors[w]
            diag = band * 4 * (e + 1) - shift * 2 * (e + 1) - self.past
            yield from self._verify(c, starts, held, w, start, diag)

    def _verify(self, c, starts, held, w, start, diag):
        """Align windows of items w at start with the text on the diagonals of a band and e more on both sides."""
        short = _short(c)
        for e in np.unique(self.errors[w]).tolist():
            width = 4 * (e + 1) + 2 * e
            for size in np.unique(self.length[w[self.errors[w] == e]]).tolist():
                mine = np.flatnonzero((self.errors[w] == e) & (self.length[w] == size))
                need = size - SHORT_Q + 1 - SHORT_Q * e
                if need > 0:  # the lemma once more, for shorter grams and place by place
                    mine = mine[self._shared(short, w[mine], start[mine], diag[mine] - e, width, size - SHORT_Q + 1) >= need]
                for part in np.array_split(mine, -(-len(mine) // 4096)) if len(mine) else ():
                    edits, end = aligned(self.text, self.at_item[w[part]] + start[part], size, c, start[part] + diag[part] - e, width, e)
                    ok = edits <= e
                    place = np.searchsorted(starts, end[ok], "right") - 1
                    for k, item, n in zip(place.tolist(), w[part][ok].tolist(), edits[ok].tolist()):
                        yield held[k][0], item, n

    def _shared(self, short, w, start, diag, width, n):
        """For each window, how many of its n short grams stand in the text on the diagonals from diag."""
        fresh = np.r_[True, (np.diff(w) != 0) | (np.diff(diag) != 0) | (np.diff(start) != 1)]
        run = np.cumsum(fresh) - 1
        step = np.arange(len(w)) - np.flatnonzero(fresh)[run]  # place in a run of windows that start side by side
        run = np.cumsum(fresh | (step % RUN == 0)) - 1
        head = np.flatnonzero(np.r_[True, np.diff(run) != 0])
        out = np.empty(len(w), np.int64)
        for at in range(0, len(head), 256):
            h = head[at:at + 256]
            place = start[h][:, None] + np.arange(RUN + n - 1)
            own = self.short[np.minimum(self.at_item[w[h]][:, None] + place, len(self.short) - 1)]
            place = place + diag[h][:, None]
            seen = np.zeros(own.shape, bool)
            for d in range(width + 1):
                seen |= short[d:][place] == own
            total = np.concatenate([np.zeros((len(h), 1), np.int64), np.cumsum(seen, axis=1)], axis=1)
            rows = np.arange(h[0], head[at + 256] if at + 256 < len(head) else len(w))
            k, first = run[rows] - at, start[rows] - start[head[run[rows]]]
            out[rows] = total[k, first + n] - total[k, first]
        return out


def aligned(items: np.ndarray, starts: np.ndarray, size: int, text: np.ndarray, first: np.ndarray, width: int, most: int):
    """(edits, a place in the text) of each row: the fewest edits between items[starts:starts + size] and a
    stretch of text on the width + 1 diagonals from `first`, or more than `most`."""
    rows = np.arange(len(starts))
    out, end = np.full(len(starts), most + 1, np.int64), np.zeros(len(starts), np.int64)
    cost = np.zeros((len(starts), width + 1), np.int16)  # cost[r, k]: the first i letters end at text place first[r] + i + k
    ramp = np.arange(width + 1, dtype=np.int16)
    at = first[:, None] + ramp
    for i in range(size):
        step = cost + (text[i:][at] != items[starts + i][:, None])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])  # letter missing in the text
        step -= ramp
        cost = np.minimum.accumulate(step, axis=1) + ramp  # letters only in the text
        if i % 4 == 3:
            alive = cost.min(axis=1) <= most
            if not alive.all():
                rows, starts, at, cost = rows[alive], starts[alive], at[alive], cost[alive]
                if not len(rows):
                    return out, end
    out[rows] = cost.min(axis=1)
    end[rows] = at[:, 0] + cost.argmin(axis=1) + size - 1
    return out, end


_HELD: dict = {}


def _index(key: str, items) -> Index:
    """One index per Python worker and block of items."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Index(items)
    return _HELD[key]


def _found(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> DataFrame:
    """docs, reduced to (_key, text), against the benchmark: (_key, item_id, edits)."""
    spark = docs.sparkSession
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    kind = items.schema["item_id"].dataType
    arrow = to_arrow_type(kind)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    schema = StructType([docs.schema["_key"], StructField("item_id", kind), StructField("edits", IntegerType())])
    key_type = to_arrow_type(docs.schema["_key"].dataType)
    out = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        got = mine.collect()
        # an item is known by its place among those of its id, null too; ids are told at the end
        names = list(dict.fromkeys(r.item_id for r in got))
        number = {name: k for k, name in enumerate(names)}
        rows = sorted((number[r.item_id], r.text) for r in got)
        sent, name = spark.sparkContext.broadcast((rows, names)), uuid.uuid4().hex
        del rows, got

        def run(batches, sent=sent, name=name):
            for batch in batches:
                index = _index(name, sent.value[0])
                found = index.scan(batch.column(1).to_pylist())
                place = pa.array([p for p, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(place).cast(key_type), pa.array([sent.value[1][i] for _, i, _ in found], arrow), pa.array([e for *_, e in found], pa.int32())],
                    ["_key", "item_id", "edits"])

        part = docs.mapInArrow(run, schema)
        if blocks > 1:
            part = cut(part)  # one block's index at a time
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits): each document row and item of which a window is found in it."""
    return _found(docs.select(F.col("doc_id").alias("_key"), "text"), benchmark, block_chars).withColumnRenamed("_key", "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose own text matches no item, whatever their ids."""
    # (hash of the text) decides, so that rows are judged alike however their ids are shared or null
    keyed = docs.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_key"), "text")
    found = cut(_found(keyed, benchmark, block_chars).select("_key").distinct())
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_key"))
    return rows.join(if_small(found), "_key", "left_anti").select("_row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
