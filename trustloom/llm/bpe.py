"""Operator 1: byte-level BPE through a minimal acyclic transducer lexicon.

The most frequent words of the corpus are compiled, with their token ids, into a
minimal acyclic automaton that shares prefixes and suffixes. Each arc carries the
number of words that sort before the words behind it, so the sum along a path is the
word's ordinal, and the ordinal leads to the word's ids. The lexicon holds the words
that make up at least one in `LEXICON_SHARE` of all, so at most that many; it is a file
that Spark hands to every executor once and all its workers map read-only, sharing its
pages. Words that the lexicon lacks are merged exactly by rank.

Null texts count as empty; empty texts have no tokens, null lists of ids decode to the
empty text. Repeated rows give repeated results, empty tables empty ones. Texts and ids
are whole, never cut, however long; a word of any length is merged in n log n. Other
columns stay, those of the added columns' names, in any case, are replaced.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import mmap
import os
import re
import shutil
import tempfile
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.common import cut, list_array, replace_columns, schema_with, table

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_SHARE = 400_000
#: longer words are not in the lexicon
LEXICON_BYTES = 256
MEMO_WORDS = 400_000
#: words under so many bytes are merged side by side, so many at a time
BULK_BYTES, BULK_WORDS = 48, 8192
UNMERGED = 1 << 30
#: rows are worked on in groups of about so many bytes of text, or as many ids
GROUP_SIZE = 1 << 21


class Splitter:
    """Pre-tokenisation; texts of characters below U+0100 take the same pattern with its classes written out."""

    def __init__(self):
        self.wide = regex.compile(PATTERN).findall
        low = list(map(chr, range(256)))
        letter, number, space = ("".join(map(re.escape, regex.findall(kind, "".join(low)))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        written = PATTERN.replace(r"(?!\S)", rf"(?![^{space}])").replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
        self.narrow = re.compile(written.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]")).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in the vocabulary file -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        to_byte = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {
            i: s.encode() if s in self.special else bytes(to_byte[c] for c in s) for s, i in ids.items()
        }
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in self.merge.items())
        self.pair_keys = np.array([x[0] for x in pairs], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs], np.int32)
        self.made = np.zeros(len(spec["model"]["merges"]), np.int32)
        self.made[self.pair_ranks] = [x[2] for x in pairs]
        self.first_array = np.array(self.first, np.int32)
        self.split = Splitter()
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def merge_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; n log n in the word's length."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 48:
            return self._merge_short(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i):
            j = right[i]
            if j < n and (found := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merge.get, (1 << 30, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as int32 bytes: short words side by side in numpy, long ones one by one."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for at in np.flatnonzero(sizes >= BULK_BYTES).tolist():
            out[at] = array("i", self.merge_word(words[at])).tobytes()
        short = np.flatnonzero((sizes > 0) & (sizes < BULK_BYTES))
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), BULK_WORDS):
            part = short[k:k + BULK_WORDS]
            ids, n = self._merge_bulk([words[i] for i in part.tolist()], sizes[part])
            for row, i, m in zip(ids, part.tolist(), n.tolist()):
                out[i] = row[:m].tobytes()
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Position of each pair among the merges in rank order; UNMERGED where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], UNMERGED)

    def _merge_bulk(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge a round in every word that has one: its lowest rank, leftmost among equals."""
        m, width = len(words), int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        ids = np.full((m, width + 2), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.first_array[raw], -1)
        ranks = np.full((m, width + 1), UNMERGED, np.int32)
        ranks[:, :width] = self._ranks(ids[:, :width], ids[:, 1:width + 1])
        n, done, live = sizes.copy(), np.full((m, width), -1, np.int32), np.arange(m)
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            going = best < UNMERGED
            if not going.all():
                done[live[~going]] = ids[~going, :width]
                live, ids, ranks, at, best = live[going], ids[going], ranks[going], at[going], best[going]
                rows = rows[: len(live)]
                if not len(live):
                    break
            # the cells after the merged pair move one to the left
            moved = np.arange(width + 1) > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[rows, at] = self.made[best]
            n[live] -= 1
            ranks[rows, at] = self._ranks(ids[rows, at], ids[rows, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[rows, before] = np.where(at > 0, self._ranks(ids[rows, before], ids[rows, at]), ranks[rows, before])
        return done, n

    def pieces(self, text: str):
        """(is special, piece) in text order."""
        if self.specials is None:
            return [(False, text)]
        return [(k % 2 == 1, p) for k, p in enumerate(self.specials.split(text)) if p]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, then their ids, as one block of int32."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state):
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path = [[False, []]]  # open states: [final, [(label, target), ...]]
    last = b""
    for word in [*order, None]:
        shared = 0
        if word is not None:
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
        while len(path) > shared + 1:
            target = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        if word is None:
            break
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    root = freeze(path[0])
    reach = [0] * len(frozen)
    first, arcs = [0], []
    for k, (final, out) in enumerate(frozen):  # targets are frozen before their sources
        before = int(final)
        for label, target in out:
            arcs.append((label, target, before))
            before += reach[target]
        reach[k] = before
        first.append(len(arcs))
    ids = [i for w in order for i in words[w]]
    ends = np.cumsum([0] + [len(words[w]) for w in order])
    finals = [int(f) for f, _ in frozen]
    # an arc's key is its source state and label; keys ascend, as states and their labels do
    sources = np.repeat(np.arange(len(frozen)), np.diff(first))
    keys = [int(s) << 8 | a[0] for s, a in zip(sources, arcs)]
    blocks = [finals, keys, [a[1] for a in arcs], [a[2] for a in arcs], ends, ids, []]
    head = [root, *map(len, blocks)]
    return np.concatenate([np.asarray(x, np.int32) for x in [head, *blocks]]).tobytes()


class Lexicon:
    """Looks words up in a compiled lexicon, a file that is mapped read-only."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        cells = np.frombuffer(mapped, np.int32)
        self.root, at, parts = int(cells[0]), 8, []
        for size in cells[1:8].tolist():
            parts.append(cells[at:at + size])
            at += size
        self.final, self.arc, self.target, self.before, self.ends, self.ids, _ = parts

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of every word as int32 bytes, None for a word it lacks; all words walk together."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.arc):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(sizes < LEXICON_BYTES)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[live]
        state, ordinal = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            ended = sizes[live] == step
            hit = ended & (self.final[state] == 1)
            for i, k in zip(live[hit].tolist(), ordinal[hit].tolist()):
                out[i] = self.ids[self.ends[k]:self.ends[k + 1]].tobytes()
            live, starts, state, ordinal = (x[~ended] for x in (live, starts, state, ordinal))
            key = (state << 8 | text[starts + step]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            found = self.arc[at] == key
            at = at[found]
            live, starts = live[found], starts[found]
            state, ordinal = self.target[at].astype(np.int64), ordinal[found] + self.before[at]
            step += 1
        return out


class Encoder(dict):
    """word -> ids as int32 bytes, remembered; new words ask the lexicon, then are merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: str):
        self.vocabulary, self.lexicon = vocabulary, Lexicon(lexicon)

    def learn(self, words: set[str]) -> list[str]:
        """Take the new words in; returns the very long ones."""
        new = [w for w in words if w not in self]
        raw = [w.encode() for w in new]
        known = self.lexicon.get(raw)
        rest = [i for i, ids in enumerate(known) if ids is None]
        self.update(zip(new, known))
        self.update(zip([new[i] for i in rest], self.vocabulary.merge_words([raw[i] for i in rest])))
        return [w for w in new if len(w) >= 64]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as int32 bytes."""
        if len(self) >= MEMO_WORDS:
            self.clear()
        split, of_special = self.vocabulary.split, {k: array("i", [v]).tobytes() for k, v in self.vocabulary.special.items()}
        words = []
        for text in texts:
            words.append([(special, [piece] if special else split(piece)) for special, piece in self.vocabulary.pieces(text)])
        long_words = self.learn({w for text in words for special, found in text if not special for w in found})
        ids = [b"".join([of_special[found[0]] if special else b"".join(map(self.__getitem__, found)) for special, found in text]) for text in words]
        for w in long_words:  # not kept
            self.pop(w, None)
        return ids


class Decoder(dict):
    def __missing__(self, key):
        return b""


def in_groups(batches, column: str):
    """The batches in slices whose texts or lists in `column` reach GROUP_SIZE together, whole rows each."""
    for batch in batches:
        cells = batch.column(batch.schema.get_field_index(column))
        size = pc.list_value_length if pa.types.is_list(cells.type) else pc.binary_length
        total = np.cumsum(pc.fill_null(size(cells), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // GROUP_SIZE
        starts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


_HELD: dict = {}


def _held(key, make):
    """One object per Python worker, made anew only when the broadcast changes."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def frequent_words(docs: DataFrame, share: int) -> list[str]:
    """The words that make up at least one in `share` over all texts, used twice at least."""

    def count(batches):
        split = Splitter()
        seen = Counter()

        def flush():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    counted = cut(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a single use saves nothing over an exact merge
    top = counted.filter((F.col("n") > 1) & (F.col("n") * share >= total) & (F.length("word") < 64))
    return top.select("word").toArrow()["word"].to_pylist()


def shared_file(spark: SparkSession, block: bytes) -> str:
    """Name under which every executor finds the bytes as one local file, fetched from the driver."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()[:32]}-{spark.sparkContext.applicationId}"
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # served from here as long as the driver lives
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(block)
    if name not in map(os.path.basename, spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def _coder(docs: DataFrame, vocab_path: str, lexicon_share: int):
    """A function without arguments that gives a worker its Encoder."""
    spark = docs.sparkSession
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    vocabulary = Vocabulary(spec)
    words = frequent_words(docs, lexicon_share)
    name = shared_file(spark, compile_lexicon({w.encode(): vocabulary.merge_word(w.encode()) for w in words}))
    sent, key = spark.sparkContext.broadcast(spec), f"{name} {hashlib.sha256(spec.encode()).hexdigest()}"
    return lambda: _held(key, lambda: Encoder(Vocabulary(sent.value), SparkFiles.get(name)))


def encode(docs: DataFrame, vocab_path: str, lexicon_share: int = LEXICON_SHARE, column: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `column` array<int>: the token ids of `text`, as the tokenizer file defines them; under `decoded`, if named, their text again.

    Both come from one worker a task, so that a task holds the vocabulary once.
    """
    get = _coder(docs, vocab_path, lexicon_share)

    def run(batches):
        coder = None
        for batch in in_groups(batches, "text"):
            coder = coder or get()
            coded = coder.encode([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            sizes = [len(c) // 4 for c in coded]
            added = {column: list_array(np.frombuffer(b"".join(coded), np.int32), sizes, pa.int32())}
            if decoded:
                added[decoded] = pa.array([coder.vocabulary.decode(np.frombuffer(c, np.int32)) for c in coded], pa.string())
            yield replace_columns(batch, added)

    return docs.mapInArrow(run, schema_with(docs, f"{column} array<int>" + (f", {decoded} string" if decoded else "")))


def decode(rows: DataFrame, vocab_path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Add `column`: the text of the token ids; bytes that are no UTF-8 become U+FFFD."""
    with open(vocab_path, encoding="utf-8") as f:
        sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(f.read()).bytes_of)

    def run(batches):
        get = Decoder(sent.value).__getitem__
        for batch in in_groups(batches, ids):
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_pylist()
            at, texts = 0, []
            for n in ends:
                texts.append(b"".join(map(get, flat[at:at + (n or 0)].tolist())).decode("utf-8", "replace"))
                at += n or 0
            yield replace_columns(batch, {column: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, schema_with(rows, f"{column} string"))


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, default_vocab(), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
