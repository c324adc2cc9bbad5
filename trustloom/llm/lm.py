"""Operator 7: log-bilinear language model, trained with noise-contrastive estimation.

Words that make up at least one in `WORD_SHARE` training tokens are symbols of their own,
and so is the end of a text; every other word, seen or not, belongs to one of `KINDS`
kinds by its first letters, and each kind is a symbol. A word's probability is its
symbol's, for words of a kind shared out by smoothed counts: (c + 1) / (tokens of the kind
+ distinct words of it + 1). Symbols lie in groups of about equal size, and the
probability of a symbol is its group's times its own within the group; both follow from
the same context vector, a sum of the vectors of the last `CONTEXT` symbols, each under
the weights of its position. Batched matrix products give the normalised
log-probabilities of every token of every text.

Counts are over all training tokens. Every training text is encoded once as its symbols.
Shards of about `SHARD_TOKENS` tokens are trained side by side by noise-contrastive
estimation in numpy, from one start, and their parameters averaged, in `ROUNDS` rounds that
each take their share of the texts. Every position of every training text is a target once,
whatever the corpus' size; a batch is held against `NOISE` groups and `NOISE` symbols drawn
from the start's distribution. Work and what is
gathered grow with the corpus, sums are formed before they are shuffled, the driver holds
one model.

Words of at least one in `HEAD_SHARE` tokens, no more than `HEAD_SHARE` therefore, travel
with their counts by broadcast; the counts of all others are joined, whatever the size.

Null texts count as empty and have the end token alone. Repeated rows count each time.
With no training rows all counts are zero and the model is uniform. A null doc_id is
read as the text '' where folds are dealt. Texts of any length are read whole. Other
columns stay; those called n_tokens, n_known, train_tokens, base_score or score, in any
case, are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.llm.common import crc_rest, cut, table, together

HEAD_SHARE = 1_000_000
WORD_SHARE = 32_768
KINDS = 4096
CONTEXT = 4
WIDTH = 24
NOISE = 64  # groups and symbols drawn for a batch
SHARD_TOKENS = 4_000_000
ROUNDS = 2
BATCH = 256
CHUNK = 1 << 14
NOT_LETTERS = bytes(b for b in range(128) if not 97 <= b <= 122)


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, which is what bytes.split does."""
    return (text or "").encode().lower().split()


def kind_of(word: bytes) -> int:
    """The kind of a word that is no symbol itself: by its first three letter bytes."""
    return zlib.crc32(word[:16].translate(None, NOT_LETTERS)[:3]) % KINDS


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts, one end (the empty word) each."""

    def run(batches):
        seen = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                seen[b""] += 1
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols:
    """Which symbol every word is, and the counts that go with it.

    Symbols are ranked end, words by frequency, kinds; rank r is number (r % groups) * width + r // groups.
    """

    def __init__(self, words: list[bytes], n: np.ndarray, kind_n: np.ndarray, kind_words: np.ndarray, total: int, kinds: int):
        self.total, self.kinds = total, kinds
        own = [k for k, w in enumerate(words) if w and n[k] * WORD_SHARE >= total]
        ranks = 1 + len(own) + KINDS
        self.groups = math.isqrt(ranks - 1) + 1
        self.width = -(-ranks // self.groups)
        number = lambda r: (r % self.groups) * self.width + r // self.groups
        self.size = self.groups * self.width
        self.kind_symbol = number(np.arange(KINDS) + 1 + len(own))
        ends = int(n[words.index(b"")]) if b"" in words else 0
        #: what each symbol stands for in training, and whether it is one
        self.mass, self.real = np.zeros(self.size), np.zeros(self.size, bool)
        self.real[number(np.arange(ranks))] = True
        self.mass[0] = ends
        self.mass[self.kind_symbol] = kind_n
        owned = np.array(own, np.int64)
        symbol = np.zeros(len(words) + 1, np.int64)  # of word k; the last is the end
        kinds_ = np.array([kind_of(w) for w in words] + [0], np.int64)
        symbol[:] = self.kind_symbol[kinds_]
        symbol[-1] = 0
        symbol[owned] = number(np.arange(len(own)) + 1)
        self.mass[symbol[owned]] = n[owned]
        self.index = {w: k for k, w in enumerate(words) if w}
        self.symbol = symbol.astype(np.uint16)
        self.logs = np.log10(np.r_[n, ends] + 1.0)
        #: log10 of a word's share in its kind; words of their own have no share to take
        self.kind_logs = np.log10(kind_n + kind_words + 1.0)
        self.share = self.logs - self.kind_logs[kinds_]
        self.share[owned] = 0
        self.share[-1] = 0
        self.ends = ends

    def encode(self, text: str | None):
        """(symbols with the end as uint16, log10 of counts + 1, shares, known tokens, Counter of words beyond the head)."""
        words = tokens(text)
        get = self.index.get
        at = np.array([get(w, -2) for w in words], np.int64)
        rest = np.flatnonzero(at == -2)
        symbols = np.append(self.symbol[np.where(at < 0, -1, at)], np.uint16(0))
        known = at[at >= 0]
        logs, share = float(self.logs[known].sum() + self.logs[-1]), float(self.share[known].sum())
        tail = Counter()
        if len(rest):
            kinds = np.array([kind_of(words[k]) for k in rest.tolist()])
            symbols[rest] = self.kind_symbol[kinds]
            share -= float(self.kind_logs[kinds].sum())
            tail.update(words[k] for k in rest.tolist())
        return symbols, logs, share, len(known) + (self.ends > 0), tail


def first_model(symbols: Symbols, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    g, w = symbols.groups, symbols.width
    mass = np.where(symbols.real, symbols.mass + 1.0, 0.0).reshape(g, w)
    of_group = mass.sum(axis=1)
    with np.errstate(divide="ignore"):
        inside = np.log(mass / of_group[:, None])
    return {
        "r": rng.normal(0, 0.3, (g * w, WIDTH)).astype(np.float32),
        "c": (np.ones((CONTEXT, WIDTH)) / (1 + 0.3 * np.arange(CONTEXT))[:, None]).astype(np.float32),
        "q": np.zeros((g, w, WIDTH), np.float32),
        "b": np.maximum(inside, -1e4).astype(np.float32),
        "qg": np.zeros((g, WIDTH), np.float32),
        "bg": np.log(of_group / of_group.sum()).astype(np.float32),
    }


def laid_out(sequences: list[np.ndarray]):
    """All texts in one row, CONTEXT ends before each, and the places of their tokens."""
    flat = np.zeros(sum(len(s) for s in sequences) + CONTEXT * len(sequences), np.int64)
    sizes = np.array([len(s) for s in sequences])
    if len(sequences):
        at = np.arange(sizes.sum()) + CONTEXT * (1 + np.repeat(np.arange(len(sizes)), sizes))
        flat[at] = np.concatenate(sequences)
    else:
        at = np.zeros(0, np.int64)
    return flat, at, sizes


class Trainer:
    """Noise-contrastive estimation, of groups and of symbols; noise is drawn from the start's distributions.

    Symbols are contrasted with symbols of all groups. Their scores are kept without the group's share, which the noise's
    score lacks as well; within a group only differences count.
    """

    def __init__(self, model: dict[str, np.ndarray], start: dict[str, np.ndarray], rate: float = 0.15, seed: int = 5):
        self.p = {k: v.copy() for k, v in model.items()}
        self.sum = {k: np.full(v.shape, 1e-4, np.float32) for k, v in model.items()}
        self.rate, self.rng = rate, np.random.default_rng(seed)
        # log of NOISE times the noise's probability, and what to draw by
        self.noise = (np.log(NOISE) + start["bg"]).astype(np.float32), (np.log(NOISE) + start["b"]).astype(np.float32)
        groups, inside = np.exp(start["bg"].astype(np.float64)), np.exp(start["b"].astype(np.float64))
        self.draws = np.cumsum(groups), np.cumsum(groups[:, None] * inside)
        self.weight = 0

    def _step(self, name, where, grad):
        self.sum[name][where] += grad * grad
        self.p[name][where] -= self.rate * grad / np.sqrt(self.sum[name][where])

    def _drawn(self, sums: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(sums, self.rng.random(NOISE) * sums[-1], side="right"), len(sums) - 1)

    @staticmethod
    def _learnt(s, noise):
        """How sure the model is, of scores s, that it sees a word and no noise."""
        return 1 / (1 + np.exp(np.clip(noise - s, -30, 30)))

    def _against(self, names, h, noise, drawn):
        """Step on the rows drawn for a batch; the gradient in h."""
        q, b = self.p[names[0]].reshape(-1, h.shape[1]), self.p[names[1]].ravel()
        w = q[drawn]
        d = self._learnt(h @ w.T + b[drawn], noise.ravel()[drawn])
        rows, back = np.unique(drawn, return_inverse=True)
        once = np.zeros((len(rows), len(drawn)), np.float32)
        once[back, np.arange(len(drawn))] = 1  # a row drawn twice gets both gradients
        at = np.unravel_index(rows, self.p[names[1]].shape)
        dh = d @ w
        self._step(names[0], at, once @ (d.T @ h))
        self._step(names[1], at, once @ d.sum(axis=0))
        return dh

    def _toward(self, names, h, noise, target):
        """Step on the targets' rows, which come in order; the gradient in h."""
        q, b = self.p[names[0]].reshape(-1, h.shape[1]), self.p[names[1]].ravel()
        w = q[target]
        d = self._learnt(np.einsum("bd,bd->b", h, w) + b[target], noise.ravel()[target]) - 1
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rows, shape = target[first], self.p[names[1]].shape
        at = np.unravel_index(rows, shape)
        self._step(names[0], at, np.add.reduceat(d[:, None] * h, first, axis=0))
        self._step(names[1], at, np.add.reduceat(d, first))
        return d[:, None] * w

    def batch(self, context: np.ndarray, target: np.ndarray):
        p, width = self.p, self.p["q"].shape[1]
        order = np.argsort(target, kind="stable")
        context, target = context[order], target[order]
        r = p["r"][context]  # B x CONTEXT x WIDTH
        h = np.einsum("bjd,jd->bd", r, p["c"])
        group = target // width
        dh = self._against(("qg", "bg"), h, self.noise[0], self._drawn(self.draws[0]))
        dh += self._toward(("qg", "bg"), h, self.noise[0], group)
        dh += self._against(("q", "b"), h, self.noise[1], self._drawn(self.draws[1]))
        dh += self._toward(("q", "b"), h, self.noise[1], target)
        self._step("c", slice(None), np.einsum("bjd,bd->jd", r, dh))
        at = context.ravel()
        by = np.argsort(at, kind="stable")
        at = at[by]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self._step("r", at[first], np.add.reduceat((dh[:, None, :] * p["c"]).reshape(-1, WIDTH)[by], first, axis=0))

    def texts(self, sequences: list[np.ndarray]):
        """Every position of every text is a target."""
        flat, at, _ = laid_out(sequences)
        self.weight += len(at)
        at = self.rng.permutation(at)
        for lo in range(0, len(at), BATCH):
            part = at[lo:lo + BATCH]
            self.batch(flat[part[:, None] - 1 - np.arange(CONTEXT)], flat[part])


def log_probabilities(model: dict[str, np.ndarray], sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's symbols, every factor normalised over its group or the groups."""
    flat, at, sizes = laid_out(sequences)
    width = model["q"].shape[1]
    out = np.empty(len(at))
    for lo in range(0, len(at), CHUNK):
        part = at[lo:lo + CHUNK]
        target = flat[part]
        order = np.argsort(target, kind="stable")
        part, target = part[order], target[order]
        h = np.zeros((len(part), WIDTH), np.float32)
        for j in range(CONTEXT):
            h += model["r"][flat[part - 1 - j]] * model["c"][j]
        group, slot = target // width, target % width
        lp = np.empty(len(part))
        for a in range(0, len(part), 2048):
            s = h[a:a + 2048] @ model["qg"].T
            s += model["bg"]
            lp[a:a + 2048] = s[np.arange(len(s)), group[a:a + 2048]] - _log_sum(s)
        ends = np.flatnonzero(np.r_[np.diff(group) != 0, True]) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            g = int(group[a])
            s = h[a:b] @ model["q"][g].T
            s += model["b"][g]
            lp[a:b] += s[np.arange(b - a), slot[a:b]] - _log_sum(s)
        out[lo + order] = lp
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), out, len(sizes)) / math.log(10)


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Of every row's exponentials; s is used up."""
    top = s.max(axis=1, keepdims=True)
    s -= top
    return np.log(np.exp(s, out=s).sum(axis=1)) + top[:, 0]


def packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(block)))


_HELD: dict = {}


def _held(key: str, make):
    """One object per Python worker and key; another key takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def symbols_of(counts: DataFrame) -> Symbols:
    """The symbols of counted words; at most HEAD_SHARE words and KINDS sums come to the driver."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.filter((F.col("n") * HEAD_SHARE >= total) | (F.length("word") == 0)).toArrow()
    words, n = head["word"].to_pylist(), head["n"].to_numpy().astype(np.int64)
    by = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))

    def sums(batches):
        mass, distinct = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
        for batch in batches:
            kind = np.array([kind_of(w) for w in batch.column(0).to_pylist()], np.int64)
            np.add.at(mass, kind, batch.column(1).to_numpy())
            distinct += np.bincount(kind, minlength=KINDS)
        has = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(mass[has]), pa.array(distinct[has])], ["kind", "n", "words"])

    rare = counts.filter((F.col("n") * WORD_SHARE < total) & (F.length("word") > 0))
    kind_n, kind_words = np.zeros(KINDS), np.zeros(KINDS)
    for r in rare.mapInArrow(sums, "kind int, n long, words long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        kind_n[r.kind], kind_words[r.kind] = r.n, r.words
    return Symbols([words[k] for k in by], n[by], kind_n, kind_words, total, kinds)


def _averaged(parts: DataFrame, model: dict[str, np.ndarray], shards: int) -> dict[str, np.ndarray]:
    """The mean of the shards' parameters (chunk, weight, values in single precision) by their weights, summed on the executors: within lanes of shards, then over the lanes."""

    def add(batches, of=np.float64):
        total: dict[int, list] = {}
        for batch in batches:
            for chunk, weight, values in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = total.setdefault(chunk, [0.0, 0.0])
                found[0] += weight
                found[1] = found[1] + np.frombuffer(values, of).astype(np.float64) * (weight if of is np.float32 else 1)
        rows = [(c, w, v.tobytes()) for c, (w, v) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "weight", "values"])

    shape = "chunk int, weight double, values binary"
    lanes = max(1, math.isqrt(shards))
    lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
    summed = parts.withColumn("lane", lane).repartition("chunk", "lane").select("chunk", "weight", "values").mapInArrow(lambda batches: add(batches, np.float32), shape)
    rows = sorted((r.chunk, r.weight, bytes(r["values"])) for r in summed.repartition("chunk").mapInArrow(add, shape).collect())  # one model
    if not rows:
        return model
    flat, out, at = np.concatenate([np.frombuffer(v, np.float64) / w for _, w, v in rows]).astype(np.float32), {}, 0
    for name, value in model.items():
        out[name] = flat[at:at + value.size].reshape(value.shape)
        at += value.size
    return out


def train(encoded: DataFrame, symbols: Symbols) -> dict[str, np.ndarray]:
    """The model of the `_symbols` of rows whose `_train` is true."""
    spark = encoded.sparkSession
    start = model = first_model(symbols)
    if not symbols.total:
        return model
    shards = -(-symbols.total // SHARD_TOKENS)
    rows = encoded.filter("_train").select("_row", "_symbols")
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((packed(start), packed(model)))

        def run(batches, sent=sent, turn=turn):
            start_, model_ = map(unpacked, sent.value)
            trainer = Trainer(model_, start_, seed=turn)
            held, size = [], 0
            for batch in batches:
                for cell in batch.column(1).to_pylist():
                    held.append(np.frombuffer(cell, np.uint16))
                    size += len(held[-1])
                    if size > 200_000:
                        trainer.texts(held)
                        held, size = [], 0
            if held:
                trainer.texts(held)
            if trainer.weight:
                flat = np.concatenate([v.ravel() for v in trainer.p.values()])
                cut_ = [flat[k:k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut_)), pa.int32()), pa.array([float(trainer.weight)] * len(cut_)), pa.array(cut_, pa.binary())], ["chunk", "weight", "values"])

        mine = rows.filter(F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(ROUNDS)) == turn)
        model = _averaged(mine.repartition(int(shards), "_row").mapInArrow(run, "chunk int, weight double, values binary"), model, int(shards))
        sent.unpersist()
    return model


def score(docs: DataFrame, training, keep_text: bool = True) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score; `training` is a condition on docs' rows.

    Without keep_text the text is not carried along and not returned.
    """
    spark = docs.sparkSession
    rest = docs if keep_text else docs.drop("text")
    condition = F.expr(training) if isinstance(training, str) else training
    marked = docs.select(F.col("text").alias("_text"), F.coalesce(condition, F.lit(False)).alias("_train"),
                         F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`") for c in rest.columns]).alias("_all"))
    counts = cut(count_words(marked.filter("_train").select(F.col("_text").alias("text"))))
    symbols = symbols_of(counts)
    sent = spark.sparkContext.broadcast(symbols)
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))

    def encode(batches):
        symbols_ = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [symbols_.encode(t) for t in batch.column(0).to_pylist()]
            cells = [pa.array(range(row, row + len(found)), pa.int64()), batch.column(1), pa.array([f[0].tobytes() for f in found], pa.binary()),
                     *(pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.float64()), (2, pa.float64()), (3, pa.int64()))),
                     pa.array([[{"word": w, "k": k} for w, k in f[4].items()] for f in found], tail_type), batch.column(2)]
            row += len(found)
            yield pa.RecordBatch.from_arrays(cells, ["_row", "_train", "_symbols", "_logs", "_share", "_known", "_tail", "_all"])

    schema = "_row long, _train boolean, _symbols binary, _logs double, _share double, _known long, _tail array<struct<word:binary,k:bigint>>"
    encoded = cut(marked.mapInArrow(encode, StructType(StructType.fromDDL(schema).fields + [marked.schema["_all"]])))
    model = spark.sparkContext.broadcast(packed(train(encoded, symbols)))
    name = uuid.uuid4().hex

    def run(batches):
        model_ = _held(name, lambda: unpacked(model.value))
        for batch in batches:
            cells = [np.frombuffer(c, np.uint16) for c in batch.column(1).to_pylist()]
            lp, at = np.empty(len(cells)), 0
            while at < len(cells):  # about a million tokens at once
                end, size = at, 0
                while end < len(cells) and size < 1_000_000:
                    size += len(cells[end])
                    end += 1
                lp[at:end] = log_probabilities(model_, cells[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in cells], pa.int64()), pa.array(lp), *batch.columns[2:]],
                                             ["_row", "n_tokens", "_lp", "_logs", "_share", "_known", "_all"])

    fields = StructType.fromDDL("_row long, n_tokens long, _lp double, _logs double, _share double, _known long").fields + [marked.schema["_all"]]
    out = encoded.select("_row", "_symbols", "_logs", "_share", "_known", "_all").mapInArrow(run, StructType(fields))
    # words beyond the head are rare in training, so no key here is hot
    tail = encoded.select("_row", F.explode("_tail").alias("t")).select("_row", "t.word", "t.k")
    more = tail.join(counts, "word").groupBy("_row").agg(F.sum("k").alias("_more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("_more"))
    out = out.join(more, "_row", "left")
    extra = F.coalesce("_more", F.lit(0.0))
    out = out.select("_all", "n_tokens", (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"), F.lit(symbols.total).cast("long").alias("train_tokens"),
                     (F.col("_logs") + extra - F.col("n_tokens") * F.lit(math.log10(symbols.total + symbols.kinds + 1))).alias("base_score"),
                     (F.col("_lp") + F.col("_share") + extra).alias("score"))
    return together(out, rest, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_rest("doc_id", 7) == 2)
    return score(docs, "not held_out", keep_text=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
