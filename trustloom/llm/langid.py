"""Operator 5: language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (1 to 4
characters, hashed to `BUCKETS`) that both hold, divided by the root of the product of
their own numbers. Landmarks give a Nyström map, on which one-versus-rest kernel ridge
regression is fitted. Both are linear in the presence vector, so they fold into one
matrix, and a batch of texts is scored by one matrix product.

The classifier is fitted on at most `per_language` labelled texts of each language and
`fit_rows` in all, those with the smallest hashes of id and text (a repeated row counts
once, a null id takes part), fetched as presence bits, never as text.

Null texts, empty texts and texts without a letter are `und`, score 0; so is everything
when nothing is labelled. Ties go to the language first in order. Repeated rows give
repeated results, empty tables empty ones. Whole texts are read, in pieces of 65,536
characters. Other columns stay; one called lang_pred or score, in any case, is replaced.
For the folds, a null doc_id is read as the text ''.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.common import crc_rest, replace_columns, schema_with, table

BUCKETS = 1 << 15
PER_LANGUAGE = 400
FIT_ROWS = 8192  # most rows in all, at least one of each language: 4 KB each on the driver
LANDMARKS = 256
BLOCK = 64


def presence(text: str) -> np.ndarray:
    """Which of the buckets the n-grams of the whole text fall in; white space runs are one space."""
    out = np.zeros(BUCKETS, bool)
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), 1 << 16):  # bounded memory; pieces overlap by three
        piece = codes[at:at + (1 << 16) + 3]
        h = np.zeros(len(piece), np.uint64)
        for n in range(1, 5):
            if len(piece) < n:
                break
            h = h[: len(piece) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + piece[n - 1:] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[(mixed >> np.uint64(49)).astype(np.int64)] = True
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2, seed: int = 3):
    """(languages, matrix BUCKETS x languages, bias): scores = presence @ matrix / root(count) + bias.

    `packed` holds a row of presence bits per text, eight to a byte; `BLOCK` rows at a time are unpacked.
    """
    names = sorted(set(langs))

    def block(rows):
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = block(packed[np.random.default_rng(seed).permutation(len(packed))[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_marks = vectors[:, keep] / np.sqrt(values[keep])
    # Nyström features of every text: its kernel with the landmarks, whitened
    phi = np.concatenate([block(packed[at:at + BLOCK]) @ marks.T for at in range(0, len(packed), BLOCK)]).astype(np.float64) @ to_marks
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([langs.count(v) for v in names])[np.searchsorted(names, langs)]  # languages count alike
    weight *= len(langs) / weight.sum()
    mean_x, mean_y = np.average(phi, 0, weight), np.average(y, 0, weight)
    c = (phi - mean_x) * weight[:, None]
    beta = np.linalg.solve(c.T @ (phi - mean_x) + ridge * len(phi) / 10 * np.eye(phi.shape[1]), c.T @ (y - mean_y))
    return names, marks.T @ (to_marks @ beta).astype(np.float32), mean_y - mean_x @ beta


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, fit_rows: int = FIT_ROWS):
    """Fit on (doc_id, text, lang) rows; None if no row has both a label and a letter."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    kinds = rows.select("lang").distinct().count()
    if not kinds:
        return None
    each = max(1, min(per_language, fit_rows // kinds))
    # the first `each` hashes of every language; a row that is repeated counts once
    order = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").withColumn("k", F.dense_rank().over(order)).filter(F.col("k") <= each).select("lang", "h").distinct()

    def run(batches):
        for batch in batches:
            found = [(lang, np.packbits(presence(t)).tobytes()) for lang, t in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.binary())], ["lang", "bits"])

    texts = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    got = texts.select("lang", "text").mapInArrow(run, "lang string, bits binary").toArrow().sort_by([("lang", "ascending"), ("bits", "ascending")])
    if not got.num_rows:
        return None
    packed = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(got.num_rows, -1)
    return fit(packed, got["lang"].to_pylist())


def predict(docs: DataFrame, model) -> DataFrame:
    """Add lang_pred and score to docs; only `text` is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model_ = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if has_letter(t)] if model_ else []
            for at in range(0, len(known), 128):
                part = known[at:at + 128]
                x = np.stack([presence(texts[k]) for k in part])
                s = x.astype(np.float32) @ model_[1] / np.sqrt(x.sum(axis=1, keepdims=True)) + model_[2]
                for k, row in zip(part, s):
                    best = int(row.argmax())
                    langs[k], scores[k] = model_[0][best], float(np.clip((row[best] + 1) / 2, 0, 1))
            yield replace_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, schema_with(docs, "lang_pred string, score double"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_rest("doc_id", 4) == 2)
    model = train(docs.filter("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
