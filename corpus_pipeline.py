"""Training-corpus pipeline: language ID, near-duplicates, decontamination, personal data, BPE.

Each stage maps (spark, docs, sf_dir) to a DataFrame; it is written as Parquet to the
shared folder and reread as the next stage's docs; a stage's folder goes when the next
one is complete. All but the last return the columns of documents. Rows are judged by
their own text: rows that share a doc_id, or have none, are kept or dropped alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import bpe, decontaminate, langid, pii, simhash
from trustloom.llm.common import crc_rest, ensure_checkpoint_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no language: null, empty or without a letter. Texts without a label get the language that is found.

    Where no row has a label nothing is learned, and texts with a letter stay as they are.
    """
    model = langid.train(docs.filter(crc_rest("doc_id", 4) != 2))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.withColumn("_source", F.struct(*docs.columns)), model).filter("lang_pred <> 'und'")
    return found.select(*[F.coalesce("_source.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_source.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that chains of at least 0.8 in five-word shingles link."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets in the text; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, bpe.default_vocab(), decoded="decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("bpe", encoded),
]
#: no stage is SQL's to express; tests/llm/test_pipeline.py holds each against brute force
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    past = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if past:
            _remove(spark, past)
        past = path
    return docs
