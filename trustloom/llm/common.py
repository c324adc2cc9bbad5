"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers are told where this package lies and get batches of bounded size."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # a task has one core; threads that wait for work would burn others'
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: too many whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; in local mode, where none is set, a folder of its own."""
    shared, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if shared:
        return shared
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "trustloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, rows: int = 16_384) -> DataFrame:
    """cut(df), read in no more parts than one for so many rows: each part writes files of its own in every later shuffle, however little it holds."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, which is settled and has a few short columns, to be broadcast where it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(rows: DataFrame, values: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows joined with values, which has one row a key; no key's rows meet in one task.

    Keys of at least one in `share` rows, no more than `share` therefore, have their values broadcast.
    """
    counted = rows.groupBy(key).count()
    total = F.broadcast(counted.agg(F.sum("count").alias("_total")))
    hot = cut(counted.join(total, F.col("count") * share >= F.col("_total")).filter("count > 1").select(key))
    few = values.join(F.broadcast(hot), key, "left_semi")
    common = rows.join(F.broadcast(few), key)
    return common.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(values, key))


def let(value, body):
    """body(value), the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_rest(col: str, modulus: int):
    """crc32 of the id as text modulo `modulus`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def list_array(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def replace_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns, those of the same names in any case replaced, the new ones at the end."""
    new = {n.lower() for n in added}
    old = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([c for _, c in old] + list(added.values()), [n for n, _ in old] + list(added))


def schema_with(df: DataFrame, added: str) -> StructType:
    """df's columns, without those that `added` (DDL: name type, ...) replaces in any case, then `added`."""
    fields = StructType.fromDDL(added).fields
    new = {f.name.lower() for f in fields}
    return StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def together(df: DataFrame, old: DataFrame, added: list[str]) -> DataFrame:
    """The columns of old, kept in the struct `_all`, those named in `added` in any case replaced, then `added`."""
    new = {n.lower() for n in added}
    kept = [F.col("_all").getField(c).alias(c) for c in old.columns if c.lower() not in new]
    return df.select(*kept, *added)
