"""Settled frames: results that later steps read more than once, without the plans that made them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Tell Python workers where this package lies, whatever their working folder, and give them batches of bounded size."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: too many whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def dealt(df: DataFrame) -> DataFrame:
    """df, read from fewer files than there are cores, dealt out to all of them; of many files as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only local sessions get a folder of their own."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "trustloom-checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: in less room than a checkpoint, and by the columns that a reader wants."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
