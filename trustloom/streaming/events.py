"""Event streams: files as sources, windows under a watermark, and records taken in batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 hour"


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 1000) -> DataFrame:
    """New files of a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    from trustloom.audit import LOG

    return file_stream(spark, path, LOG, "json")


def late(events: DataFrame, ts: str = "ts", delay: str | None = LATE) -> DataFrame:
    """The watermark of a stream; a batch, or a stream that has its own (delay None), passes unchanged."""
    return events.withWatermark(ts, delay) if events.isStreaming and delay else events


def _seconds(moment, ntz: bool):
    """Since 1970; a moment without a zone is read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment) if ntz else F.unix_seconds(moment)


def _counts(events: DataFrame, window, keys, ts: str) -> DataFrame:
    totals = [F.count("*").alias("n")] + ([F.sum("value").alias("total")] if "value" in events.columns else [])
    out, ntz = events.groupBy(*keys, window.alias("w")).agg(*totals), events.schema[ts].dataType.typeName() == "timestamp_ntz"
    return out.select(*keys, _seconds(F.col("w.start"), ntz).alias("start_s"), _seconds(F.col("w.end"), ntz).alias("end_s"), *out.columns[len(keys) + 1:])


def tumbling(events: DataFrame, size: str = "1 day", keys=("event_type",), ts: str = "ts", delay: str | None = LATE) -> DataFrame:
    return _counts(late(events, ts, delay), F.window(ts, size), keys, ts)


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", keys=("event_type",), ts: str = "ts", delay: str | None = LATE) -> DataFrame:
    return _counts(late(events, ts, delay), F.window(ts, size, step), keys, ts)


def sessions(events: DataFrame, gap: str = "2 hours", keys=("user_id",), ts: str = "ts", delay: str | None = LATE) -> DataFrame:
    return _counts(late(events, ts, delay), F.session_window(ts, gap), keys, ts)


def once_each(events: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Events that arrive again within the watermark are dropped."""
    return late(events, ts).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Take in what there is now, then stop; a restart goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to `take`, for instance to add its records to a store."""
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
