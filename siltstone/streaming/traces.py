"""Structured Streaming over append-only traces: tumbling and session windows with watermarks, micro-batch ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a time zone; the session's zone should be UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, by: list[str], value: str, width: str = "1 day", late: str = "1 hour", column: str = "ts") -> DataFrame:
    """Count and sum by window; for a stream with a watermark, for a batch without."""
    d = event_time(df, column)
    d = d.withWatermark(column, late) if df.isStreaming else d
    return d.groupBy(F.window(column, width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, by: list[str], value: str, width: str = "1 day", slide: str = "6 hours", late: str = "1 hour", column: str = "ts") -> DataFrame:
    """Count and sum by windows that overlap: a trace is in each of `width` / `slide` of them."""
    d = event_time(df, column)
    d = d.withWatermark(column, late) if df.isStreaming else d
    return d.groupBy(F.window(column, width, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def latency(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of a value for each group, its subtotals and the total (a rollup): the columns `by` (null: all), n, p50, p90 and so on."""
    told = [F.round(F.percentile(value, F.lit(q)), 4).alias(f"p{q * 100:g}") for q in shares]
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *told)


def sessions(df: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 hour", column: str = "ts") -> DataFrame:
    d = event_time(df, column)
    d = d.withWatermark(column, late) if df.isStreaming else d
    return d.groupBy(F.session_window(column, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def appender(stream: DataFrame, path: str, checkpoint: str, partition: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer, to be started, that appends each micro-batch to a partitioned table; a batch that is repeated replaces its own rows, by batch id."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = (prepare(batch) if prepare else batch).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", partition).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingest(stream: DataFrame, path: str, checkpoint: str, partition: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts `appender`."""
    return appender(stream, path, checkpoint, partition, prepare).start()
