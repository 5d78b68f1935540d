"""Canonical tables from streams: typed, deduplicated within a watermark, validated and appended in batches.

Row rules run on the stream itself.  Features and labels use row windows, which
streams do not have; they run over the written tables, or in ``foreach_batch``
over a batch with the rows before it that windows need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_trades(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def canonical_stream(trades: DataFrame, key: list[str], ts: str, lateness: str, issues=None) -> DataFrame:
    """Trades once for each key, as far as a repeat comes within the lateness, and only those without issues."""
    d = trades.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)
    return d if issues is None else d.withColumn("issues", issues).filter(F.size("issues") == 0).drop("issues")


def bar_stream(trades: DataFrame, series: str, ts: str, price: str, size: str, width: str, tie: str = "event_id") -> DataFrame:
    """Bars of a tumbling window, final once the watermark has passed their end; of trades of one time ``tie`` orders."""
    at = F.struct(ts, tie)
    bars = trades.groupBy(F.window(ts, width).alias("w"), F.col(series).alias("series_id")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("trade_count")
    )
    return bars.select("series_id", F.col("w.start").alias("bar_start_ts"), F.col("w.end").alias("bar_end_ts"), "open", "high", "low", "close", "volume", "trade_count")


def append(stream: DataFrame, path: str, checkpoint: str, foreach_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run what is available and stop; a batch written twice after a failure replaces itself under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if foreach_batch:
            foreach_batch(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
