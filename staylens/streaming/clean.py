"""Cleaning of a stream of raw listings with a cleaner fitted on a batch table.

The price cap is a statistic of a batch fit (an exact quantile cannot be
maintained incrementally without keeping every value); parsing, capping,
null filtering and log1p are row-local.  Duplicates are dropped with streaming
state: bounded by a watermark when the stream has an event-time column,
otherwise kept for the life of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from staylens.operators.cleaning import (KEY_COLS, ListingCleanerModel, PriceCapModel, dropna_key_columns,
                                         log_target)


def clean_stream(stream: DataFrame, model: ListingCleanerModel, event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Apply a fitted ListingCleanerModel to a streaming frame."""
    out = PriceCapModel("price", model.getOrDefault("priceQuantile"), model.cap_value).transform(model.parsed(stream))
    if event_time:
        out = out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()
    else:
        out = out.dropDuplicates()
    out = dropna_key_columns(out, KEY_COLS)
    if model.getOrDefault("logTarget"):
        out = log_target(out)
    return out


def start_clean_stream(stream: DataFrame, model: ListingCleanerModel, sink_path: str, checkpoint: str,
                       trigger_once: bool = False, event_time: str | None = None,
                       delay: str = "1 hour") -> StreamingQuery:
    """Append cleaned rows to a parquet sink; the checkpoint folder makes restarts exactly-once.

    Without ``event_time`` the state of the deduplication grows with the stream."""
    w = clean_stream(stream, model, event_time, delay).writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
