"""Bars from a stream of prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resample import minutes_of


def streamed_bars(ticks: DataFrame, granularity: str, lateness: str = "10 minutes") -> DataFrame:
    """Finished bars, emitted once the watermark has passed their end; later prints are dropped.

    ticks: product_id, ts, seq, price, size. An unfinished bar is never seen, as in a batch.
    """
    at = F.struct("ts", "seq")
    window = F.window("ts", f"{minutes_of(granularity)} minutes")
    bars = ticks.withWatermark("ts", lateness).groupBy("product_id", window.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("product_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
