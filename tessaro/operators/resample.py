"""Prints to minute bars, minute bars to coarser finished bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The labels of bar lengths, in minutes.
MINUTES = {"1m": 1, "1min": 1, "5m": 5, "5min": 5, "15m": 15, "15min": 15, "30m": 30, "30min": 30, "1h": 60, "1hour": 60, "4h": 240, "4hour": 240, "6h": 360, "12h": 720, "1d": 1440, "1day": 1440}


def minutes_of(granularity: str) -> int:
    if granularity not in MINUTES:
        raise ValueError(f"unknown granularity {granularity!r}; known are {', '.join(MINUTES)}")
    return MINUTES[granularity]


def ticks_to_minutes(ticks: DataFrame) -> DataFrame:
    """(product_id, ts, open, high, low, close, volume) per minute with a print; order within it by (ts, seq)."""
    at = F.struct("ts", "seq")
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    return (
        ticks.groupBy("product_id", minute.alias("m"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("product_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "open", "high", "low", "close", "volume")
    )


def resample(minutes: DataFrame, granularity: str) -> DataFrame:
    """Minute bars to bars of a coarser length, keyed by the bucket's start.

    Gaps stay gaps. A product's last bucket comes out only if its last minute reaches the
    bucket's end, so that an unfinished bar is never seen.
    """
    span = minutes_of(granularity)
    if span == 1:
        return minutes
    m = F.floor(F.unix_seconds("ts") / 60)
    coarse = minutes.withColumn("m", m).groupBy("product_id", F.floor(F.col("m") / span).alias("b")).agg(
        F.min_by("open", "m").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "m").alias("close"),
        F.sum("volume").alias("volume"), F.max("m").alias("last"),
    )
    top = F.max("b").over(Window.partitionBy("product_id"))
    whole = coarse.withColumn("top", top).filter((F.col("b") < F.col("top")) | (F.col("last") + 1 >= (F.col("b") + 1) * span))
    return whole.select("product_id", F.timestamp_seconds(F.col("b") * span * 60).alias("ts"), "open", "high", "low", "close", "volume")


def number_bars(bars: DataFrame, span: int = 1 << 20) -> DataFrame:
    """bar_idx counts a product's bars from 0; a gap in time is no gap in the index.

    Bars are counted within stretches of `span` seconds (by default twelve days, so of minute bars
    some 17,000 are sorted in a task at a time); what lies before a stretch comes from the counts.
    """
    cut = bars.withColumn("_cell", F.floor(F.unix_seconds("ts") / span))
    counts = cut.groupBy("product_id", "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("product_id").orderBy("_cell")) - F.col("_n")).drop("_n")
    ranked = cut.withColumn("_k", F.row_number().over(Window.partitionBy("product_id", "_cell").orderBy("ts")) - 1)
    index = (F.col("_before") + F.col("_k")).cast("int")
    return ranked.join(before, ["product_id", "_cell"]).select("product_id", index.alias("bar_idx"), "ts", "open", "high", "low", "close", "volume")


def closed(bars: DataFrame, granularity: str, now: float) -> DataFrame:
    """Without bars that aren't over at `now` (epoch seconds), and with text columns read as numbers; bad rows drop out.

    ts may be a timestamp, or seconds as a number or a text.
    """
    names = ("open", "high", "low", "close", "volume")
    second = F.unix_micros("ts") / 1e6 if dict(bars.dtypes)["ts"].startswith("timestamp") else F.col("ts").try_cast("double")
    typed = bars.select("product_id", F.timestamp_micros((second * 1e6).cast("bigint")).alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in names)).dropna()
    return typed.filter(F.unix_micros("ts") / 1e6 + minutes_of(granularity) * 60 <= now)


def last_written(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the one that is last by the order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
