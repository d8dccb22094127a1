"""The test tables in the engine's shapes, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.resample import number_bars, resample, ticks_to_minutes
from ..session import table


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as prints: one product per event type."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("product_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), "user_id",
    )


def bars(spark: SparkSession, d: str, granularity: str = "1hour") -> DataFrame:
    """Finished bars of the ticks, numbered from 0 within their product."""
    return number_bars(resample(ticks_to_minutes(ticks(spark, d)), granularity))


def lake_bars(spark: SparkSession, d: str) -> DataFrame:
    """The lake's own minute bars, one product per venue and product: the last delivery of each stamp, holes and all; NaN is a hole."""
    rows = table(spark, d, "bars").filter("venue IS NOT NULL AND product_id IS NOT NULL AND timestamp IS NOT NULL")
    x = F.struct(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")))
    kept = rows.groupBy(F.concat_ws("|", "venue", "product_id").alias("product_id"), F.col("timestamp").alias("ts")).agg(F.max_by(x, F.struct("ingested_at", "bar_id")).alias("x"))
    return number_bars(kept.select("product_id", "ts", "x.*"))


def walk(spark: SparkSession, d: str) -> DataFrame:
    """Daily price paths from whole-number returns of line items, one per return flag."""
    day = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("product_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg(
        (F.pmod(F.sum(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17), F.lit(601)) - 300).alias("bp"), F.sum("l_quantity").alias("volume")
    )
    w = Window.partitionBy("product_id").orderBy("ts")
    level = day.withColumn("close", 100 * F.exp(F.sum("bp").over(w) / 10000)).withColumn("bar_idx", F.row_number().over(w) - 1)
    path = level.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(100.0)))
    return path.select(
        "product_id", "bar_idx", "ts", "open", (F.greatest("open", "close") * 1.003).alias("high"), (F.least("open", "close") * 0.997).alias("low"), "close", "volume"
    )


def book(spark: SparkSession, d: str) -> DataFrame:
    """One synthetic snapshot of up to ten levels a side per tick, as the lake's flat columns."""
    t = ticks(spark, d)
    depth = F.pmod("seq", F.lit(10)) + 1
    level = lambda i, x: F.when(depth >= i, x)
    size = lambda i, k: (F.pmod(F.col("seq") * k + i * 13, F.lit(50)) + 1).cast("double")
    columns = {}
    for i in range(1, 11):
        columns |= {f"bid_px_{i}": level(i, F.col("price") * (1 - i * 1e-4)), f"ask_px_{i}": level(i, F.col("price") * (1 + i * 1e-4)), f"bid_sz_{i}": level(i, size(i, 7)), f"ask_sz_{i}": level(i, size(i, 11))}
    return t.select("product_id", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("venue"), "ts", "seq", *(c.alias(n) for n, c in columns.items()))


TICKS = """ticks AS (
    SELECT event_type AS product_id, ts, event_id AS seq, value AS price, CAST(props->>'$.k' AS DOUBLE) AS size,
           CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, user_id FROM events)"""
MINUTES = (
    TICKS
    + """, bars_1m AS (
    SELECT product_id, epoch_us(ts) // 60000000 AS m, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, (ts, seq)) AS close, sum(size) AS volume FROM ticks GROUP BY ALL)"""
)


def bars_sql(minutes: int = 60, name: str = "bars") -> str:
    """Tables up to the finished bars of so many minutes."""
    return (
        MINUTES
        + f""", {name}_all AS (
    SELECT product_id, m // {minutes} AS b, arg_min(open, m) AS open, max(high) AS high, min(low) AS low, arg_max(close, m) AS close,
           sum(volume) AS volume, max(m) AS last_m FROM bars_1m GROUP BY ALL),
    {name} AS (
    SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY b) - 1 AS INTEGER) AS bar_idx, make_timestamp(b * {minutes} * 60000000) AS ts,
           open, high, low, close, volume
    FROM (SELECT *, max(b) OVER (PARTITION BY product_id) AS top FROM {name}_all) WHERE b < top OR last_m + 1 >= (b + 1) * {minutes})"""
    )


LAKE_BARS = "lake_kept AS (SELECT venue || '|' || product_id AS product_id, \"timestamp\" AS ts, arg_max({'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume}, (ingested_at, bar_id)) AS x FROM bars WHERE venue IS NOT NULL AND product_id IS NOT NULL AND \"timestamp\" IS NOT NULL GROUP BY ALL), lake_bars AS (SELECT product_id, ts, CAST(row_number() OVER (PARTITION BY product_id ORDER BY ts) - 1 AS INTEGER) AS bar_idx, " + ", ".join(f"CASE WHEN NOT isnan(x.{c}) THEN x.{c} END AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM lake_kept)"

WALK = """day AS (
    SELECT l_returnflag AS product_id, date_trunc('day', l_shipdate) AS ts,
           CAST((((sum(l_orderkey * 31 + l_partkey * 17) % 601) + 601) % 601) - 300 AS BIGINT) AS bp, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
    level AS (
    SELECT *, 100 * exp(CAST(sum(bp) OVER (PARTITION BY product_id ORDER BY ts) AS DOUBLE) / 10000) AS close,
           CAST(row_number() OVER (PARTITION BY product_id ORDER BY ts) - 1 AS INTEGER) AS bar_idx FROM day),
    path AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY product_id ORDER BY ts), 100.0) AS open FROM level),
    walk AS (
    SELECT product_id, bar_idx, ts, open, greatest(open, close) * 1.003 AS high, least(open, close) * 0.997 AS low, close, volume FROM path)"""


def _book_columns() -> str:
    out = []
    for i in range(1, 11):
        for column, value in ((f"bid_px_{i}", f"price * (1 - {i} * 1e-4)"), (f"ask_px_{i}", f"price * (1 + {i} * 1e-4)"), (f"bid_sz_{i}", f"CAST((seq * 7 + {i * 13}) % 50 + 1 AS DOUBLE)"), (f"ask_sz_{i}", f"CAST((seq * 11 + {i * 13}) % 50 + 1 AS DOUBLE)")):
            out.append(f"CASE WHEN seq % 10 + 1 >= {i} THEN {value} END AS {column}")
    return ", ".join(out)


BOOK = TICKS + f", book AS (SELECT product_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS venue, ts, seq, {_book_columns()} FROM ticks)"
