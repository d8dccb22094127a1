"""Summaries per product: candles, prints, averages crossing, portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursion import ema, rsi_wilder
from ..plans.stretches import along, in_stretches

#: How many of the newest bars are searched for a crossing.
CROSS_BARS = 5


def ema_cross(bars: DataFrame, quick: int = 9, slow: int = 21) -> DataFrame:
    """(product_id, ema_fast, ema_slow, state, recent_cross) at the last bar: which mean is above, and the newest crossing of the last bars.

    A mean that was equal and now is above has crossed. All null up to `slow` bars.
    """
    rows = ema(bars.select("product_id", "bar_idx", "close"), {"quick": quick, "slow": slow})
    last = rows.groupBy("product_id").agg(F.max("bar_idx").alias("top"))
    tail = rows.join(last, "product_id").filter(F.col("bar_idx") >= F.col("top") - CROSS_BARS)
    # a handful of bars per product from here on
    w = Window.partitionBy("product_id").orderBy("bar_idx")
    side, was = F.col("quick") - F.col("slow"), F.lag(F.col("quick") - F.col("slow")).over(w)
    tail = tail.withColumn("cross", F.when((was <= 0) & (side > 0), "golden").when((was >= 0) & (side < 0), "death"))
    end = F.struct("quick", "slow", "top")
    out = tail.groupBy("product_id").agg(F.max_by(end, "bar_idx").alias("e"), F.max_by("cross", F.when(F.col("cross").isNotNull(), F.col("bar_idx"))).alias("c"))
    known, q, s = F.col("e.top") >= slow, F.col("e.quick"), F.col("e.slow")
    state = F.when(q > s, "bullish").when(q < s, "bearish").when(q == s, "flat")
    return out.select("product_id", F.when(known, F.round(q, 6)).alias("ema_fast"), F.when(known, F.round(s, 6)).alias("ema_slow"), F.when(known, state).alias("state"), F.when(known, F.col("c")).alias("recent_cross"))


def candle_summary(bars: DataFrame) -> DataFrame:
    """Change, range, population volatility, strength and averages of a product's candles; products of one candle don't come out."""
    rows = in_stretches(bars, 1, lambda df: df.withColumn("before", F.lag("close").over(along())))
    rows = rows.withColumn("ret", F.when(F.col("before") != 0, F.try_divide(F.col("close") - F.col("before"), F.col("before"))))
    first, last = F.min_by("close", "bar_idx"), F.max_by("close", "bar_idx")
    low, high = F.min("low"), F.max("high")
    facts = rows.groupBy("product_id").agg(
        F.count("*").alias("candles_used"), first.alias("first_close"), last.alias("last_close"), F.round(F.coalesce(F.try_divide(last - first, first), F.lit(0.0)) * 100, 2).alias("change_pct"),
        F.round(F.coalesce(F.try_divide(high - low, low), F.lit(0.0)) * 100, 2).alias("range_pct"), F.round(F.when(F.count("ret") > 1, F.stddev_pop("ret") * 100).otherwise(0.0), 3).alias("realized_vol_pct"),
    ).filter("candles_used >= 2")
    strength = rsi_wilder(bars.select("product_id", "bar_idx", "close"), "rsi").groupBy("product_id").agg(F.round(F.max_by("rsi", "bar_idx"), 2).alias("rsi_14"))
    cross = ema_cross(bars).select("product_id", F.col("ema_fast").alias("ema_9"), F.col("ema_slow").alias("ema_21"), F.col("state").alias("ema_trend"), F.col("recent_cross").alias("ema_recent_cross"))
    return facts.join(strength, "product_id", "left").join(cross, "product_id", "left")


def side_sign(side: str = "side"):  # noqa: ANN201
    """+1 for a purchase, -1 for a sale, null for anything else, in whatever case."""
    x = F.lower(F.trim(side))
    return F.when(x.isin("buy", "b", "bid"), 1).when(x.isin("sell", "s", "ask"), -1)


def trade_summary(trades: DataFrame) -> DataFrame:
    """Shares bought and sold (of what has a side), mean size, prints above three means, signed volume. The mean joins back as one row per product."""
    sign, size = F.coalesce(side_sign(), F.lit(0)), F.coalesce("size", F.lit(0.0))
    rows = trades.select("product_id", sign.alias("sign"), size.alias("size"))
    rows = rows.join(rows.groupBy("product_id").agg(F.avg("size").alias("mean")), "product_id")
    cvd, sided = F.sum(F.col("sign") * F.col("size")), F.sum(F.when(F.col("sign") != 0, F.col("size")).otherwise(0.0))
    share = lambda s: F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("sign") == s, F.col("size")).otherwise(0.0)), sided), F.lit(0.0)) * 100, 2)
    return rows.groupBy("product_id").agg(
        F.count("*").alias("trades_used"), share(1).alias("aggressive_buy_pct"), share(-1).alias("aggressive_sell_pct"), F.round(F.first("mean"), 4).alias("avg_trade_size"),
        F.count_if(F.col("size") > 3 * F.col("mean")).alias("large_trades_count"), F.round(cvd, 4).alias("cvd"), F.round(F.coalesce(F.try_divide(cvd, F.first("mean")), F.lit(0.0)), 3).alias("cvd_normalized"),
    )


def first_number(*columns: str):  # noqa: ANN201
    """The first of the columns that is a number other than nothing, 0 or an unreadable text."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))


def portfolio(positions: DataFrame, tickers: DataFrame, owner: str, prices: tuple[str, ...] = ("price",), changes: tuple[str, ...] = ()) -> DataFrame:
    """Price, value and weight of each position, and the change of 24 hours in percent where a ticker tells it; a symbol without a price is worth nothing.

    prices and changes name the tickers' columns to be tried in turn; changes are fractions.
    """
    change = F.round(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("double") for c in changes), F.lit(None).cast("double")) * 100, 4)
    known = tickers.select("symbol", first_number(*prices).alias("_price"), change.alias("change_24h_pct"))
    rows = positions.join(known, "symbol", "left").withColumn("_price", F.coalesce("_price", F.lit(0.0)))
    rows = rows.withColumn("_value", F.col("quantity") * F.col("_price"))
    total = rows.groupBy(owner).agg(F.sum("_value").alias("_total"))
    rows = rows.join(total, owner)
    weight = F.coalesce(F.try_divide("_value", "_total"), F.lit(0.0)) * 100
    return rows.select(owner, "symbol", "quantity", F.round("_price", 6).alias("price_usdt"), F.round("_value", 2).alias("value_usdt"), F.round(weight, 2).alias("weight_pct"), "change_24h_pct")
