"""Order books and trade flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import sdiv
from .technical import side_sign

LEVELS = 10
#: Newest snapshots looked at, most prints, hours a book may be older than the newest.
TAIL, MAX_TRADES, MAX_AGE_H = 600, 5000, 48


def _told(side: str, n: int) -> Column:
    """The first n levels of a side as (px, sz), without those that have a null."""
    cells = F.array(*(F.struct(F.col(f"{side}_px_{i}").alias("px"), F.col(f"{side}_sz_{i}").alias("sz")) for i in range(1, n + 1)))
    return F.filter(cells, lambda x: x["px"].isNotNull() & x["sz"].isNotNull())


def _usable(x: Column) -> Column:
    return ~F.isnan(x["px"]) & ~F.isnan(x["sz"]) & (x["px"] > 0) & (x["sz"] >= 0)


def levels(side: str, n: int = LEVELS) -> Column:
    """The usable levels of a side; a later one moves up for a dropped one."""
    return F.filter(_told(side, n), _usable)


def best(side: str) -> Column:
    """The best level of a side; null if there is none or it can't be used."""
    first = F.get(_told(side, LEVELS), F.lit(0))
    return F.when(_usable(first), first)


def with_levels(book: DataFrame, n: int = LEVELS) -> DataFrame:
    return book.withColumns({"bids": levels("bid", n), "asks": levels("ask", n), "best_bid": best("bid"), "best_ask": best("ask")})


def _top(side: str, field: str) -> Column:
    return F.col({"bids": "best_bid", "asks": "best_ask"}[side])[field]


def quotes() -> dict[str, Column]:
    """micro, mid, deviation in bps, queue imbalance and spread in bps of the best levels; null on an empty or crossed book, the spread only without a side."""
    pb, qb, pa, qa = _top("bids", "px"), _top("bids", "sz"), _top("asks", "px"), _top("asks", "sz")
    open_ = pb <= pa
    micro, mid = sdiv(pa * qb + pb * qa, qb + qa), (pa + pb) / 2
    return {
        "micro": F.when(open_, micro), "mid": F.when(open_ & micro.isNotNull(), mid), "deviation_bps": F.when(open_, sdiv(micro - mid, mid) * 1e4),
        "queue_imbalance": sdiv(qb - qa, qb + qa), "spread_bps": sdiv(pa - pb, pb) * 1e4,
    }


def _two_sided(value: Column) -> Column:
    return F.when((F.size("bids") > 0) & (F.size("asks") > 0), value)


def _weighed(side: str, decay: float) -> Column:
    powers = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.pow(F.lit(decay), i))
    return F.aggregate(F.zip_with(F.col(side), powers, lambda x, w: F.coalesce(x["sz"] * w, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)


def pressure(decay: float = 0.5) -> Column:
    """Imbalance of sizes weighted by decay**level; null where a side is missing or all is empty."""
    bids, asks = _weighed("bids", decay), _weighed("asks", decay)
    return _two_sided(F.when(bids + asks > 0, F.try_divide(bids - asks, bids + asks)))


def depth_ratio(decay: float = 0.5) -> Column:
    """The bids' share of all sizes; null where pressure() is."""
    return F.when(pressure(decay).isNotNull(), F.coalesce(F.try_divide(depth("bids"), depth("bids") + depth("asks")), F.lit(0.5)))


def depth(side: str) -> Column:
    return F.aggregate(F.col(side), F.lit(0.0), lambda a, x: a + x["sz"])


def book_summary() -> dict[str, Column]:
    """Depths, their ratio and the spread in percent of the bid."""
    bid, ask = depth("bids"), depth("asks")
    return {"bid_depth": bid, "ask_depth": ask, "pressure": sdiv(bid, bid + ask), "spread_pct": sdiv(_top("asks", "px") - _top("bids", "px"), _top("bids", "px")) * 100}


def flow_imbalance(book: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ofi: what arrived at and left the best levels since the snapshot before."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = book.withColumns({"pb": _top("bids", "px"), "qb": _top("bids", "sz"), "pa": _top("asks", "px"), "qa": _top("asks", "sz")})
    was = {c: F.lag(c).over(w) for c in ("pb", "qb", "pa", "qa")}
    bid = F.when(F.col("pb") > was["pb"], F.col("qb")).when(F.col("pb") == was["pb"], F.col("qb") - was["qb"]).when(F.col("pb") < was["pb"], -was["qb"])
    ask = F.when(F.col("pa") < was["pa"], F.col("qa")).when(F.col("pa") == was["pa"], F.col("qa") - was["qa"]).when(F.col("pa") > was["pa"], -was["qa"])
    return rows.withColumn("ofi", bid - ask).drop("pb", "qb", "pa", "qa")


def trade_flow(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Signed flow of each group's prints: imbalance, volume delta, the later half's imbalance less the earlier's, count, share of large ones.

    Prints without a known side or a positive size don't count. The halves are told apart by ranks
    that are counted per group and stretch of time, so no task sorts a whole group.
    """
    rows = trades.withColumn("sign", side_sign()).filter(F.col("sign").isNotNull() & (F.col("size") > 0) & ~F.isnan("size"))
    rows = with_places(rows, by, order).withColumn("signed", F.col("sign") * F.col("size"))
    late, large = F.col("place") > F.floor(F.col("group_n") / 2), F.col("size") > 3 * F.col("group_mean")
    ratio = lambda half: F.coalesce(F.try_divide(F.sum(F.when(half, F.col("signed"))), F.sum(F.when(half, F.col("size")))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.sum("signed"), F.sum("size")).alias("tfi"), F.sum("signed").alias("cvd"),
        F.when(F.count("*") < 2, 0.0).otherwise(ratio(late) - ratio(~late)).alias("accel"), F.count("*").cast("double").alias("intensity"),
        F.try_divide(F.sum(F.when(large, F.col("size")).otherwise(0.0)), F.sum("size")).alias("large_share"),
    )


def with_places(rows: DataFrame, by: list[str], order: list[str], stretch: str = "1 hour") -> DataFrame:
    """Adds place (from 1, by `order`, whose first column is a time), group_n and group_mean (of size) within each group.

    Rows are ranked within their group's stretches of time; how many lie in the stretches before
    comes from their counts. The counts are as few as there are stretches.
    """
    cut = rows.withColumn("_cell", F.date_trunc(stretch.split()[1], F.col(order[0])))
    counts = cut.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
    w = Window.partitionBy(*by)
    before = counts.withColumns({
        "_before": F.sum("_n").over(w.orderBy("_cell")) - F.col("_n"), "group_n": F.sum("_n").over(w), "_total": F.sum("_s").over(w),
    }).select(*by, "_cell", "_before", "group_n", F.try_divide("_total", "group_n").alias("group_mean"))
    ranked = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order)))
    return ranked.join(before, [*by, "_cell"]).withColumn("place", F.col("_before") + F.col("_k")).drop("_cell", "_before", "_k")


def kyle_lambda(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Price move from the first print to the last, in bps per unit of traded size; null for a single print."""
    at = F.struct(*order)
    first, last = F.min_by("price", at), F.max_by("price", at)
    move = F.try_divide(F.try_divide(F.abs(last - first), first) * 1e4, F.sum("size"))
    usable = trades.filter("price > 0 AND NOT isnan(price) AND size > 0 AND NOT isnan(size)")
    return usable.groupBy(*by).agg(F.when(F.count("*") >= 2, move).alias("kyle_lambda"))


def bundle(book: DataFrame, trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Every factor of each group's newest book (rows of with_levels()) and of all its prints, rounded for showing."""
    q = quotes()
    values = {"micro_dev_bps": q["deviation_bps"], "queue_imbalance": q["queue_imbalance"], "book_pressure": pressure(), "depth_ratio": depth_ratio(), "spread_bps": q["spread_bps"]}
    shown = [F.round(c, 3).alias(n) for n, c in values.items()]
    last = book.groupBy(*by).agg(F.max_by(F.struct("bids", "asks", "best_bid", "best_ask"), F.struct(*order)).alias("b")).select(*by, "b.*").select(*by, *shown)
    flow = trade_flow(trades, by, order).select(*by, F.round("tfi", 3).alias("tfi"), F.round("accel", 3).alias("flow_accel"), F.round("large_share", 3).alias("large_share"), "intensity")
    impact = kyle_lambda(trades, by, order).select(*by, F.round("kyle_lambda", 4).alias("impact_bps_per_unit"))
    return last.join(flow, by, "left").join(impact, by, "left")


def freshest_venue(book: DataFrame) -> DataFrame:
    """(product_id, venue): where the newest snapshot is; the first by name of several."""
    newest = book.groupBy("product_id", "venue").agg(F.max("ts").alias("newest"))
    return newest.groupBy("product_id").agg(F.min_by("venue", F.struct((-F.unix_micros("newest")).alias("t"), "venue")).alias("venue"))


def newest(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def tail(book: DataFrame, n: int = TAIL) -> DataFrame:
    """The newest snapshots of each product on its freshest venue, none older than MAX_AGE_H before the newest."""
    here = book.join(freshest_venue(book), ["product_id", "venue"], "left_semi")
    top = here.groupBy("product_id").agg(F.max("ts").alias("top"))
    recent = here.join(top, "product_id").filter(F.col("ts") >= F.col("top") - F.expr(f"INTERVAL {MAX_AGE_H} HOURS")).drop("top")
    return newest(recent, ["product_id"], ["ts", "seq"], n)


def section(book: DataFrame, trades: DataFrame, n: int = TAIL, most: int = MAX_TRADES) -> DataFrame:
    """One row per product: value, mean, deviation and count of each of the tail's series, and aggregates of the prints within its window.

    has_flow is false where no print lies within the window.
    """
    t = with_levels(tail(book, n))
    q = quotes()
    t = t.withColumns({"micro_dev_bps": q["deviation_bps"], "queue_imbalance": q["queue_imbalance"], "book_pressure": pressure(), "depth_ratio": depth_ratio(), "spread_bps": q["spread_bps"]})
    t = flow_imbalance(t, ["product_id"], ["ts", "seq"]).withColumnRenamed("ofi", "snapshot_ofi")
    at = F.struct("ts", "seq")
    stats = []
    for c in ("micro_dev_bps", "queue_imbalance", "book_pressure", "depth_ratio", "spread_bps", "snapshot_ofi"):
        stats += [F.round(F.max_by(c, at), 4).alias(f"{c}_value"), F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std"), F.count(c).alias(f"{c}_n")]
    window = t.groupBy("product_id").agg(F.max("venue").alias("venue"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("snapshots"), *stats)
    window = window.withColumn("span_s", F.round((F.unix_micros("to_ts") - F.unix_micros("from_ts")) / 1e6, 3))
    inside = trades.join(window.select("product_id", "from_ts", "to_ts"), "product_id").filter("ts BETWEEN from_ts AND to_ts").drop("from_ts", "to_ts")
    inside = newest(inside, ["product_id"], ["ts", "seq"], most)
    names = {"tfi": "tfi", "cvd": "cvd", "accel": "flow_accel", "intensity": "intensity", "large_share": "large_share"}
    flow = trade_flow(inside, ["product_id"], ["ts", "seq"]).select("product_id", *(F.round(c, 4).alias(n) for c, n in names.items()))
    impact = kyle_lambda(inside, ["product_id"], ["ts", "seq"]).select("product_id", F.round("kyle_lambda", 4).alias("impact_bps_per_unit"))
    count = inside.groupBy("product_id").agg(F.count("*").alias("trades"))
    out = window.join(count, "product_id", "left").join(flow, "product_id", "left").join(impact, "product_id", "left")
    return out.withColumns({"trades": F.coalesce("trades", F.lit(0)), "has_flow": F.col("tfi").isNotNull() | F.col("impact_bps_per_unit").isNotNull()})
