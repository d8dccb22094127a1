"""Queries of books, trade flow, quoting and costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import microstructure as micro
from ..operators import quoting
from ..session import table
from . import views
from .factor_queries import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _levels_sql(side: str) -> str:
    cells = ", ".join(f"{{'px': {side}_px_{i}, 'sz': {side}_sz_{i}}}" for i in range(1, 11))
    told, fine = f"list_filter([{cells}], lambda x: x.px IS NOT NULL AND x.sz IS NOT NULL)", "NOT isnan(x.px) AND NOT isnan(x.sz) AND x.px > 0 AND x.sz >= 0"
    return f"list_filter({told}, lambda x: {fine}) AS {side}s, list_filter({told}[1:1], lambda x: {fine})[1] AS top_{side}"


_LV = f"lv AS (SELECT product_id, venue, ts, seq, {_levels_sql('bid')}, {_levels_sql('ask')} FROM book)"
_TOPS = "tops AS (SELECT *, top_bid.px AS pb, top_bid.sz AS qb, top_ask.px AS pa, top_ask.sz AS qa FROM lv)"
_LEVELS = with_(views.BOOK, _LV, _TOPS)
_Q = {
    "micro": "CASE WHEN pb <= pa AND qb + qa >= 1e-12 THEN (pa * qb + pb * qa) / (qb + qa) END", "mid": "CASE WHEN pb <= pa AND qb + qa >= 1e-12 THEN (pa + pb) / 2 END",
    "queue_imbalance": "CASE WHEN abs(qb + qa) >= 1e-12 THEN (qb - qa) / (qb + qa) END", "spread_bps": "(pa - pb) / pb * 1e4",
}
_Q["deviation_bps"] = f"({_Q['micro']} - {_Q['mid']}) / ({_Q['mid']}) * 1e4"


def _book(s: SparkSession, d: str) -> DataFrame:
    return micro.with_levels(views.book(s, d))


def _one(*names: str):  # noqa: ANN202
    return lambda s, d: _book(s, d).select("product_id", "seq", *(micro.quotes()[n].alias(n) for n in names)), _LEVELS + "SELECT product_id, seq, " + ", ".join(f"{_Q[n]} AS {n}" for n in names) + " FROM tops"


add("micro_price", *_one("micro", "mid", "deviation_bps"))
add("queue_imbalance", *_one("queue_imbalance"))
add("spread_bps", *_one("spread_bps"))
_pw = lambda s: f"coalesce(list_sum(list_transform({s}, lambda x, i: x.sz * pow(0.5, i - 1))), 0)"
_dp = lambda s: f"coalesce(list_sum(list_transform({s}, lambda x: x.sz)), 0)"
_PR = {
    "pressure": f"CASE WHEN len(bids) > 0 AND len(asks) > 0 AND {_pw('bids')} + {_pw('asks')} > 0 THEN ({_pw('bids')} - {_pw('asks')}) / ({_pw('bids')} + {_pw('asks')}) END",
    "depth_ratio": f"CASE WHEN len(bids) > 0 AND len(asks) > 0 AND {_pw('bids')} + {_pw('asks')} > 0 THEN {_dp('bids')} / ({_dp('bids')} + {_dp('asks')}) END",
}
add("book_pressure", lambda s, d: _book(s, d).select("product_id", "seq", F.round(micro.pressure(), 6).alias("pressure"), F.round(micro.depth_ratio(), 6).alias("depth_ratio")), _LEVELS + f"SELECT product_id, seq, round({_PR['pressure']}, 6) AS pressure, round({_PR['depth_ratio']}, 6) AS depth_ratio FROM tops")
add("orderbook_summary", lambda s, d: _book(s, d).select("product_id", "seq", *(F.round(c, 6).alias(n) for n, c in micro.book_summary().items())), _LEVELS + f"SELECT product_id, seq, round({_dp('bids')}, 6) AS bid_depth, round({_dp('asks')}, 6) AS ask_depth, round({_dp('bids')} / ({_dp('bids')} + {_dp('asks')}), 6) AS pressure, round((pa - pb) / pb * 100, 6) AS spread_pct FROM tops")
_OFI = "(CASE WHEN pb > lag(pb) OVER w THEN qb WHEN pb = lag(pb) OVER w THEN qb - lag(qb) OVER w WHEN pb < lag(pb) OVER w THEN -lag(qb) OVER w END) - (CASE WHEN pa < lag(pa) OVER w THEN qa WHEN pa = lag(pa) OVER w THEN qa - lag(qa) OVER w WHEN pa > lag(pa) OVER w THEN -lag(qa) OVER w END)"
add("snapshot_ofi", lambda s, d: micro.flow_imbalance(_book(s, d), ["product_id", "venue"], ["ts", "seq"]).select("product_id", "venue", "seq", "ofi"), _LEVELS + f"SELECT product_id, venue, seq, {_OFI} AS ofi FROM tops WINDOW w AS (PARTITION BY product_id, venue ORDER BY ts, seq)")


def flow_sql(source: str, by: str = "product_id", order: str = "ts, seq") -> list[str]:
    """A table flow: the prints of each group in order, both halves' ratios told apart."""
    return [
        f"fl_s AS (SELECT *, CASE WHEN lower(trim(side)) IN ('buy', 'b', 'bid') THEN size WHEN lower(trim(side)) IN ('sell', 's', 'ask') THEN -size END AS signed FROM {source} WHERE size > 0)",
        f"fl_k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k, count(*) OVER (PARTITION BY {by}) AS n, avg(size) OVER (PARTITION BY {by}) AS mean FROM fl_s WHERE signed IS NOT NULL)",
        f"""flow AS (SELECT {by}, count(*) AS n, sum(signed) / sum(size) AS tfi, sum(signed) AS cvd,
            CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(signed) FILTER (k > n // 2) / sum(size) FILTER (k > n // 2) - sum(signed) FILTER (k <= n // 2) / sum(size) FILTER (k <= n // 2) END AS accel,
            CAST(count(*) AS DOUBLE) AS intensity, coalesce(sum(size) FILTER (size > 3 * mean), 0) / sum(size) AS large_share FROM fl_k GROUP BY ALL)""",
    ]


_flow_columns = ("tfi", "accel", "large_share")
add("trade_flow", lambda s, d: micro.trade_flow(views.ticks(s, d), ["product_id"], ["ts", "seq"]).withColumns({c: F.round(c, 6) for c in _flow_columns}), with_(views.TICKS, *flow_sql("ticks")) + "SELECT product_id, n, round(tfi, 6) AS tfi, cvd, round(accel, 6) AS accel, intensity, round(large_share, 6) AS large_share FROM flow")
_real = ("venue", "product_id")


def _lake_prints(s: SparkSession, d: str) -> DataFrame:
    """The lake's own prints, each once: late, oddly written, with nulls."""
    return table(s, d, "market_trades").filter("product_id IS NOT NULL AND ts IS NOT NULL").groupBy("trade_id").agg(F.min(F.struct("ts", "venue", "product_id", "price", "size", "side")).alias("p")).select("trade_id", "p.*")


_LAKE_PRINTS = "prints AS (SELECT DISTINCT ON (trade_id) trade_id, ts, venue, product_id, price, size, side FROM market_trades WHERE product_id IS NOT NULL AND ts IS NOT NULL ORDER BY trade_id, ts, venue, product_id)"
add(
    "lake_trade_flow", lambda s, d: micro.trade_flow(_lake_prints(s, d), [*_real], ["ts", "trade_id"]).withColumns({c: F.round(c, 6) for c in ("tfi", "cvd", "accel", "large_share")}),
    with_(_LAKE_PRINTS, *flow_sql("prints", "venue, product_id", "ts, trade_id")) + "SELECT venue, product_id, n, round(tfi, 6) AS tfi, round(cvd, 6) AS cvd, round(accel, 6) AS accel, intensity, round(large_share, 6) AS large_share FROM flow",
)
add(
    "lake_kyle_lambda", lambda s, d: micro.kyle_lambda(_lake_prints(s, d), [*_real], ["ts", "trade_id"]).withColumn("kyle_lambda", F.round("kyle_lambda", 6)),
    with_(_LAKE_PRINTS) + "SELECT venue, product_id, CASE WHEN count(*) >= 2 THEN round(abs(arg_max(price, (ts, trade_id)) - arg_min(price, (ts, trade_id))) / arg_min(price, (ts, trade_id)) * 1e4 / sum(size), 6) END AS kyle_lambda FROM prints WHERE price > 0 AND NOT isnan(price) AND size > 0 AND NOT isnan(size) GROUP BY ALL",
)
add("kyle_lambda", lambda s, d: micro.kyle_lambda(views.ticks(s, d), ["product_id"], ["ts", "seq"]).withColumn("kyle_lambda", F.round("kyle_lambda", 6)), with_(views.TICKS) + "SELECT product_id, CASE WHEN count(*) >= 2 THEN round(abs(arg_max(price, (ts, seq)) - arg_min(price, (ts, seq))) / arg_min(price, (ts, seq)) * 1e4 / sum(size), 6) END AS kyle_lambda FROM ticks WHERE price > 0 AND size > 0 GROUP BY 1")
_VENUE = "newest AS (SELECT product_id, venue, max(ts) AS t FROM book GROUP BY ALL), picked AS (SELECT product_id, venue FROM newest QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY t DESC, venue) = 1)"
add("venue_pick", lambda s, d: micro.freshest_venue(views.book(s, d)), with_(views.BOOK, _VENUE) + "SELECT product_id, venue FROM picked")
_TAIL = "here AS (SELECT tops.* FROM tops SEMI JOIN picked USING (product_id, venue)), tl AS (SELECT * FROM here QUALIFY ts >= max(ts) OVER (PARTITION BY product_id) - INTERVAL 48 HOURS AND row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, seq DESC) <= 600)"
add("book_tail", lambda s, d: micro.tail(views.book(s, d)).select("product_id", "venue", "ts", "seq"), with_(views.BOOK, _LV, _TOPS, _VENUE, _TAIL) + "SELECT product_id, venue, ts, seq FROM tl")
add("trade_window", lambda s, d: _trade_window(s, d), with_(views.BOOK, _LV, _TOPS, _VENUE, _TAIL, "wn AS (SELECT product_id, min(ts) AS a, max(ts) AS b FROM tl GROUP BY 1)", "tw AS (SELECT ticks.* FROM ticks JOIN wn ON ticks.product_id = wn.product_id AND ts BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY ticks.product_id ORDER BY ts DESC, seq DESC) <= 5000)") + "SELECT product_id, ts, seq, price, size, side FROM tw")


def _trade_window(s: SparkSession, d: str) -> DataFrame:
    window = micro.tail(views.book(s, d)).groupBy("product_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    inside = views.ticks(s, d).join(window, "product_id").filter("ts BETWEEN a AND b")
    return micro.newest(inside, ["product_id"], ["ts", "seq"], micro.MAX_TRADES).select("product_id", "ts", "seq", "price", "size", "side")


_stats = {"micro_dev_bps": _Q["deviation_bps"], "queue_imbalance": _Q["queue_imbalance"], "book_pressure": _PR["pressure"], "depth_ratio": _PR["depth_ratio"], "spread_bps": _Q["spread_bps"], "snapshot_ofi": _OFI}
_one_flow = {"tfi": "tfi", "cvd": "cvd", "flow_accel": "accel", "intensity": "intensity", "large_share": "large_share"}
add(
    "micro_section", lambda s, d: micro.section(views.book(s, d), views.ticks(s, d)),
    with_(views.BOOK, _LV, _TOPS, _VENUE, _TAIL, "v AS (SELECT product_id, venue, ts, seq, " + ", ".join(f"{e} AS {n}" for n, e in _stats.items()) + " FROM tl WINDOW w AS (PARTITION BY product_id ORDER BY ts, seq))",
          "wn AS (SELECT product_id, max(venue) AS venue, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS snapshots, " + ", ".join(f"round(arg_max_null({n}, (ts, seq)), 4) AS {n}_value, round(avg({n}), 4) AS {n}_mean, round(stddev_samp({n}), 4) AS {n}_std, count({n}) AS {n}_n" for n in _stats) + " FROM v GROUP BY 1)",
          "tw AS (SELECT ticks.* FROM ticks JOIN wn ON ticks.product_id = wn.product_id AND ts BETWEEN from_ts AND to_ts QUALIFY row_number() OVER (PARTITION BY ticks.product_id ORDER BY ts DESC, seq DESC) <= 5000)", *flow_sql("tw"),
          "nt AS (SELECT product_id, count(*) AS trades, CASE WHEN count(*) FILTER (price > 0 AND size > 0) >= 2 THEN round(abs(arg_max(price, (ts, seq)) FILTER (price > 0 AND size > 0) - arg_min(price, (ts, seq)) FILTER (price > 0 AND size > 0)) / arg_min(price, (ts, seq)) FILTER (price > 0 AND size > 0) * 1e4 / sum(size) FILTER (price > 0 AND size > 0), 4) END AS impact_bps_per_unit FROM tw GROUP BY 1)")
    + "SELECT wn.*, round(epoch_us(to_ts) / 1e6 - epoch_us(from_ts) / 1e6, 3) AS span_s, coalesce(trades, 0) AS trades, " + ", ".join(f"round({c}, 4) AS {n}" for n, c in _one_flow.items()) + ", impact_bps_per_unit, flow.n IS NOT NULL OR impact_bps_per_unit IS NOT NULL AS has_flow FROM wn LEFT JOIN nt USING (product_id) LEFT JOIN flow USING (product_id)",
)
add(
    "microstructure_bundle", lambda s, d: micro.bundle(_book(s, d), views.ticks(s, d), ["product_id"], ["ts", "seq"]),
    with_(views.BOOK, _LV, _TOPS, "bk AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, seq DESC) = 1)", *flow_sql("ticks"),
          "kl AS (SELECT product_id, CASE WHEN count(*) >= 2 THEN abs(arg_max(price, (ts, seq)) - arg_min(price, (ts, seq))) / arg_min(price, (ts, seq)) * 1e4 / sum(size) END AS k FROM ticks WHERE price > 0 AND size > 0 GROUP BY 1)")
    + f"SELECT product_id, round({_Q['deviation_bps']}, 3) AS micro_dev_bps, round({_Q['queue_imbalance']}, 3) AS queue_imbalance, round({_PR['pressure']}, 3) AS book_pressure, round({_PR['depth_ratio']}, 3) AS depth_ratio, round({_Q['spread_bps']}, 3) AS spread_bps, round(tfi, 3) AS tfi, round(accel, 3) AS flow_accel, round(large_share, 3) AS large_share, intensity, round(k, 4) AS impact_bps_per_unit FROM bk LEFT JOIN flow USING (product_id) LEFT JOIN kl USING (product_id)",
)


def real_books(s: SparkSession, d: str) -> DataFrame:
    """The lake's own snapshots, each once, with their quotes."""
    finished = table(s, d, "book_files").filter(~F.col("path").endswith(".tmp")).select("file_id")
    rows = table(s, d, "book_top10").join(finished, "file_id", "left_semi").drop("file_id").dropDuplicates(["snap_id"])
    q = micro.quotes()
    return micro.with_levels(rows).select("snap_id", *(q[n].alias(n) for n in ("micro", "mid", "queue_imbalance", "spread_bps")))


add("lake_book_quotes", real_books, with_(
    "raw AS (SELECT DISTINCT ON (snap_id) * FROM book_top10 WHERE file_id IN (SELECT file_id FROM book_files WHERE path NOT LIKE '%.tmp'))",
    f"lv AS (SELECT snap_id, {_levels_sql('bid')}, {_levels_sql('ask')} FROM raw)", _TOPS) + "SELECT snap_id, " + ", ".join(f"{_Q[n]} AS {n}" for n in ("micro", "mid", "queue_imbalance", "spread_bps")) + " FROM tops")

# Costs, grids and quotes over the parts table, whose numbers stand for parameters.
def _params(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 20 + 1).cast("double").alias("a"), (F.col("p_partkey") % 7 + 1).cast("double").alias("b"), (100 + F.col("p_partkey") % 97).cast("double").alias("px"))


_PAR = "WITH p AS (SELECT p_partkey, CAST(p_partkey % 20 + 1 AS DOUBLE) AS a, CAST(p_partkey % 7 + 1 AS DOUBLE) AS b, CAST(100 + p_partkey % 97 AS DOUBLE) AS px FROM part) "


def _abx() -> tuple:
    """The parameter columns; columns can be made only once there is a session."""
    return F.col("a"), F.col("b"), F.col("px")


def _project(name: str, sql: str, columns: Callable[..., dict], digits: int = 6) -> None:
    add(name, lambda s, d: _params(s, d).select("p_partkey", *(F.round(c, digits).alias(n) for n, c in columns(*_abx()).items())), _PAR.rstrip() + (sql if sql.startswith(",") else " " + sql))


_project(
    "cost_floor", """SELECT p_partkey, CASE WHEN b <> 3 THEN round((b / 10) / (px + b / 20) * 1e4, 6) END AS spread,
        CASE WHEN b <> 3 THEN round((b / 10) / (px + b / 20) * 1e4 + a + a + b + b, 6) END AS taker, round(a + a, 6) AS maker FROM p""",
    lambda a, b, px: {"spread": quoting.mid_spread_bps(F.when(b != 3, px).otherwise(0.0), px + b / 10), "taker": quoting.roundtrip_cost_bps(quoting.mid_spread_bps(F.when(b != 3, px).otherwise(0.0), px + b / 10), a, b), "maker": quoting.maker_roundtrip_bps(a)},
)
_project("required_move", "SELECT p_partkey, round(2 * a, 6) AS move, CASE WHEN a > 5 THEN round(1.5 * (a - 5), 6) WHEN a = 5 THEN 0.0 END AS other FROM p", lambda a, b, px: {"move": quoting.required_move_bps(a), "other": quoting.required_move_bps(a - 5, 1.5)})
add("cost_table", lambda s, d: quoting.cost_table(s, 5.0), "SELECT 'exchange_intro_taker' AS preset, CAST(2 + 2 * 120 + 2 * 5 AS DOUBLE) AS roundtrip_bps UNION ALL SELECT 'retail_venue_markup_2026-08', CAST(190 + 2 * 5 AS DOUBLE)")
_project("anchor_gap", "SELECT p_partkey, round((px + b / 10 - px) / px * 1e4, 6) AS gap FROM p", lambda a, b, px: {"gap": quoting.anchor_gap_bps(px + b / 10, px)})


def _as(a, b, px) -> dict:  # noqa: ANN001
    g, s, t = F.lit(0.1), F.lit(2.0), F.lit(0.5)
    return quoting.quotes(px, a - 10, g, s, t, b, 5.0)


_project(
    "as_quotes", "SELECT p_partkey, round(r, 6) AS reservation, round(s, 6) AS spread, round(r - s / 2, 6) AS bid, round(r + s / 2, 6) AS ask FROM (SELECT p_partkey, px - (a - 10) * 0.1 * 4 * 0.5 AS r, greatest(5, 0.1 * 4 * 0.5 + 20 * ln(1 + 0.1 / b)) AS s FROM p)",
    _as,
)
_project(
    "inventory_skew",
    """, t AS (SELECT p_partkey, a, b * 2 AS w, (a + 500 / px) * 0.4 AS aim FROM p), l AS (SELECT *, greatest(aim - w, 0) AS low, aim + w AS high FROM t)
    SELECT p_partkey, round(CASE WHEN a < aim AND a <= low THEN 2 WHEN a < aim THEN 1 + (aim - a) / (aim - low) WHEN a > aim AND a >= high THEN 0 WHEN a > aim THEN 1 - (a - aim) / (high - aim) ELSE 1 END, 6) AS bid_ratio,
           round(CASE WHEN a < aim AND a <= low THEN 0 WHEN a < aim THEN 1 - (aim - a) / (aim - low) WHEN a > aim AND a >= high THEN 2 WHEN a > aim THEN 1 + (a - aim) / (high - aim) ELSE 1 END, 6) AS ask_ratio FROM l""",
    lambda a, b, px: dict(zip(("bid_ratio", "ask_ratio"), quoting.inventory_skew(a, F.lit(500.0), px, F.lit(0.4), b * 2))),
)
_project("spread_capture", "SELECT p_partkey, round(a + a - b - b - 0.5, 6) AS net FROM p", lambda a, b, px: {"net": quoting.spread_capture_bps(a, b, F.lit(0.5))})


def _ladder(s: SparkSession, d: str) -> DataFrame:
    a, b, px = _abx()
    bids, asks = quoting.ladder(px, a, b, 5)
    rows = _params(s, d).select("p_partkey", F.posexplode(F.arrays_zip(bids.alias("bid"), asks.alias("ask"))).alias("k", "level"))
    return rows.select("p_partkey", "k", F.round("level.bid", 6).alias("bid"), F.round("level.ask", 6).alias("ask"))


add("ladder", _ladder, _PAR + "SELECT p_partkey, CAST(k AS INTEGER) AS k, round(px - px * (a + k * b) / 10000, 6) AS bid, round(px + px * (a + k * b) / 10000, 6) AS ask FROM p, range(5) AS r(k)")


def _grid(s: SparkSession, d: str) -> DataFrame:
    a, b, px = _abx()
    levels = quoting.grid_levels(px, px * (1 + b / 10), a, True)
    rows = _params(s, d).withColumn("levels", levels)
    step = quoting.step_bps(F.col("levels"))
    return rows.select("p_partkey", F.round(step, 5).alias("step"), F.round(quoting.roundtrip_net_bps(step, a), 5).alias("net"), F.posexplode("levels").alias("i", "level")).withColumn("level", F.round("level", 6))


add("grid_levels", _grid, _PAR + "SELECT p_partkey, round((pow(1 + b / 10, 1 / a) - 1) * 1e4, 5) AS step, round((pow(1 + b / 10, 1 / a) - 1) * 1e4 - a, 5) AS net, CAST(i AS INTEGER) AS i, round(px * pow(1 + b / 10, i / a), 6) AS level FROM p, unnest(range(CAST(a AS BIGINT) + 1)) AS r(i)")
_GRID = [20.0 + 6.5 * k for k in range(61)]


def _replayed(s: SparkSession, d: str) -> DataFrame:
    got = quoting.replay_grid(views.walk(s, d), _GRID, 1.5, fee_bps=2.0, start=3.0)
    return got.select("product_id", "roundtrips", "buys", "sells", "final_inventory", "max_inventory", *(F.round(c, 5).alias(c) for c in ("realized_cash", "fees_paid", "inventory_mark", "total_pnl")))


# What rests at each level (1 a purchase, -1 a sale) is a list that each price turns into the next one's.
add("grid_replay", _replayed, with_(
    "RECURSIVE " + views.WALK, "g AS (SELECT list(20 + 6.5 * k ORDER BY k) AS lv FROM range(61) AS r(k))",
    """st AS (SELECT product_id, bar_idx, close AS px, [CASE WHEN l < close THEN 1 WHEN l > close THEN -1 ELSE 0 END FOR l IN lv] AS arm, CAST([] AS DOUBLE[]) AS bought, CAST([] AS DOUBLE[]) AS sold FROM walk, g WHERE bar_idx = 0
       UNION ALL SELECT w.product_id, w.bar_idx, w.close,
           [CASE WHEN x = 1 AND lv[i] >= w.close THEN 0
                 WHEN x = -1 AND lv[i] <= w.close THEN CASE WHEN i < 61 AND arm[i + 1] = -1 AND lv[i + 1] <= w.close THEN 1 ELSE 0 END
                 WHEN x = 0 AND i > 1 AND arm[i - 1] = 1 AND lv[i - 1] >= w.close THEN -1
                 WHEN x = 0 AND i < 61 AND arm[i + 1] = -1 AND lv[i + 1] <= w.close THEN 1 ELSE x END FOR x, i IN arm],
           [lv[i] FOR x, i IN arm IF x = 1 AND lv[i] >= w.close], [lv[i] FOR x, i IN arm IF x = -1 AND lv[i] <= w.close]
       FROM st JOIN walk w ON w.product_id = st.product_id AND w.bar_idx = st.bar_idx + 1, g)""",
    "f AS (SELECT *, 3 + 1.5 * sum(len(bought) - len(sold)) OVER (PARTITION BY product_id ORDER BY bar_idx) AS held FROM st)",
    """t AS (SELECT product_id, CAST(sum(len(bought)) AS BIGINT) AS buys, CAST(sum(len(sold)) AS BIGINT) AS sells, max(held) AS top, arg_max(held, bar_idx) AS held, arg_max(px, bar_idx) AS px,
              coalesce(sum(list_sum(sold)), 0) * 1.5 AS got, coalesce(sum(list_sum(bought)), 0) * 1.5 AS paid FROM f GROUP BY 1)""")
    + """SELECT product_id, least(buys, sells) AS roundtrips, buys, sells, CAST(held AS DOUBLE) AS final_inventory, CAST(top AS DOUBLE) AS max_inventory, round(got - paid - (got + paid) * 0.0002, 5) AS realized_cash,
                round((got + paid) * 0.0002, 5) AS fees_paid, round((held - 3) * px, 5) AS inventory_mark, round(got - paid - (got + paid) * 0.0002 + (held - 3) * px, 5) AS total_pnl FROM t""")  # fmt: skip
