"""Queries of volatility, momentum, robust scores and technical summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recursion, volatility
from ..operators import policy, technical
from ..session import table
from . import views
from .factor_queries import rounded, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

P = "PARTITION BY product_id ORDER BY bar_idx"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def ewma_sql(source: str, name: str, com: float, ppy: float) -> list[str]:
    """The recursion in closed form: powers of lambda take its place."""
    lam = com / (com + 1)
    return [
        f"{name}_r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({P}) > 0 THEN pow(ln(close / lag(close) OVER ({P})), 2) END AS r2 FROM {source})",
        f"{name}_n AS (SELECT *, count(r2) OVER ({P}) AS n FROM {name}_r)",
        f"{name}_s AS (SELECT *, sum(CASE WHEN n <= 20 THEN r2 END) OVER ({P}) / 20 AS seed, coalesce(sum(CASE WHEN n > 20 THEN r2 * pow({lam!r}, -(n - 20)) END) OVER ({P}), 0) AS tail FROM {name}_n)",
        f"{name}_v AS (SELECT * EXCLUDE (r2, n, seed, tail), CASE WHEN n > 20 THEN sqrt({ppy} * pow({lam!r}, n - 20) * (seed + (1 - {lam!r}) * tail)) END AS {name} FROM {name}_s)",
    ]


add("ewma_vol", lambda s, d: recursion.ewma_volatility(views.walk(s, d).select("product_id", "bar_idx", "close"), {"vol": 60}, 365.0).select("product_id", "bar_idx", F.round("vol", 6).alias("vol")), with_(views.WALK, *ewma_sql("walk", "vol", 60, 365.0)) + "SELECT product_id, bar_idx, round(vol, 6) AS vol FROM vol_v")
add("rogers_satchell", lambda s, d: rounded(volatility.rogers_satchell(views.walk(s, d)), 9, "rs"), with_(views.WALK) + "SELECT product_id, round(avg(ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))), 9) AS rs FROM walk GROUP BY product_id")
add(
    "yang_zhang", lambda s, d: rounded(volatility.yang_zhang(views.walk(s, d), 365.0), 6, "vol"),
    with_(views.WALK, f"g AS (SELECT *, ln(open / lag(close) OVER ({P})) AS gap, ln(close / open) AS c, ln(high / open) AS u, ln(low / open) AS dn FROM walk)",
          "a AS (SELECT product_id, count(*) AS m, var_samp(gap) AS vo, var_samp(c) AS vc, avg(u * (u - c) + dn * (dn - c)) AS vr FROM g WHERE bar_idx > 0 GROUP BY 1)")
    + "SELECT product_id, round(sqrt((vo + k * vc + (1 - k) * vr) * 365), 6) AS vol FROM (SELECT *, 0.34 / (1.34 + (m + 1.0) / (m - 1)) AS k FROM a)",
)


def _returns(s: SparkSession, d: str) -> DataFrame:
    from .compiler import evaluate

    return evaluate(views.walk(s, d), {"ret": "returns"}).select("product_id", "bar_idx", "ret").filter("ret IS NOT NULL")


_RET = with_(views.WALK, f"rets AS (SELECT product_id, bar_idx, close / lag(close) OVER ({P}) - 1 AS ret FROM walk), r AS (SELECT * FROM rets WHERE ret IS NOT NULL)")
add(
    "robust_z", lambda s, d: volatility.robust_z(_returns(s, d), "bar_idx", "ret").select("product_id", "bar_idx", F.round("z", 5).alias("z")),
    _RET + ", m AS (SELECT bar_idx, quantile_cont(ret, 0.5) AS med, stddev_samp(ret) AS sd FROM r GROUP BY 1), a AS (SELECT bar_idx, quantile_cont(abs(ret - med), 0.5) AS mad FROM r JOIN m USING (bar_idx) GROUP BY 1)"
    " SELECT product_id, bar_idx, round(greatest(-3, least(3, CASE WHEN mad * 1.4826 > 1e-12 THEN (ret - med) / (mad * 1.4826) WHEN sd > 1e-12 THEN (ret - med) / sd ELSE 0 END)), 5) AS z FROM r JOIN m USING (bar_idx) JOIN a USING (bar_idx)",
)
add(
    "rank_scores", lambda s, d: volatility.rank_scores(_returns(s, d).withColumn("ret", F.round("ret", 10)), "bar_idx", "ret", "product_id").select("product_id", "bar_idx", F.round("score", 6).alias("score")),
    _RET + " SELECT product_id, bar_idx, round(CASE WHEN n > 1 THEN (k - (n + 1) / 2.0) / sqrt((n * n - 1) / 12.0) ELSE 0 END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY bar_idx ORDER BY round(ret, 10), product_id) AS k, count(*) OVER (PARTITION BY bar_idx) AS n FROM r)",
)


def _beta(s: SparkSession, d: str) -> DataFrame:
    r = _returns(s, d)
    bench = r.groupBy("bar_idx").agg(F.avg("ret").alias("bench"))
    pairs = r.join(bench, "bar_idx").select("product_id", "bar_idx", F.col("ret").alias("asset"), "bench")
    return recursion.ewma_beta(pairs).select("product_id", "bar_idx", F.round("beta", 5).alias("beta"))


_D = repr(0.5 ** (1 / 60))
# Powers of the decay are taken from the first pair on, so that each bar's sum is that of the recursion.
add(
    "ewma_beta", _beta,
    _RET + f""", b AS (SELECT bar_idx, avg(ret) AS bench FROM r GROUP BY 1), p AS (SELECT product_id, bar_idx, ret AS a, bench AS b, row_number() OVER ({P}) AS n FROM r JOIN b USING (bar_idx)),
    w AS (SELECT product_id, bar_idx, n, a * b AS ab, b * b AS bb, pow({_D}, -(n - 1)) AS up FROM p),
    m AS (SELECT *, (first_value(ab) OVER ({P}) + (1 - {_D}) * (sum(ab * up) OVER ({P}) - first_value(ab) OVER ({P}))) / up AS cov, (first_value(bb) OVER ({P}) + (1 - {_D}) * (sum(bb * up) OVER ({P}) - first_value(bb) OVER ({P}))) / up AS var FROM w)
    SELECT product_id, bar_idx, round(CASE WHEN n < 90 OR var <= 1e-18 THEN 1.0 ELSE greatest(0, least(3, (2 / 3.0) * cov / var + 1 / 3.0)) END, 5) AS beta FROM m""",
)

_TREND = with_(
    views.WALK, *ewma_sql("walk", "fast", 5, 365.0), *ewma_sql("fast_v", "slow", 180, 365.0),
    f"t0 AS (SELECT product_id, bar_idx, close, lag(fast, 2) OVER ({P}) AS f, lag(slow, 2) OVER ({P}) AS s, lag(close, 22) OVER ({P}) AS p22, lag(close, 65) OVER ({P}) AS p65, lag(close, 261) OVER ({P}) AS p261 FROM slow_v)",
    "t1 AS (SELECT *, CASE WHEN bar_idx >= 262 THEN greatest(0.05, (f + s) / 2) END AS sigma, CASE WHEN bar_idx >= 262 THEN f / s END AS vol_ratio FROM t0)",
    "t2 AS (SELECT *, " + ", ".join(f"tanh(ln(close / p{k}) / (sigma * sqrt({k} / 365.0)) / 2) AS s{k}" for k in (22, 65, 261)) + " FROM t1)",
    "t3 AS (SELECT *, 0.5 * s22 + 0.5 * s261 AS score FROM t2)",
    """trend AS (SELECT *, CASE WHEN score IS NULL THEN 'uncertain' WHEN score >= 0.15 AND vol_ratio > 1.25 THEN 'high_volatility_event' WHEN score >= 0.15 THEN 'trend_up'
        WHEN score <= -0.15 THEN 'trend_down' ELSE 'range_bound' END AS regime,
        CASE WHEN score IS NULL THEN 0.3 WHEN abs(score) >= 0.15 OR (s261 < 0 AND s22 >= 0.15) THEN round(0.5 + 0.45 * least(abs(score), 1), 2)
        ELSE round(0.3 + 0.19 * (1 - least(abs(score), 0.15) / 0.15), 2) END AS confidence FROM t3)""",
)


def trend_rows(s: SparkSession, d: str) -> DataFrame:
    regime, confidence = volatility.trend_state()
    return volatility.trend(views.walk(s, d)).withColumns({"regime": regime, "confidence": confidence})


add("tsmom_score", lambda s, d: rounded(volatility.trend(views.walk(s, d)), 5, "sigma", "s22", "s65", "s261", "score", "vol_ratio").drop("close"), _TREND + "SELECT product_id, bar_idx, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("sigma", "s22", "s65", "s261", "score", "vol_ratio")) + " FROM trend")
add("tsmom_regime", lambda s, d: trend_rows(s, d).select("product_id", "bar_idx", "regime", "confidence"), _TREND + "SELECT product_id, bar_idx, regime, confidence FROM trend")
add("target_weight", lambda s, d: volatility.trend(views.walk(s, d)).select("product_id", "bar_idx", F.round(volatility.target_weight(F.col("score"), F.col("sigma")), 5).alias("weight")), _TREND + "SELECT product_id, bar_idx, round(CASE WHEN sigma > 0 THEN greatest(0, least(1, score * 0.1 / sigma)) END, 5) AS weight FROM trend")
add("institutional_signal", lambda s, d: trend_rows(s, d).select("product_id", "bar_idx", policy.action(F.col("regime"), F.col("confidence")).alias("action")), _TREND + f"SELECT product_id, bar_idx, {policy.action_sql('regime', 'confidence')} AS action FROM trend")

# Momentum against its own history, on hourly bars.
def _label_sql(x: str, steps: tuple[tuple[str, str], ...], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {cond} THEN '{name}'" for cond, name in steps) + f" ELSE '{other}' END"


_Z_LABEL = _label_sql("z", (("IS NULL", "insufficient_data"), (">= 2", "extremely_high"), (">= 1", "high"), ("<= -2", "extremely_low"), ("<= -1", "low")), "neutral")
_VOL_LABEL = _label_sql("p", ((">= 0.9", "extreme"), (">= 0.7", "elevated"), (">= 0.3", "normal"), (">= 0.1", "compressed")), "extremely_compressed")
_FUNDING_LABEL = _label_sql("p", ((">= 0.95", "extremely_positive"), (">= 0.8", "positive"), ("<= 0.05", "extremely_negative"), ("<= 0.2", "negative")), "neutral")
_F = f"OVER ({P} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"


def _scored_sql(source: str, x: str) -> list[str]:
    """The values before each one, how they score it, and its midrank among them."""
    near = f"abs(v - {x}) <= 1e-9 * greatest(abs({x}), list_max(list_transform(seen, lambda u: abs(u))), 1e-12)"
    return [
        f"hist AS (SELECT *, coalesce(list_filter(list({x}) {_F}, lambda u: u IS NOT NULL), []) AS seen, CASE WHEN count({x}) {_F} >= 2 THEN ({x} - avg({x}) {_F}) / nullif(stddev_samp({x}) {_F}, 0) END AS z FROM {source})",
        f"scored AS (SELECT *, len(seen) AS samples, CASE WHEN {x} IS NULL THEN NULL WHEN len(seen) = 0 THEN 0.5 ELSE (len(list_filter(seen, lambda v: v < {x} AND NOT ({near}))) + 0.5 * len(list_filter(seen, lambda v: {near}))) / len(seen) END AS p FROM hist)",
    ]


for _h in (6, 24, 72):
    add(
        f"mom_z_{_h}", lambda s, d, h=_h: volatility.momentum_z(views.bars(s, d), h).select("product_id", "bar_idx", "return_pct", "z", "pct", "samples", "label"),
        with_(views.bars_sql(), f"r AS (SELECT *, CASE WHEN lag(close, {_h}) OVER ({P}) > 0 THEN close / lag(close, {_h}) OVER ({P}) - 1 END AS r FROM bars)", *_scored_sql("r", "r"))
        + f"SELECT product_id, bar_idx, round(r * 100, 4) AS return_pct, round(z, 3) AS z, round(p, 3) AS pct, CAST(samples AS INTEGER) AS samples, {_Z_LABEL} AS label FROM scored",
    )
_V24 = f"OVER ({P} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
add(
    "vol_regime", lambda s, d: volatility.volatility_state(views.bars(s, d)).select("product_id", "bar_idx", F.round("vol", 5).alias("vol"), F.round("median", 5).alias("median"), "pct", "z", "vol_of_vol", "samples", "regime"),
    with_(views.bars_sql(), f"r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({P}) > 0 THEN ln(close / lag(close) OVER ({P})) END AS lr FROM bars)",
          f"v AS (SELECT *, CASE WHEN count(lr) {_V24} = 24 THEN stddev_samp(lr) {_V24} * sqrt(8760) END AS vol FROM r)", *_scored_sql("v", "vol"))
    + f"""SELECT product_id, bar_idx, round(vol, 5) AS vol, round(z, 3) AS z, round(p, 3) AS pct, CASE WHEN vol IS NOT NULL THEN CAST(samples AS INTEGER) END AS samples, CASE WHEN vol IS NOT NULL THEN round(list_median(seen), 5) END AS median,
          CASE WHEN vol IS NOT NULL THEN CASE WHEN samples < 2 THEN 0.0 ELSE round(list_stddev_samp(seen) / list_avg(seen), 3) END END AS vol_of_vol,
          CASE WHEN vol IS NOT NULL THEN CASE WHEN samples = 0 THEN 'insufficient_history' ELSE {_VOL_LABEL} END END AS regime FROM scored""",
)


def _funding(s: SparkSession, d: str) -> DataFrame:
    rates = views.ticks(s, d).select("product_id", "ts", "seq", (F.col("price") / 1e5).alias("rate"))
    return volatility.funding_summary(rates, ["product_id"], ["ts", "seq"])


add("funding_z", _funding, with_(
    views.TICKS, "k AS (SELECT product_id, price / 1e5 AS rate, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, seq DESC) AS k FROM ticks)",
    "c AS (SELECT product_id, rate AS now FROM k WHERE k = 1), h AS (SELECT k.*, now FROM k JOIN c USING (product_id) WHERE k > 1)",
    "sc AS (SELECT product_id, greatest(max(abs(now)), max(abs(rate)), 1e-12) * 1e-9 AS tol FROM h GROUP BY 1)",
    "q AS (SELECT product_id, any_value(now) AS now, count(*) AS samples, median(rate) AS med, (any_value(now) - avg(rate)) / stddev_samp(rate) AS z, (count(*) FILTER (rate < now - tol) + 0.5 * count(*) FILTER (abs(rate - now) <= tol)) / count(*) AS p FROM h JOIN sc USING (product_id) GROUP BY 1)")
    + f"SELECT product_id, samples, round(now, 8) AS rate, round(now * 1095 * 100, 3) AS annual_pct, round(med, 8) AS median, round(z, 3) AS z, round(p, 3) AS pct, {_FUNDING_LABEL} AS regime FROM q")

# Technical summaries.
add("ema_9", lambda s, d: recursion.ema(views.bars(s, d).select("product_id", "bar_idx", "close"), {"ema": 9}).select("product_id", "bar_idx", F.round("ema", 6).alias("ema")))


def ema_sql(source: str, name: str, period: int, x: str = "close") -> list[str]:
    keep = repr(1 - 2 / (period + 1))
    return [f"{name}_s AS (SELECT *, sum(CASE WHEN bar_idx < {period} THEN {x} END) OVER ({P}) / {period} AS seed_, sum(CASE WHEN bar_idx >= {period} THEN {x} * pow({keep}, -(bar_idx - {period - 1})) ELSE 0 END) OVER ({P}) AS tail_ FROM {source})",
            f"{name}_v AS (SELECT * EXCLUDE (seed_, tail_), CASE WHEN bar_idx >= {period - 1} THEN pow({keep}, bar_idx - {period - 1}) * (seed_ + (1 - {keep}) * tail_) END AS {name} FROM {name}_s)"]


SQL["ema_9"] = with_(views.bars_sql(), *ema_sql("bars", "ema", 9)) + "SELECT product_id, bar_idx, round(ema, 6) AS ema FROM ema_v"
_CROSS = [
    *ema_sql("bars", "quick", 9), *ema_sql("quick_v", "slow", 21),
    f"gap AS (SELECT product_id, bar_idx, quick, slow, quick - slow AS g, lag(quick - slow) OVER ({P}) AS w, max(bar_idx) OVER (PARTITION BY product_id) AS top FROM slow_v)",
    """crossed AS (SELECT product_id, CASE WHEN max(top) >= 21 THEN round(arg_max(quick, bar_idx), 6) END AS ema_fast, CASE WHEN max(top) >= 21 THEN round(arg_max(slow, bar_idx), 6) END AS ema_slow,
        CASE WHEN max(top) >= 21 THEN CASE WHEN arg_max(g, bar_idx) > 0 THEN 'bullish' WHEN arg_max(g, bar_idx) < 0 THEN 'bearish' ELSE 'flat' END END AS state,
        CASE WHEN max(top) >= 21 THEN arg_max(CASE WHEN g > 0 THEN 'golden' ELSE 'death' END, bar_idx) FILTER (bar_idx > top - 5 AND ((w <= 0 AND g > 0) OR (w >= 0 AND g < 0))) END AS recent_cross FROM gap GROUP BY 1)""",
]
add("ema_cross", lambda s, d: technical.ema_cross(views.bars(s, d)), with_(views.bars_sql(), *_CROSS) + "SELECT * FROM crossed")
_k = repr(13 / 14)
_RSI = [
    f"dx AS (SELECT product_id, bar_idx, close - lag(close) OVER ({P}) AS dx FROM bars)",
    "ud AS (SELECT product_id, bar_idx, " + ", ".join(f"pow({_k}, bar_idx - 14) * (sum(CASE WHEN bar_idx BETWEEN 1 AND 14 THEN {e} / 14 ELSE 0 END) OVER ({P}) + sum(CASE WHEN bar_idx > 14 THEN {e} * pow({_k}, -(bar_idx - 14)) / 14 ELSE 0 END) OVER ({P})) AS {n}" for e, n in (("greatest(dx, 0)", "up"), ("greatest(-dx, 0)", "dn"))) + " FROM dx)",
    "strength AS (SELECT product_id, bar_idx, CASE WHEN bar_idx >= 14 THEN CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END END AS rsi FROM ud)",
]
add(
    "rsi_wilder", lambda s, d: recursion.rsi_wilder(views.bars(s, d).select("product_id", "bar_idx", "close"), "rsi").select("product_id", "bar_idx", F.round("rsi", 5).alias("rsi")),
    with_(views.bars_sql(), *_RSI) + "SELECT product_id, bar_idx, round(rsi, 5) AS rsi FROM strength",
)
add(
    "candles_technical", lambda s, d: technical.candle_summary(views.bars(s, d)),
    with_(views.bars_sql(), *_CROSS, *_RSI, f"r AS (SELECT *, close / lag(close) OVER ({P}) - 1 AS ret FROM bars)",
          "x AS (SELECT product_id, round(arg_max_null(rsi, bar_idx), 2) AS rsi_14 FROM strength GROUP BY 1)")
    + """SELECT product_id, count(*) AS candles_used, arg_min(close, bar_idx) AS first_close, arg_max(close, bar_idx) AS last_close, round((arg_max(close, bar_idx) / arg_min(close, bar_idx) - 1) * 100, 2) AS change_pct,
         round((max(high) - min(low)) / min(low) * 100, 2) AS range_pct, round(stddev_pop(ret) * 100, 3) AS realized_vol_pct, any_value(rsi_14) AS rsi_14, any_value(ema_fast) AS ema_9, any_value(ema_slow) AS ema_21,
         any_value(state) AS ema_trend, any_value(recent_cross) AS ema_recent_cross FROM r LEFT JOIN x USING (product_id) LEFT JOIN crossed USING (product_id) GROUP BY 1 HAVING count(*) >= 2""",
)
_SIDED = "CASE WHEN lower(trim(side)) IN ('buy', 'b', 'bid') THEN 1 WHEN lower(trim(side)) IN ('sell', 's', 'ask') THEN -1 ELSE 0 END"
add(
    "trades_summary", lambda s, d: technical.trade_summary(table(s, d, "market_trades").filter("product_id IS NOT NULL")),
    f"""WITH t AS (SELECT product_id, coalesce(size, 0) AS size, {_SIDED} AS sg, avg(coalesce(size, 0)) OVER (PARTITION BY product_id) AS mean FROM market_trades WHERE product_id IS NOT NULL)
        SELECT product_id, count(*) AS trades_used, round(coalesce(sum(size) FILTER (sg = 1), 0) / sum(size) FILTER (sg <> 0) * 100, 2) AS aggressive_buy_pct, round(coalesce(sum(size) FILTER (sg = -1), 0) / sum(size) FILTER (sg <> 0) * 100, 2) AS aggressive_sell_pct,
               round(any_value(mean), 4) AS avg_trade_size, count(*) FILTER (size > 3 * mean) AS large_trades_count, round(sum(sg * size), 4) AS cvd, round(sum(sg * size) / any_value(mean), 3) AS cvd_normalized FROM t GROUP BY 1""",
)


def _portfolio(s: SparkSession, d: str) -> DataFrame:
    held = table(s, d, "customer").select(F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "gone"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("symbol"), F.col("c_acctbal").alias("quantity"), F.col("c_nationkey").alias("owner"))
    held = held.groupBy("owner", "symbol").agg(F.sum("quantity").alias("quantity"))
    last = views.ticks(s, d).groupBy(F.col("product_id").alias("symbol")).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), (F.max_by("size", F.struct("ts", "seq")) / 1000).cast("string").alias("change24h"))
    # the signups' price stands in another column, and the views' change can't be read
    last = last.withColumns({"last": F.when(F.col("symbol") == "signup", "n/a").otherwise(F.col("close").cast("string")), "change_24h": F.when(F.col("symbol") == "view", "?")})
    return technical.portfolio(held, last, "owner", ("last", "close"), ("change_24h", "change24h"))


add(
    "portfolio_contexts", _portfolio,
    with_(views.TICKS, "last AS (SELECT product_id AS symbol, arg_max(price, (ts, seq)) AS price, round(arg_max(size, (ts, seq)) / 1000 * 100, 4) AS change FROM ticks GROUP BY 1)",
          "held AS (SELECT c_nationkey AS owner, ['click', 'view', 'signup', 'gone'][c_custkey % 4 + 1] AS symbol, sum(c_acctbal) AS quantity FROM customer GROUP BY ALL)",
          "v AS (SELECT owner, symbol, quantity, coalesce(price, 0) AS price, quantity * coalesce(price, 0) AS value, change FROM held LEFT JOIN last USING (symbol))")
    + "SELECT owner, symbol, quantity, round(price, 6) AS price_usdt, round(value, 2) AS value_usdt, CASE WHEN sum(value) OVER (PARTITION BY owner) = 0 THEN 0.0 ELSE round(100 * value / sum(value) OVER (PARTITION BY owner), 2) END AS weight_pct, change AS change_24h_pct FROM v",
)
add("policy_table", lambda s, d: policy.grid(s), policy.GRID_SQL)
add("legacy_policy", lambda s, d: policy.grid(s, legacy=True), policy.LEGACY_SQL)
add("canonical_symbol", lambda s, d: table(s, d, "products").select("product_id", policy.canonical_symbol(F.col("product_id")).alias("symbol")), "SELECT product_id, regexp_replace(regexp_replace(upper(product_id), '[-_/]', '', 'g'), '(USDT|USDC)$', 'USD') AS symbol FROM products")
add("momentum_signal", lambda s, d: policy.momentum_signal(views.walk(s, d)), with_(
    views.WALK, f"q AS (SELECT *, close - lag(close) OVER ({P}) AS dx, avg(close) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20, avg(close) OVER ({P} ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS s80 FROM walk)",
    f"g AS (SELECT *, sum(greatest(dx, 0)) OVER ({P} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS up, sum(greatest(-dx, 0)) OVER ({P} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS dn FROM q)",
    "h AS (SELECT *, CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi FROM g)")
    + """SELECT product_id, bar_idx, CASE WHEN bar_idx < 80 THEN 'uncertain' WHEN rsi >= 75 THEN 'high_volatility_event' WHEN rsi <= 25 AND close < s80 THEN 'range_bound' WHEN s20 > s80 THEN 'trend_up' WHEN s20 < s80 THEN 'trend_down' ELSE 'uncertain' END AS regime,
         round(CASE WHEN bar_idx < 80 THEN 0.3 WHEN rsi >= 75 THEN least(0.95, 0.6 + (rsi - 75) / 100) WHEN rsi <= 25 AND close < s80 THEN least(0.95, 0.6 + (25 - rsi) / 100) WHEN s20 > s80 THEN 0.7 WHEN s20 < s80 THEN 0.6 ELSE 0.4 END, 5) AS confidence FROM h""")  # fmt: skip
