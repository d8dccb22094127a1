"""Queries over bars: scans, the operator algebra, factors, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from . import expr, views
from .compiler import evaluate, to_sql
from .factors import FACTORS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Scans and resampling.
PRICES = ("open", "high", "low", "close", "volume")
for _label, _minutes in (("5m", 5), ("1h", 60), ("4h", 240), ("1d", 1440)):
    add(f"bars_{_label}", lambda s, d, g=_label: views.bars(s, d, g), with_(views.bars_sql(_minutes)) + "SELECT * FROM bars")
add("bars_1m", lambda s, d: views.ticks_to_minutes(views.ticks(s, d)), with_(views.MINUTES) + "SELECT product_id, make_timestamp(m * 60000000) AS ts, open, high, low, close, volume FROM bars_1m")
add("bars_walk_1d", lambda s, d: rounded(views.walk(s, d), 6, "open", "high", "low", "close"), with_(views.WALK) + "SELECT product_id, bar_idx, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM walk")

# One query per operator of the algebra.
OPERATORS = {
    "op_neg": ("neg", "close"), "op_abs": ("abs", ("delta", "close", 1)), "op_sign": ("sign", ("delta", "close", 1)), "op_log": ("log", ("delta", "close", 1)),
    "op_signedpower": ("signedpower", ("delta", "close", 1), 2), "op_add": ("add", "high", "low"), "op_sub": ("sub", "close", "open"), "op_mul": ("mul", "close", "volume"),
    "op_div": ("div", "close", ("delta", "volume", 1)), "op_delay": ("delay", "close", 5), "op_delta": ("delta", "close", 5), "op_ts_sum": ("ts_sum", "close", 10),
    "op_sma": ("sma", "close", 20), "op_ts_min": ("ts_min", "low", 10), "op_ts_max": ("ts_max", "high", 10), "op_ts_argmax": ("ts_argmax", "close", 10),
    "op_ts_rank": ("ts_rank", "close", 60), "op_ts_scale": ("ts_scale", ("delta", "close", 1), 60), "op_stddev": ("stddev", "returns", 20),
    "op_correlation": ("correlation", "close", "volume", 10), "op_rank": ("ts_rank", "volume", 60), "op_returns": "returns", "op_vwap": "vwap", "op_adv": ("sma", "volume", 20),
}


def _factor_query(node, digits: int = 6):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = evaluate(views.bars(spark, d), {"value": node})
        return out.select("product_id", "bar_idx", F.round("value", digits).alias("value"))

    ctes, last = to_sql("bars", {"value": node})
    return query, with_(views.bars_sql(), *ctes) + f"SELECT product_id, bar_idx, round(value, {digits}) AS value FROM {last}"


for _name, _node in OPERATORS.items():
    add(_name, *_factor_query(_node))
for _name, _factor in FACTORS.items():
    add(f"alpha_{_factor.number:03d}", *_factor_query(_factor.node, 5))

# Expressions given as text, as a search would propose them.
_seeds = {f"seed{i}": node for i, (node, _) in enumerate(expr.seed_nodes())}


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per factor: a single pass, no join."""
    return df.select("product_id", "bar_idx", "close", F.inline(F.array(*(F.struct(F.lit(n).alias("factor_id"), F.col(n).alias("x")) for n in names))))


def factor_long(spark: SparkSession, d: str, nodes: dict) -> DataFrame:
    return _long(evaluate(views.bars(spark, d), nodes), list(nodes))


def _long_sql(nodes: dict, source: str = "bars", tables: str | None = None) -> list[str]:
    ctes, last = to_sql(source, nodes)
    return [tables or views.bars_sql(), *ctes, "long AS (" + " UNION ALL ".join(f"SELECT product_id, bar_idx, close, '{n}' AS factor_id, {n} AS x FROM {last}" for n in nodes) + ")"]


add(
    "expr_eval_seeds", lambda s, d: factor_long(s, d, _seeds).select("product_id", "bar_idx", "factor_id", F.round("x", 6).alias("value")),
    with_(*_long_sql(_seeds)) + "SELECT product_id, bar_idx, factor_id, round(x, 6) AS value FROM long",
)

# Evaluation.
_all = {k: f.node for k, f in FACTORS.items()}
_a3 = {"a003": FACTORS["a003"].node}
W = "OVER (PARTITION BY product_id, factor_id ORDER BY bar_idx)"


def canonical_sql(x: str) -> str:
    """x at 33 binary digits."""
    return f"({x} * 1048577.0) - (({x} * 1048577.0) - {x})"


def spearman_sql(source: str, by: str, name: str) -> list[str]:
    """Tables from pairs (by, x, y) to (by, n, rho)."""
    return [
        f"{name}_k AS (SELECT * REPLACE ({canonical_sql('x')} AS x, {canonical_sql('y')} AS y) FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))",
        f"{name}_r AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0 AS ry FROM {name}_k)",
        f"{name} AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) * count(*) >= 1e-12 AND var_pop(ry) * count(*) >= 1e-12 THEN greatest(-1.0, least(1.0, covar_pop(rx, ry) / (sqrt(var_pop(rx)) * sqrt(var_pop(ry))))) END AS rho FROM {name}_r GROUP BY ALL)",
    ]


def _ic_sql(nodes: dict, horizons: tuple[int, ...], source: str = "bars", tables: str | None = None) -> str:
    pairs = " UNION ALL ".join(f"SELECT product_id, factor_id, {h} AS h, x, CASE WHEN close > 0 AND lead(close, {h}) {W} > 0 THEN ln(lead(close, {h}) {W} / close) END AS y FROM long" for h in horizons)
    return with_(*_long_sql(nodes, source, tables), f"pairs AS ({pairs})", *spearman_sql("pairs", "product_id, factor_id, h", "s")) + (
        "SELECT product_id, factor_id, h, n, n // h AS n_eff, CASE WHEN n >= 30 AND (h <= 1 OR n // h >= 8) THEN round(rho, 4) END AS ic FROM s"
    )


def _ic(nodes: dict, horizons: tuple[int, ...]):  # noqa: ANN202
    return lambda s, d: ev.information(views.bars(s, d), nodes, list(horizons))


add("ic_flagship", _ic(_a3, (1,)), _ic_sql(_a3, (1,)))
add("ic_h1_h24", _ic(_all, (1, 24)), _ic_sql(_all, (1, 24)))
DECAY = (1, 2, 3, 4, 6, 12, 24, 48)
add("ic_decay", _ic(_all, DECAY), _ic_sql(_all, DECAY))
add("ic_all_factors", _ic(_all, (1,)), _ic_sql(_all, (1,)))
add("fwd_returns", lambda s, d: evaluate(views.bars(s, d), {"fwd": ("forward", 1)}).select("product_id", "bar_idx", F.round("fwd", 6).alias("fwd")), with_(views.bars_sql()) + "SELECT product_id, bar_idx, round(ln(lead(close) OVER (PARTITION BY product_id ORDER BY bar_idx) / close), 6) AS fwd FROM bars")
add(
    "turnover_lag1", lambda s, d: ev.self_correlation(views.bars(s, d), _all),
    with_(*_long_sql(_all), f"pairs AS (SELECT product_id, factor_id, x, lag(x) {W} AS y FROM long)", *spearman_sql("pairs", "product_id, factor_id", "s")) + "SELECT product_id, factor_id, n, round(rho, 4) AS rho FROM s",
)
add(
    "corr_matrix", lambda s, d: ev.correlation_matrix(evaluate(views.bars(s, d), _all), list(_all)),
    with_(*_long_sql(_all), "pairs AS (SELECT a.product_id, a.factor_id AS id_i, b.factor_id AS id_j, a.x, b.x AS y FROM long a JOIN long b ON a.product_id = b.product_id AND a.bar_idx = b.bar_idx AND a.factor_id < b.factor_id)", *spearman_sql("pairs", "product_id, id_i, id_j", "s"))
    + "SELECT product_id, id_i, id_j, n, CASE WHEN n >= 30 THEN round(rho, 4) END AS rho FROM s",
)


def _samples(s: SparkSession, d: str) -> DataFrame:
    return _ic(_all, (1,))(s, d).select("factor_id", "n", F.abs("ic").alias("abs_ic"))


_samples_sql = "ics AS (" + _ic_sql(_all, (1,)) + "), samples AS (SELECT factor_id, n, abs(ic) AS abs_ic FROM ics)"
add("kappa", lambda s, d: rounded(ev.kappa(_samples(s, d), ["factor_id"]), 6, "kappa"), with_(_samples_sql) + "SELECT factor_id, round(sqrt(avg(abs_ic * abs_ic * (n - 1))), 6) AS kappa, count(*) AS samples FROM samples WHERE n >= 2 AND abs_ic IS NOT NULL GROUP BY factor_id")
add(
    "percentile_band",
    lambda s, d: _samples(s, d).groupingSets([["factor_id"], []], "factor_id").agg(*(F.round(F.percentile("abs_ic", F.lit(q / 100)), 6).alias(f"p{q}") for q in (50, 95, 99)), F.count("abs_ic").alias("n")).withColumn("factor_id", F.coalesce("factor_id", F.lit("pooled"))),
    with_(_samples_sql) + "SELECT coalesce(factor_id, 'pooled') AS factor_id, " + ", ".join(f"round(quantile_cont(abs_ic, {q / 100}), 6) AS p{q}" for q in (50, 95, 99)) + ", count(abs_ic) AS n FROM samples GROUP BY GROUPING SETS ((factor_id), ())",
)


def newest_values(wide: DataFrame, names: list[str], n: int) -> DataFrame:
    """(product_id, factor_id, spark): each factor's last n values, oldest first, null where there is none.

    How many bars a product has is one small aggregation; only its last bars are exchanged.
    """
    tops = wide.groupBy("product_id").agg(F.max("bar_idx").alias("_top"))
    tail = _long(wide.join(tops, "product_id").filter(F.col("bar_idx") > F.col("_top") - n), names)
    at = F.array_sort(F.collect_list(F.struct("bar_idx", F.round("x", 6).alias("x"))))
    return tail.groupBy("product_id", "factor_id").agg(F.transform(at, lambda v: v["x"]).alias("spark"))


add(
    "spark_tail", lambda s, d: newest_values(evaluate(views.bars(s, d), _all), list(_all), 24).select("product_id", "factor_id", F.posexplode("spark").alias("k", "x")),
    with_(*_long_sql(_all), "t AS (SELECT *, row_number() OVER (PARTITION BY product_id, factor_id ORDER BY bar_idx DESC) AS k, count(*) OVER (PARTITION BY product_id, factor_id) AS n FROM long)")
    + "SELECT product_id, factor_id, CAST(least(n, 24) - k AS INTEGER) AS k, round(x, 6) AS x FROM t WHERE k <= 24",
)
add("factor_row_summary", lambda s, d: rounded(factor_long(s, d, _all).groupBy("product_id", "factor_id").agg(F.max_by("x", "bar_idx").alias("latest"), F.count("x").alias("n_obs")), 4, "latest"), with_(*_long_sql(_all)) + "SELECT product_id, factor_id, round(arg_max_null(x, bar_idx), 4) AS latest, count(x) AS n_obs FROM long GROUP BY ALL")

# The same on the lake's own bars, with their holes, NaN and corrections.
add("lake_bars", lambda s, d: views.lake_bars(s, d), with_(views.LAKE_BARS) + "SELECT product_id, bar_idx, ts, open, high, low, close, volume FROM lake_bars")
_dirty_ops = {n.removeprefix("op_"): node for n, node in OPERATORS.items()}
_SPREADS = ("correlation", "stddev")  # what cancels out of them takes digits along
add(
    "lake_operators", lambda s, d: evaluate(views.lake_bars(s, d), _dirty_ops).select("product_id", "bar_idx", *((F.round(n, 6) if n in _SPREADS else ev.canonical(F.col(n))).alias(n) for n in _dirty_ops)),
    with_(views.LAKE_BARS, *to_sql("lake_bars", _dirty_ops)[0]) + "SELECT product_id, bar_idx, " + ", ".join(f"{f'round({n}, 6)' if n in _SPREADS else canonical_sql(n)} AS {n}" for n in _dirty_ops) + f" FROM {to_sql('lake_bars', _dirty_ops)[1]}",
)
# Without SQL: where a volume is stuck, it is its own mean but for the last bit of a sum, which ranks (a043) tell apart.
add("lake_ic", lambda s, d: ev.information(views.lake_bars(s, d), _all, [1]))
