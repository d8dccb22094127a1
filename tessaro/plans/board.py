"""The research board: every factor of every product with what there is to know of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import volatility
from ..operators import evaluation as ev
from ..operators import microstructure
from ..session import Scratch
from . import views
from .compiler import evaluate
from .factor_queries import _long, _long_sql, newest_values, spearman_sql, with_
from .factors import FACTORS
from .stretches import along, in_stretches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HORIZONS, DECAY, TAIL = (1, 24), (1, 2, 3, 4, 6, 12, 24, 48), 24


def wide_frame(bars: DataFrame, nodes: dict) -> tuple[DataFrame, list[str]]:
    """The bars with composed factors, momentum and volatility, each also as it was a bar earlier, and the forward returns; with the factors' names."""
    ahead = {f"_y{h}": ("forward", h) for h in sorted({*HORIZONS, *DECAY})}
    wide = evaluate(bars, nodes | {f"_was_{n}": ("delay", node, 1) for n, node in nodes.items()} | ahead)
    own = {}
    for h in (6, 24, 72):
        wide = volatility.momentum_z(wide, h).withColumnRenamed("z", f"mom_z_{h}").drop("return_pct", "pct", "samples", "label")
        own[f"mom_z_{h}"] = None
    wide = volatility.volatility_state(wide).withColumnsRenamed({"pct": "vol_pct", "z": "vol_z"}).drop("vol", "median", "vol_of_vol", "samples", "regime")
    own |= {"vol_pct": None, "vol_z": None}
    wide = in_stretches(wide, 1, lambda df: df.withColumns({f"_was_{n}": F.lag(n).over(along()) for n in own}))
    return wide, [*nodes, *own]


def rows(wide: DataFrame, names: list[str]) -> DataFrame:
    """One row per product and factor: latest value, observations, turnover, correlations by horizon, decay, tail.

    A factor without a value keeps its row, with ok false. The frame is read several times: keep it before.
    """
    by = ["product_id", "factor_id"]
    ahead = {f"_y{h}": ("forward", h) for h in sorted({*HORIZONS, *DECAY})}
    base = _long(wide, names).groupBy(*by).agg(F.round(F.max_by("x", "bar_idx"), 4).alias("value"), F.count("x").alias("n_obs")).withColumn("ok", F.col("n_obs") > 0)
    turnover = ev.self_correlation_of(wide, names).select(*by, F.col("rho").alias("turnover_proxy"))
    every = ev.information_of(wide, names, ahead)
    entry = F.struct("h", "ic", "n", F.when(F.col("h") > 1, F.col("n_eff")).alias("n_eff"), (F.col("h") > 1).alias("overlap"))
    pick = lambda hs: F.array_sort(F.collect_list(F.when(F.col("h").isin(*hs), entry)))
    ic = every.groupBy(*by).agg(pick(HORIZONS).alias("ic"), pick(DECAY).alias("decay"))
    return base.join(turnover, by, "left").join(ic, by, "left").join(newest_values(wide, names, TAIL), by, "left")


def trend_rows(daily: DataFrame, ppy: float = 365.0) -> DataFrame:
    """(product_id, factor_id, value, n_obs, ok, spark) of the five daily trend factors."""
    t = volatility.trend(daily, ppy).withColumnsRenamed({"score": "tsmom_score", "s22": "tsmom_s22", "s65": "tsmom_s65", "s261": "tsmom_s261", "sigma": "sigma_ann"})
    names = ["tsmom_score", "tsmom_s22", "tsmom_s65", "tsmom_s261", "sigma_ann"]
    base = _long(t, names).groupBy("product_id", "factor_id").agg(F.round(F.max_by("x", "bar_idx"), 4).alias("value"), F.count("x").alias("n_obs"))
    return base.withColumn("ok", F.col("n_obs") > 0).join(newest_values(t, names, TAIL), ["product_id", "factor_id"], "left")


def board(spark: SparkSession, d: str) -> DataFrame:
    """The whole board: hourly factors with their evaluation, daily trend rows, the funding row, and the books' section joined to each product."""
    wide, names = wide_frame(views.bars(spark, d), {k: f.node for k, f in FACTORS.items()})
    wide = Scratch(spark, "board").keep(wide, "wide")
    section = microstructure.section(views.book(spark, d), views.ticks(spark, d))
    section = section.select("product_id", F.struct(*(F.col(c) for c in section.columns if c != "product_id")).alias("microstructure"))
    rates = views.ticks(spark, d).select("product_id", "ts", "seq", (F.col("price") / 1e5).alias("rate"))
    funding = volatility.funding_summary(rates, ["product_id"], ["ts", "seq"])
    funding = funding.select("product_id", F.lit("funding_z").alias("factor_id"), F.round("z", 4).alias("value"), F.col("samples").alias("n_obs"), F.col("z").isNotNull().alias("ok"))
    hourly = rows(wide, names).withColumn("timeframe", F.lit("1h"))
    daily = trend_rows(views.bars(spark, d, "1d")).withColumn("timeframe", F.lit("1d"))
    every = hourly.unionByName(daily, allowMissingColumns=True).unionByName(funding.withColumn("timeframe", F.lit("8h")), allowMissingColumns=True)
    return every.join(section, "product_id", "left")


QUERIES["board"] = board


def _correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlations between all hourly series of the board."""
    wide, names = wide_frame(views.bars(spark, d), {k: f.node for k, f in FACTORS.items()})
    return ev.correlation_matrix(wide, names)


def _hourly_sql() -> str:
    """All hourly series of the board, one row per product, bar and factor."""
    nodes = {k: f.node for k, f in FACTORS.items()}
    p = "PARTITION BY product_id ORDER BY bar_idx"
    hist, v24 = f"OVER ({p} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)", f"OVER ({p} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    score = lambda x: f"CASE WHEN count({x}) {hist} >= 2 THEN round(({x} - avg({x}) {hist}) / nullif(stddev_samp({x}) {hist}, 0), 3) END"
    near = "abs(v - vol) <= 1e-9 * greatest(abs(vol), list_max(list_transform(seen, lambda u: abs(u))), 1e-12)"
    tables = [
        *_long_sql(nodes), f"rr AS (SELECT *, ln(close / lag(close) OVER ({p})) AS lr, " + ", ".join(f"close / lag(close, {h}) OVER ({p}) - 1 AS r{h}" for h in (6, 24, 72)) + " FROM bars)",
        f"vv AS (SELECT *, CASE WHEN count(lr) {v24} = 24 THEN stddev_samp(lr) {v24} END AS vol FROM rr)",
        f"ss AS (SELECT *, coalesce(list_filter(list(vol) {hist}, lambda u: u IS NOT NULL), []) AS seen, {score('vol')} AS vol_z, " + ", ".join(f"{score(f'r{h}')} AS mom_z_{h}" for h in (6, 24, 72)) + " FROM vv)",
        f"zz AS (SELECT *, CASE WHEN vol IS NULL THEN NULL WHEN len(seen) = 0 THEN 0.5 ELSE round((len(list_filter(seen, lambda v: v < vol AND NOT ({near}))) + 0.5 * len(list_filter(seen, lambda v: {near}))) / len(seen), 3) END AS vol_pct FROM ss)",
        "every AS (SELECT product_id, bar_idx, factor_id, x FROM long UNION ALL " + " UNION ALL ".join(f"SELECT product_id, bar_idx, '{n}', {n} FROM zz" for n in ("mom_z_6", "mom_z_24", "mom_z_72", "vol_pct", "vol_z")) + ")",
    ]
    pairs = "pairs AS (SELECT a.product_id, a.factor_id AS id_i, b.factor_id AS id_j, a.x, b.x AS y FROM every a JOIN every b ON a.product_id = b.product_id AND a.bar_idx = b.bar_idx AND a.factor_id < b.factor_id)"
    return with_(*tables, pairs, *spearman_sql("pairs", "product_id, id_i, id_j", "s")) + "SELECT product_id, id_i, id_j, n, CASE WHEN n >= 30 THEN round(rho, 4) END AS rho FROM s"


QUERIES["board_correlations"] = _correlations
SQL["board_correlations"] = _hourly_sql()


def _flat(spark: SparkSession, d: str) -> DataFrame:
    nodes = {k: f.node for k, f in FACTORS.items()}
    ahead = {f"_y{h}": ("forward", h) for h in sorted({*HORIZONS, *DECAY})}
    wide = evaluate(views.bars(spark, d), nodes | {f"_was_{n}": ("delay", node, 1) for n, node in nodes.items()} | ahead)
    got = rows(Scratch(spark, "board").keep(wide, "wide"), list(nodes))
    at = lambda h, f: F.get(F.filter("ic", lambda e: e["h"] == h), F.lit(0))[f]
    return got.select("product_id", "factor_id", "value", "n_obs", "turnover_proxy", at(1, "ic").alias("ic_1"), at(1, "n").alias("n_1"), at(24, "ic").alias("ic_24"), at(24, "n").alias("n_24"))


_W = "OVER (PARTITION BY product_id, factor_id ORDER BY bar_idx)"
QUERIES["board_rows"] = _flat
SQL["board_rows"] = with_(
    *_long_sql({k: f.node for k, f in FACTORS.items()}), f"lagged AS (SELECT product_id, factor_id, x, lag(x) {_W} AS y FROM long)", *spearman_sql("lagged", "product_id, factor_id", "t"),
    *(x for h in HORIZONS for x in (f"f{h} AS (SELECT product_id, factor_id, x, CASE WHEN close > 0 THEN ln(lead(close, {h}) {_W} / close) END AS y FROM long)", *spearman_sql(f"f{h}", "product_id, factor_id", f"s{h}"))),
    "base AS (SELECT product_id, factor_id, round(arg_max_null(x, bar_idx), 4) AS value, count(x) AS n_obs FROM long GROUP BY ALL)",
) + (
    "SELECT product_id, factor_id, value, n_obs, round(t.rho, 4) AS turnover_proxy, CASE WHEN s1.n >= 30 THEN round(s1.rho, 4) END AS ic_1, s1.n AS n_1, CASE WHEN s24.n >= 30 AND s24.n // 24 >= 8 THEN round(s24.rho, 4) END AS ic_24, s24.n AS n_24 "
    "FROM base LEFT JOIN t USING (product_id, factor_id) LEFT JOIN s1 USING (product_id, factor_id) LEFT JOIN s24 USING (product_id, factor_id)"
)
