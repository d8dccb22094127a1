"""Queries of the search, of null calibration, and of the lake."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import search
from ..operators.hierarchy import hierarchies
from ..session import Scratch, table
from ..sources import lake, synthetic
from . import found, views
from .factor_queries import with_
from .factors import FACTORS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _search(s: SparkSession, d: str) -> DataFrame:
    """A search over a planted walk; its product is the driver's own, not a table."""
    bars = synthetic.walks(s, [9], 2400, sigma=0.01, phi=-0.12).drop("seed")
    found = search.run_search(bars, symbol="walk9", seed=9, kind="planted")
    rows = [(k, r["expr_id"], r["text"], r["family"], r["op"], r["verdict"], json.dumps(r.get("insample")), json.dumps(r.get("holdout"))) for k, r in enumerate(found["records"])]
    return s.createDataFrame(rows, "no int, expr_id string, text string, family string, op string, verdict string, insample string, holdout string")


add("search_run", _search)


_all = {k: f.node for k, f in FACTORS.items()}


def null_correlations(s: SparkSession, reseeds: int = 20, bars: int = 350, *, horizon: int = 1, seed0: int = 1000, sigma: float = 0.01) -> DataFrame:
    """(product_id, factor_id, n, abs_ic) of every factor on seeded random walks; a refused correlation is null."""
    walks = synthetic.walks(s, list(range(seed0, seed0 + reseeds)), bars, sigma=sigma)
    return ev.information(walks.drop("seed"), _all, [horizon]).select("product_id", "factor_id", "n", F.abs("ic").alias("abs_ic"))


def null_document(s: SparkSession, reseeds: int = 20, bars: int = 350, *, horizon: int = 1, seed0: int = 1000, timeframe: str = "1h") -> dict:
    """What search.calibrate() takes: percentiles per factor and pooled, and the samples; as many as walks times factors."""
    if reseeds < 1 or bars < 2 or horizon < 1:
        raise ValueError("a null document takes a walk of two bars and a horizon")
    rows = null_correlations(s, reseeds, bars, horizon=horizon, seed0=seed0).collect()
    r4 = lambda q, xs: round(float(np.percentile(xs, q)), 4) if xs else None
    each = []
    for k, f in FACTORS.items():
        xs, n = [r["abs_ic"] for r in rows if r["factor_id"] == k and r["abs_ic"] is not None], [r["n"] for r in rows if r["factor_id"] == k]
        each.append({"id": k, "num": f.number, "abs_ic_p50": r4(50, xs), "abs_ic_p95": r4(95, xs), "abs_ic_max": max(xs, default=None), "n": len(xs), "n_pairs_median": r4(50, n)})
    known = [(r["abs_ic"], r["n"]) for r in sorted(rows) if r["abs_ic"] is not None]
    pooled = {f"p{q}": r4(q, [ic for ic, _ in known]) for q in (50, 95, 99)} | {"n": len(known)}
    return {"n_reseeds": reseeds, "bars": bars, "horizon": horizon, "timeframe": timeframe, "alphas": each, "pooled": pooled, "samples": [list(x) for x in known]}


def _null_band(s: SparkSession, d: str) -> DataFrame:
    """Percentiles of absolute correlations on random walks, per factor and pooled."""
    ics = null_correlations(s, seed0=1007)
    each = [F.round(F.percentile("abs_ic", F.lit(q / 100)), 4).alias(f"p{q}") for q in (50, 95, 99)]
    band = ics.groupingSets([["factor_id"], []], "factor_id").agg(*each, F.round(F.max("abs_ic"), 4).alias("most"), F.count("abs_ic").alias("n"), F.round(F.percentile("n", F.lit(0.5)), 1).alias("n_pairs_median"))
    return band.withColumn("factor_id", F.coalesce("factor_id", F.lit("pooled")))


def _sp(n: int) -> int:
    """Where the holdout of n bars begins."""
    return n - int(n * 0.2)


def _fees(s: SparkSession, d: str) -> DataFrame:
    """What the reversal seed earns on the walks' holdout bars after costs."""
    from . import expr

    bars = views.walk(s, d)
    first = _sp(bars.groupBy("product_id").count().agg(F.min("count")).first()[0])
    return search.fee_after(bars, expr.parse("-1 * delta(close, 1)"), 1.0, first).select("product_id", F.col("cost_bps").cast("int").alias("cost_bps"), F.round("total_return", 5).alias("total_return"), "n_trades")


def _fee_sql(cost: int) -> str:
    """Long after a fall, flat after a rise, held where nothing moved; everything is traded at the next open."""
    k = cost / 1e4
    return f"""c{cost} AS (SELECT product_id, bar_idx, CAST(10000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS q, 0 AS trades, close FROM aims WHERE bar_idx = head
        UNION ALL SELECT product_id, bar_idx, cash - amount - abs(amount) * {k}, q + amount / open, CASE WHEN abs(amount / open) > 1e-12 THEN 1 ELSE 0 END, close
        FROM (SELECT n.product_id, n.bar_idx, n.open, n.close, c.cash, c.q, CASE WHEN n.aim IS NULL THEN 0.0 WHEN n.aim = 0 THEN -c.q * n.open ELSE least(c.cash + c.q * n.open - c.q * n.open, c.cash / (1 + {k})) END AS amount
              FROM c{cost} c JOIN aims n ON n.product_id = c.product_id AND n.bar_idx = c.bar_idx + 1))"""


add("fee_after", _fees, with_(
    "RECURSIVE " + views.WALK, "len AS (SELECT min(n) - CAST(floor(min(n) * 0.2) AS BIGINT) AS head FROM (SELECT count(*) AS n FROM walk GROUP BY product_id))",
    "sg AS (SELECT *, close - lag(close) OVER (PARTITION BY product_id ORDER BY bar_idx) AS dx FROM walk)",
    "aims AS (SELECT sg.*, head, lag(CASE WHEN dx < 0 THEN 1.0 WHEN dx >= 0 THEN 0.0 END) OVER (PARTITION BY product_id ORDER BY bar_idx) AS aim FROM sg, len)", *map(_fee_sql, search.COSTS))
    + " UNION ALL ".join(f"SELECT product_id, {c} AS cost_bps, round(arg_max(cash + q * close, bar_idx) / arg_min(cash + q * close, bar_idx) - 1, 5) AS total_return, CAST(sum(trades) AS BIGINT) AS n_trades FROM c{c} GROUP BY 1" for c in search.COSTS))
add("null_band", _null_band)
_TRIALS = (1, 5, 50, 500)


def _thresholds(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(n, t, round(ev.deflated_threshold(n, t), 4)) for n in (759, 1870) for t in _TRIALS], "n int, trials int, threshold double")


#: The standard normal's quantile at (1 + 0.95 ** (1 / N)) / 2 for N = 1, 5, 50, 500.
_Z = (1.959963985, 2.568763168, 3.283479816, 3.884403733)
add("deflated_threshold", _thresholds, "SELECT CAST(n AS INTEGER) AS n, CAST(t AS INTEGER) AS trials, round(z / sqrt(n - 1), 4) AS threshold FROM (VALUES " + ", ".join(f"({t}, CAST({z} AS DOUBLE))" for t, z in zip(_TRIALS, _Z)) + ") AS a(t, z), (VALUES (759), (1870)) AS b(n)")
add("holdout_split", lambda s, d: s.createDataFrame([(n, b, a, z) for n in (2400, 1004) for b, (a, z) in enumerate(search.split(n).blocks)], "n int, block int, first int, last int"),
    """WITH s AS (SELECT n, n - CAST(floor(n * 0.2) AS BIGINT) - 48 AS e FROM (VALUES (2400), (1004)) AS t(n))
       SELECT CAST(n AS INTEGER) AS n, CAST(b AS INTEGER) AS block, CAST(round_even(e * b / 3.0, 0) AS INTEGER) AS first, CAST(round_even(e * (b + 1) / 3.0, 0) - 1 AS INTEGER) AS last FROM s, range(3) AS r(b)""")  # fmt: skip
add("trial_counts", lambda s, d: table(s, d, "archive_records").dropDuplicates(["line_no"]).groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("expr_id").alias("expressions"), F.count_if(F.col("insample").isNotNull()).alias("scored")),
    "SELECT verdict, count(*) AS n, count(DISTINCT expr_id) AS expressions, count(insample) AS scored FROM (SELECT DISTINCT ON (line_no) * FROM archive_records) GROUP BY 1")


def _best(s: SparkSession, d: str) -> DataFrame:
    """The best scored expression of each product up to each generation; the first of equals stays."""
    from pyspark.sql import Window

    rows = table(s, d, "archive_records").filter("insample.abs_ic IS NOT NULL AND NOT isnan(insample.abs_ic) AND product_id IS NOT NULL AND generation IS NOT NULL")
    each = rows.groupBy("product_id", "generation").agg(F.max("insample.abs_ic").alias("top"))
    return each.select("product_id", "generation", F.max("top").over(Window.partitionBy("product_id").orderBy("generation")).alias("best"))


add("best_so_far", _best, "SELECT product_id, generation, max(top) OVER (PARTITION BY product_id ORDER BY generation) AS best FROM (SELECT product_id, generation, max(insample.abs_ic) AS top FROM archive_records WHERE NOT isnan(insample.abs_ic) AND product_id IS NOT NULL AND generation IS NOT NULL GROUP BY ALL)")
add("survivors", lambda s, d: table(s, d, "archive_records").filter("verdict = 'candidate' AND cleared_null").select("expr_id").distinct(), "SELECT DISTINCT expr_id FROM archive_records WHERE verdict = 'candidate' AND cleared_null")
add("unseen_parents", lambda s, d: _parents(s, d), "SELECT DISTINCT p AS expr_id FROM (SELECT unnest(parents) AS p FROM archive_records) WHERE p IS NOT NULL AND p NOT IN (SELECT expr_id FROM archive_records)")


def _parents(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "archive_records")
    return rows.select(F.explode("parents").alias("expr_id")).dropna().distinct().join(rows.select("expr_id"), "expr_id", "left_anti")


def _lake(s: SparkSession, d: str) -> DataFrame:
    """The events written to a lake as minute candles by two venues, the second overwriting the rising ones, and read back as hourly bars."""
    root = Scratch(s, "lake").root
    minutes = views.ticks_to_minutes(views.ticks(s, d))
    lake.write(minutes, root, "a", "candles_1m")
    lake.write(minutes.filter("close > open").withColumn("volume", F.col("volume") + 1), root, "b", "candles_1m")
    return lake.candles(s, root, granularity="1h", start="2024-01-05", end="2024-01-20")


_LAKE = views.bars_sql().replace("FROM bars_1m GROUP BY ALL", "FROM (SELECT * REPLACE (volume + CASE WHEN close > open THEN 1 ELSE 0 END AS volume) FROM bars_1m WHERE make_timestamp(m * 60000000) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') GROUP BY ALL")
add("dedupe_last_wins", _lake, with_(_LAKE) + "SELECT product_id, ts, open, high, low, close, volume FROM bars")
add("lineage_depths", lambda s, d: _lineage(s, d), f"WITH q AS ({found.SQL['p4_found']}) SELECT depth, count(*) AS n FROM q GROUP BY 1")


def _lineage(s: SparkSession, d: str) -> DataFrame:
    first = table(s, d, "archive_records").groupBy("expr_id").agg(F.min_by(F.get("parents", F.lit(0)), "line_no").alias("parent"))
    return hierarchies(s, first, "expr_id", "parent").groupBy("depth").agg(F.count("*").alias("n"))
