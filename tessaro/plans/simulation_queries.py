"""Queries of simulators, metrics, tickets and replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import volatility
from ..operators import policy, simulate, tickets
from . import views
from .factor_queries import with_
from .measure_queries import _TREND, trend_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


COSTS = (0, 10, 20, 40, 60, 120)


def _weights(s: SparkSession, d: str) -> DataFrame:
    t = volatility.trend(views.walk(s, d))
    weight = volatility.target_weight(F.col("score"), F.col("sigma"), 1.0)
    prices = views.walk(s, d).select("product_id", "bar_idx", "open", "close")
    return prices.join(t.select("product_id", "bar_idx", weight.alias("weight")), ["product_id", "bar_idx"])


def _runs(rows: DataFrame, costs: tuple[float, ...], joint: bool = False) -> DataFrame:
    """One run per product and cost, or one over all products."""
    rows = rows.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in costs))))
    name = F.concat_ws("@", F.lit("all") if joint else F.col("product_id"), F.col("cost_bps").cast("int").cast("string"))
    return rows.withColumns({"run_id": name, "symbol_ord": F.col("product_id")})


def _curve(s: SparkSession, d: str) -> DataFrame:
    return simulate.weight_engine(_runs(_weights(s, d), (15.0,)), every=1)


def _flat(curve: DataFrame) -> DataFrame:
    return curve.select("run_id", "bar_idx", *(F.round(c, 4).alias(c) for c in ("equity", "cash", "turnover")), "trades")


_RISING = with_("RECURSIVE " + _TREND[len("WITH "):].strip())
_AIMS = "g AS (SELECT walk.product_id, walk.bar_idx, walk.open, walk.close, CASE WHEN sigma > 0 THEN greatest(0, least(1, score / sigma)) END AS w FROM walk JOIN trend USING (product_id, bar_idx))"


def single_sql(name: str, source: str, cost: float, band: float = 0.1) -> list[str]:
    """The weight engine along each product's own bars: a row of cash and holding per bar, from the one before."""
    return [
        f"{name}_f AS (SELECT *, lag(w) OVER (PARTITION BY product_id ORDER BY bar_idx) AS aim FROM {source})",
        f"""{name} AS (SELECT product_id, CAST(0 AS INTEGER) AS bar_idx, CAST(10000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS amount, open, close FROM {name}_f WHERE bar_idx = 0
            UNION ALL SELECT product_id, bar_idx, cash - amount - abs(amount) * {cost}, q + amount / open, amount, open, close
            FROM (SELECT f.product_id, f.bar_idx, f.open, f.close, e.cash, e.q,
                         CASE WHEN aim IS NULL OR abs(aim - e.q * f.open / (e.cash + e.q * f.open)) < {band} THEN 0.0
                              ELSE greatest(-e.q * f.open, least(aim * (e.cash + e.q * f.open) - e.q * f.open, e.cash / (1 + {cost}))) END AS amount
                  FROM {name} e JOIN {name}_f f ON f.product_id = e.product_id AND f.bar_idx = e.bar_idx + 1))""",
    ]


add("weight_engine_single", lambda s, d: _flat(_curve(s, d)), _RISING + ", " + ", ".join([_AIMS, *single_sql("e", "g", 0.0015)])
    + " SELECT product_id || '@15' AS run_id, bar_idx, round(cash + q * close, 4) AS equity, round(cash, 4) AS cash, round(abs(amount), 4) AS turnover, CAST(CASE WHEN amount <> 0 THEN 1 ELSE 0 END AS INTEGER) AS trades FROM e")


def together_sql(source: str, key: str, n: int, begin: str, orders: str, amount: str, every: int = 1, dust: float = 0.0) -> str:
    """Tables up to r, a portfolio of n products per run and bar, whose orders of a bar fill one after the other.

    begin: what is held at first; orders: the list of {{i}} to be filled, seeing q, o, eq, cash and
    prev (what was said a bar ago); amount: how much of its product an order `od` is for, before cash
    limits it.
    """
    at = "[" + ", ".join(map(str, range(1, n + 1))) + "]"
    steps = f"(SELECT x.*, {orders} AS ods, CAST(0 AS DOUBLE) AS moved, 0 AS done FROM x)"
    for j in range(1, n + 1):
        capped = f"CASE WHEN od IS NULL THEN 0.0 WHEN raw > 0 THEN least(raw, greatest(0, cash) / (o[od.i] * 1.0015)) ELSE greatest(raw, -q[od.i]) END"
        steps = f"""(SELECT * EXCLUDE (cash, q, moved, done, od, raw, dq), CASE WHEN abs(dq) > {dust} THEN cash - (dq + abs(dq) * 0.0015) * o[od.i] ELSE cash END AS cash, [CASE WHEN i = od.i AND abs(dq) > {dust} THEN q[i] + dq ELSE q[i] END FOR i IN {at}] AS q,
            moved + CASE WHEN abs(dq) > {dust} THEN abs(dq) * o[od.i] ELSE 0 END AS moved, done + CASE WHEN abs(dq) > {dust} THEN 1 ELSE 0 END AS done
            FROM (SELECT *, {capped} AS dq FROM (SELECT *, {amount} AS raw FROM (SELECT *, ods[{j}] AS od FROM {steps}))))"""
    return f"""whole AS (SELECT {key} AS run, bar_idx FROM {source} GROUP BY ALL HAVING count(*) = {n}),
    b AS (SELECT {key} AS run, bar_idx, row_number() OVER (PARTITION BY {key} ORDER BY bar_idx) - 1 AS k, list(open ORDER BY product_id) AS o, list(close ORDER BY product_id) AS c, list(w ORDER BY product_id) AS w
          FROM {source} s SEMI JOIN whole ON whole.run = {key} AND whole.bar_idx = s.bar_idx GROUP BY {key}, bar_idx),
    bb AS (SELECT *, CASE WHEN (k - 1) % {every} = 0 THEN lag(w) OVER (PARTITION BY run ORDER BY k) END AS prev FROM b),
    r AS (SELECT run, bar_idx, k, {begin}, CAST(0 AS DOUBLE) AS moved, 0 AS done, c FROM bb WHERE k = 0
          UNION ALL SELECT run, bar_idx, k, cash, q, moved, done, c FROM (WITH x AS (
              SELECT bb.run, bb.bar_idx, bb.k, bb.o, bb.c, bb.prev, r.cash, r.q, r.cash + list_sum([r.q[i] * bb.o[i] FOR i IN {at}]) AS eq FROM r JOIN bb ON bb.run = r.run AND bb.k = r.k + 1)
              SELECT * FROM {steps}))"""


def _together_out(n: int) -> str:
    at = "[" + ", ".join(map(str, range(1, n + 1))) + "]"
    return f" SELECT run || '@15' AS run_id, bar_idx, round(cash + list_sum([q[i] * c[i] FOR i IN {at}]), 4) AS equity, round(cash, 4) AS cash, round(moved, 4) AS turnover, CAST(done AS INTEGER) AS trades FROM r"


_LOWER = "g3 AS (SELECT g.product_id, g.bar_idx, g.open, g.close, w / greatest(1, sum(w) OVER (PARTITION BY bar_idx)) AS w FROM g WHERE bar_idx IN (SELECT bar_idx FROM g GROUP BY 1 HAVING count(*) = 3))"
_BY_SIZE = "list_sort(list_filter([{'d': prev[i] - q[i] * o[i] / eq, 'i': i} FOR i IN [1, 2, 3]], lambda x: abs(x.d) >= 0.1))"
add("weight_engine_multi", lambda s, d: _flat(simulate.weight_engine(_runs(simulate.aligned(_weights(s, d).withColumn("run", F.lit("all")), ["run"]), (15.0,), joint=True), every=1)),
    _RISING + ", " + ", ".join([_AIMS, _LOWER, together_sql("g3", "'all'", 3, "CAST(10000 AS DOUBLE) AS cash, CAST([0, 0, 0] AS DOUBLE[]) AS q", _BY_SIZE, "od.d * eq / o[od.i]", dust=1e-12)]) + _together_out(3))


def _actions(s: SparkSession, d: str) -> DataFrame:
    prices = views.walk(s, d).select("product_id", "bar_idx", "open", "close")
    said = trend_rows(s, d).select("product_id", "bar_idx", policy.action(F.col("regime"), F.col("confidence")).alias("action"))
    return prices.join(said, ["product_id", "bar_idx"])


_SAID = f"g AS (SELECT walk.product_id, walk.bar_idx, walk.open, walk.close, {policy.action_sql('regime', 'confidence')} AS w FROM walk JOIN trend USING (product_id, bar_idx))"
_AMOUNT = """CASE prev[od.i] WHEN 'target_weight_100' THEN 0.1 * eq / o[od.i] - q[od.i] WHEN 'target_weight_60' THEN 0.06 * eq / o[od.i] - q[od.i] WHEN 'target_weight_30' THEN 0.03 * eq / o[od.i] - q[od.i]
    WHEN 'target_weight_20' THEN 0.02 * eq / o[od.i] - q[od.i] WHEN 'flat_position' THEN -q[od.i] WHEN 'halve_position' THEN -0.5 * q[od.i]
    WHEN 'reduce_25_percent' THEN -0.25 * q[od.i] WHEN 'reduce_10_percent' THEN -0.1 * q[od.i] WHEN 'reaccumulate_small' THEN 0.05 * eq * od.share / o[od.i] ELSE 0.0 END"""


def _acted_sql(key: str, n: int, every: int) -> str:
    at = "[" + ", ".join(map(str, range(1, n + 1))) + "]"
    share = "CASE WHEN list_contains(prev, 'reaccumulate_small') THEN least(1, cash / (0.05 * eq * len(list_filter(prev, lambda a: a = 'reaccumulate_small')))) ELSE 1.0 END"
    begin = f"CAST(0 AS DOUBLE) AS cash, [10000.0 / {n} / o[i] FOR i IN {at}] AS q"
    return together_sql("g", key, n, begin, f"CASE WHEN prev IS NULL THEN [] ELSE [{{'i': i, 'share': {share}}} FOR i IN {at}] END", _AMOUNT, every) + _together_out(n)


add("discrete_engine_single", lambda s, d: _flat(simulate.action_engine(_runs(_actions(s, d), (15.0,)))), _RISING + f", {_SAID}, " + _acted_sql("product_id", 1, 1))
add("discrete_engine_multi", lambda s, d: _flat(simulate.action_engine(_runs(simulate.aligned(_actions(s, d).withColumn("run", F.lit("all")), ["run"]), (15.0,), joint=True), every=7)), _RISING + f", {_SAID}, " + _acted_sql("'all'", 3, 7))

# A curve that SQL can state: the price paths themselves, bought once.
_hold = lambda s, d: views.walk(s, d).select(F.col("product_id").alias("run_id"), "bar_idx", (F.lit(10_000 / 1.0015) / F.first_value("open").over(_w())) .alias("q"), "close")


def _w():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("product_id").orderBy("bar_idx")


def _hold_curve(s: SparkSession, d: str) -> DataFrame:
    rows = _hold(s, d)
    equity = F.col("q") * F.col("close")
    return rows.select("run_id", "bar_idx", equity.alias("equity"), F.when(F.col("bar_idx") == 0, 10_000 / 1.0015).otherwise(0.0).alias("turnover"), F.when(F.col("bar_idx") == 0, 1).otherwise(0).alias("trades"))


_HOLD = with_(views.WALK, "c AS (SELECT product_id AS run_id, bar_idx, 10000 / 1.0015 / first_value(open) OVER (PARTITION BY product_id ORDER BY bar_idx) * close AS equity, CASE WHEN bar_idx = 0 THEN 10000 / 1.0015 ELSE 0 END AS turnover, CASE WHEN bar_idx = 0 THEN 1 ELSE 0 END AS trades FROM walk)")
add("buy_hold_curve", lambda s, d: _hold_curve(s, d).select("run_id", "bar_idx", F.round("equity", 5).alias("equity")), _HOLD + "SELECT run_id, bar_idx, round(equity, 5) AS equity FROM c")
_FIGURES = ("total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "turnover", "calmar")
_METRICS = ", r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY bar_idx) - 1 AS r, max(equity) OVER (PARTITION BY run_id ORDER BY bar_idx) AS peak FROM c), m AS (SELECT run_id, count(*) AS n_bars, arg_max(equity, bar_idx) / arg_min(equity, bar_idx) - 1 AS total_return, pow(arg_max(equity, bar_idx) / arg_min(equity, bar_idx), 365.0 / (count(*) - 1)) - 1 AS cagr, stddev_samp(r) * sqrt(365) AS ann_vol, avg(r) / stddev_samp(r) * sqrt(365) AS sharpe, avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(365) AS sortino, least(0, min(equity / peak - 1)) AS max_drawdown, sum(trades) AS n_trades, sum(turnover) / avg(equity) AS turnover FROM r GROUP BY 1) "
add("metrics", lambda s, d: simulate.metrics(_hold_curve(s, d)).select("run_id", "n_bars", "n_trades", *(F.round(c, 6).alias(c) for c in _FIGURES)), _HOLD + _METRICS + "SELECT run_id, n_bars, CAST(n_trades AS BIGINT) AS n_trades, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIGURES[:-1]) + ", round(cagr / abs(max_drawdown), 6) AS calmar FROM m")
add("max_drawdown", lambda s, d: simulate.metrics(_hold_curve(s, d)).select("run_id", F.round("max_drawdown", 6).alias("max_drawdown")), _HOLD + _METRICS + "SELECT run_id, round(max_drawdown, 6) AS max_drawdown FROM m")
_GRID_OF = ", ".join(x for c in COSTS for x in single_sql(f"e{c}", "g", c / 1e4))
_GRID_ALL = " UNION ALL ".join(f"SELECT product_id || '@{c}' AS run_id, bar_idx, cash + q * close AS equity, CASE WHEN amount <> 0 THEN 1 ELSE 0 END AS trades FROM e{c}" for c in COSTS)
add("cost_grid", lambda s, d: simulate.metrics(simulate.weight_engine(_runs(_weights(s, d), COSTS), every=1)).select("run_id", "n_trades", *(F.round(c, 5).alias(c) for c in ("total_return", "sharpe", "max_drawdown"))),
    _RISING + f", {_AIMS}, {_GRID_OF}, c AS ({_GRID_ALL})" + ", r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY bar_idx) - 1 AS r, max(equity) OVER (PARTITION BY run_id ORDER BY bar_idx) AS peak FROM c)"
    " SELECT run_id, CAST(sum(trades) AS BIGINT) AS n_trades, round(arg_max(equity, bar_idx) / arg_min(equity, bar_idx) - 1, 5) AS total_return, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 0), 5) AS sharpe, round(least(0, min(equity / peak - 1)), 5) AS max_drawdown FROM r GROUP BY 1")  # fmt: skip


def _decided(s: SparkSession, d: str) -> DataFrame:
    bars = views.walk(s, d)
    seen = tickets.views(bars)
    return tickets.decisions(bars, seen, tickets.curve(bars, seen))


# The policy's targets; a halved one is taken from the target before, which is a list that each bar adds to.
_TARGETS = {"target_weight_100": 1.0, "target_weight_60": 0.6, "target_weight_30": 0.3, "target_weight_20": 0.2, "flat_position": 0.0}
_CASE = "CASE action " + " ".join(f"WHEN '{a}' THEN CAST({t} AS DOUBLE)" for a, t in _TARGETS.items()) + " ELSE CAST(NULL AS DOUBLE) END"
_DECIDED = [
    f"ac AS (SELECT walk.product_id, walk.bar_idx, walk.ts, walk.open, walk.close, regime, confidence, score, score IS NOT NULL AS ok, CASE WHEN score IS NOT NULL THEN {policy.action_sql('regime', 'confidence')} END AS action FROM walk JOIN trend USING (product_id, bar_idx))",
    f"""tg AS (SELECT product_id, bar_idx, {_CASE} AS w, {_CASE} AS last FROM ac WHERE bar_idx = 0
        UNION ALL SELECT product_id, bar_idx, w, coalesce(w, last) FROM (SELECT ac.product_id, ac.bar_idx, last, CASE WHEN action = 'halve_position' THEN 0.5 * coalesce(last, 0) ELSE {_CASE} END AS w FROM tg JOIN ac ON ac.product_id = tg.product_id AND ac.bar_idx = tg.bar_idx + 1))""",
    "aimed AS (SELECT ac.*, w FROM ac JOIN tg USING (product_id, bar_idx))", *single_sql("en", "aimed", 0.0015),
    "hd AS (SELECT product_id, bar_idx, q * close / (cash + q * close) AS held, amount, open AS px FROM en)",
    f"""dc AS (SELECT aimed.*, hd.held AS before, n.held AS after, n.amount AS amt, n.px AS fill, lead(ts) OVER (PARTITION BY product_id ORDER BY bar_idx) AS next_ts FROM aimed JOIN hd USING (product_id, bar_idx)
        JOIN hd n ON n.product_id = aimed.product_id AND n.bar_idx = aimed.bar_idx + 1)""",
    "dd AS (SELECT *, amt <> 0 AS filled, amt > 0 AND before <= 1e-9 AS opens, amt < 0 AND after <= 1e-9 AS ends FROM dc WHERE ok)",
]
add("ticket_decisions", lambda s, d: _decided(s, d).select("product_id", "bar_idx", "action", F.round("target", 6).alias("target"), F.round("position_weight", 6).alias("position_weight"), F.round("weight_after", 6).alias("weight_after"), F.round("fill_px", 6).alias("fill_px"), F.round("delta_qty", 6).alias("delta_qty"), F.round("fee", 6).alias("fee"), "side"),
    _RISING + ", " + ", ".join(_DECIDED) + """ SELECT product_id, bar_idx, action, round(w, 6) AS target, round(before, 6) AS position_weight, round(after, 6) AS weight_after, CASE WHEN filled THEN round(fill, 6) END AS fill_px,
        CASE WHEN filled THEN round(amt / fill, 6) END AS delta_qty, CASE WHEN filled THEN round(abs(amt) * 0.0015, 6) END AS fee, CASE WHEN amt > 0 THEN 'buy' WHEN amt < 0 THEN 'sell' END AS side FROM dd""")  # fmt: skip
_TICKET = ("product_id", "ticket_id", "ticket_no", "side", "open_ts", "close_ts", "n_decisions")
_MONEY = ("entry", "exit", "size", "pnl", "fees", "peak_weight", "return_on_cost")
add("tickets", lambda s, d: tickets.tickets(_decided(s, d)).select(*_TICKET, *_MONEY),
    _RISING + ", " + ", ".join(_DECIDED) + """, nb AS (SELECT *, sum(CASE WHEN opens OR coalesce(p_ends, true) THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY bar_idx) AS no FROM (SELECT *, lag(ends) OVER (PARTITION BY product_id ORDER BY bar_idx) AS p_ends FROM dd)),
        tk AS (SELECT product_id, no, arg_min(opens, bar_idx) AS long, arg_max(ends, bar_idx) AS shut, count(*) AS n, arg_min(next_ts, bar_idx) AS f_ts, arg_max(next_ts, bar_idx) AS l_ts, arg_min(ts, bar_idx) AS d_ts, arg_min(fill, bar_idx) AS f_px, arg_max(fill, bar_idx) AS l_px,
               arg_min(close, bar_idx) AS d_px, arg_min(after, bar_idx) AS sz, max(after) AS peak, sum(-amt - abs(amt) * 0.0015) AS cash, sum(abs(amt) * 0.0015) AS fees, sum(greatest(amt, 0)) AS bought FROM nb GROUP BY ALL)
        SELECT product_id, product_id || '-T' || lpad(CAST(no AS VARCHAR), 3, '0') AS ticket_id, CAST(no AS BIGINT) AS ticket_no, CASE WHEN long THEN 'long' ELSE 'flat' END AS side, CASE WHEN long THEN f_ts ELSE d_ts END AS open_ts,
               CASE WHEN long AND shut THEN l_ts WHEN NOT long THEN lead(CASE WHEN long THEN f_ts END) OVER (PARTITION BY product_id ORDER BY no) END AS close_ts, n AS n_decisions, round(CASE WHEN long THEN f_px ELSE d_px END, 6) AS entry,
               CASE WHEN long AND shut THEN round(l_px, 6) END AS exit, CASE WHEN long THEN round(sz, 6) ELSE 0.0 END AS size, CASE WHEN long AND shut THEN round(cash, 6) END AS pnl, CASE WHEN long THEN round(fees, 6) ELSE 0.0 END AS fees,
               CASE WHEN long THEN round(peak, 6) END AS peak_weight, CASE WHEN long AND shut THEN round(cash / bought, 6) END AS return_on_cost FROM tk""")  # fmt: skip
_COSTED = ", ".join(x for c in COSTS for x in single_sql(f"k{c}", "aimed", c / 1e4))
_COSTED_ALL = " UNION ALL ".join(f"SELECT product_id, CAST({c} AS DOUBLE) AS cost_bps, bar_idx, cash + q * close AS equity, CASE WHEN amount <> 0 THEN 1 ELSE 0 END AS trades FROM k{c}" for c in COSTS)


def _costed(s: SparkSession, d: str) -> DataFrame:
    """The policy's decisions under a grid of whole costs a side."""
    out = tickets.summary(views.walk(s, d), tickets.views(views.walk(s, d)))
    return out.select("product_id", F.inline("cost_grid"))


add("ticket_cost_grid", _costed, _RISING + ", " + ", ".join(_DECIDED[:3]) + f", {_COSTED}, c AS ({_COSTED_ALL}), r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY product_id, cost_bps ORDER BY bar_idx) - 1 AS r FROM c)"
    " SELECT product_id, cost_bps, round(arg_max(equity, bar_idx) / arg_min(equity, bar_idx) - 1, 6) AS total_return, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 0), 6) AS sharpe, CAST(sum(trades) AS BIGINT) AS n_trades FROM r GROUP BY ALL")  # fmt: skip
add("backtest_summary", lambda s, d: tickets.summary(views.walk(s, d), tickets.views(views.walk(s, d))))


def _replay(s: SparkSession, d: str) -> DataFrame:
    t = views.ticks(s, d)
    runs = t.select("product_id", F.col("ts").alias("made_at"), F.col("seq").alias("run_no"), F.when(F.col("side") == "BUY", "trend_up").otherwise("trend_down").alias("regime"), (F.col("size") / 100).alias("confidence"))
    return simulate.replay_runs(views.bars(s, d), runs)


add("replay_asof", _replay, with_(views.bars_sql(), "runs AS (SELECT * FROM ticks)",
    "hit AS (SELECT runs.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.product_id = runs.product_id AND b.ts >= runs.ts) AS bar_idx FROM runs)")
    + "SELECT product_id, bar_idx, arg_max(seq, (ts, seq)) AS run_no, arg_max(CASE side WHEN 'BUY' THEN 'trend_up' ELSE 'trend_down' END, (ts, seq)) AS regime, arg_max(size / 100, (ts, seq)) AS confidence FROM hit WHERE bar_idx IS NOT NULL GROUP BY 1, 2")


def _flat_replay(s: SparkSession, d: str) -> DataFrame:
    """Decisions looked up by exact time; a bar without one is uncertain."""
    said = views.bars(s, d).filter("close <> open").select("product_id", "ts", F.when(F.col("close") > F.col("open"), "trend_up").otherwise("trend_down").alias("regime"), F.lit(0.8).alias("confidence"))
    return views.bars(s, d).join(said, ["product_id", "ts"], "left").select("product_id", "bar_idx", F.coalesce("regime", F.lit("uncertain")).alias("regime"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


add("replay_flat", _flat_replay, with_(views.bars_sql()) + "SELECT product_id, bar_idx, CASE WHEN close = open THEN 'uncertain' WHEN close > open THEN 'trend_up' ELSE 'trend_down' END AS regime, CASE WHEN close <> open THEN CAST(0.8 AS DOUBLE) ELSE 0.0 END AS confidence FROM bars")
