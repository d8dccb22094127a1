"""Portfolio simulators: decide on a bar's close, fill at the next one's open.

State runs along a run's bars, so a run is one ordered scan; runs (symbols' sets, cost levels)
are spread over the cluster. Signals are columns computed beforehand by window plans, so a scan
never looks back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fractions an action aims at, and what the others do to the holding.
TARGETS = {"target_weight_100": 1.0, "target_weight_60": 0.6, "target_weight_30": 0.3, "target_weight_20": 0.2, "flat_position": 0.0}
SCALES = {"halve_position": 0.5, "reduce_25_percent": 0.75, "reduce_10_percent": 0.90}
CAP, REACCUMULATE, CAPITAL, FEE_BPS, SLIPPAGE_BPS, BAND, DUST = 0.10, 0.05, 10_000.0, 10.0, 5.0, 0.10, 1e-9
PERIODS = {"1m": 525_600, "5m": 105_120, "15m": 35_040, "30m": 17_520, "1h": 8_760, "1hour": 8_760, "4h": 2_190, "12h": 730, "1d": 365, "1day": 365}
FILL = "struct<symbol: string, delta_qty: double, price: double, cost: double>"
CURVE = f"run_id string, bar_idx int, equity double, cash double, turnover double, trades int, weights map<string, double>, fills array<{FILL}>"
_COLUMNS = ["run_id", "bar_idx", "equity", "cash", "turnover", "trades", "weights", "fills"]


def aligned(bars: DataFrame, run: list[str]) -> DataFrame:
    """Only the bars that all of a run's symbols have."""
    n = bars.groupBy(*run).agg(F.count_distinct("product_id").alias("_all"))
    here = bars.withColumn("_n", F.count("*").over(Window.partitionBy(*run, "bar_idx")))
    return here.join(n, run).filter("_n = _all").drop("_n", "_all")


def _sessions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, dict]]:
    """(run, bar, {symbol: row}) in order; a bar's rows follow each other, also across batches."""
    key, held = None, {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            if (row.run_id, row.bar_idx) != key:
                if held:
                    yield (*key, held)
                key, held = (row.run_id, row.bar_idx), {}
            held[row.product_id] = row
    if held:
        yield (*key, held)


def _spread(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("run_id", "bar_idx", "product_id", "symbol_ord", "open", "close", *columns).repartition("run_id").sortWithinPartitions("run_id", "bar_idx", "symbol_ord")


def weight_engine(rows: DataFrame, *, every: int = 7, band: float = BAND, capital: float = CAPITAL) -> DataFrame:
    """Rows (run_id, bar_idx, product_id, symbol_ord, open, close, weight, cost_bps) to the equity curve.

    Starts in cash. Every `every` bars a weight (null: hold) is noted and filled at the next open:
    sales first, purchases as far as cash goes with their cost, changes below the band left out.
    Weights are held within 0 and 1 and scaled down if they come to more than 1 together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        cash, held, pending, count = capital, {}, {}, 0
        for run_id, bar, rows in _sessions(batches):
            if run_id != now:
                now, cash, held, pending, count = run_id, capital, dict.fromkeys(rows, 0.0), {}, 0
            cost = next(iter(rows.values())).cost_bps / 1e4
            turnover, trades, fills = 0.0, 0, []
            if pending:
                equity = cash + sum(held[s] * rows[s].open for s in rows)
                orders = sorted((w - held[s] * rows[s].open / equity, i, s) for i, (s, w) in enumerate(pending.items())) if equity > 0 else []
                for change, _, s in orders:
                    if abs(change) < band:
                        continue
                    price = rows[s].open
                    if price <= 0:
                        continue
                    amount = change * equity
                    quantity = max(-held[s], amount / price) if amount < 0 else min(amount, cash / (1 + cost)) / price
                    if abs(quantity) > 1e-12:
                        held[s] += quantity
                        fee = abs(quantity) * price * cost
                        cash -= quantity * price + fee
                        turnover += abs(quantity) * price
                        trades += 1
                        fills.append({"symbol": s, "delta_qty": quantity, "price": price, "cost": fee})
                pending = {}
            equity = cash + sum(held[s] * rows[s].close for s in rows)
            out.append((run_id, bar, equity, cash, turnover, trades, {s: held[s] * rows[s].close / equity if equity > 0 else 0.0 for s in rows}, fills))
            if count % every == 0:
                aims = {s: min(1.0, max(0.0, r.weight)) for s, r in rows.items() if r.weight is not None and r.weight == r.weight}
                gross = sum(aims.values())
                if gross > 1:
                    aims = {s: w / gross for s, w in aims.items()}
                if aims:
                    pending = aims
            count += 1
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return _spread(rows, ["weight", "cost_bps"]).mapInPandas(run, CURVE)


def action_engine(rows: DataFrame, *, every: int = 1, capital: float = CAPITAL, initial: dict[str, float] | None = None) -> DataFrame:
    """Rows with an action per bar (run_id, ..., action, cost_bps) to the equity curve.

    Starts in equal holdings, or in the given fractions with the rest in cash, without a fee.
    Orders fill at the next open in the symbols' order. An absolute target is a fraction of CAP of
    equity. Several small purchases of one bar share what cash there was before costs; each
    purchase, in turn, ends where the cash that is left does.
    """
    if initial is not None and not 0 < sum(initial.values()) <= 1 + 1e-9:
        raise ValueError("the initial fractions must be positive and come to 1 at most")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        cash, held, pending, count = capital, {}, {}, 0
        for run_id, bar, rows in _sessions(batches):
            if run_id != now:
                if initial is not None and not set(initial) <= set(rows):
                    raise ValueError(f"no bars of {set(initial) - set(rows)}")
                part = initial or {s: 1 / len(rows) for s in rows}
                now, pending, count = run_id, {}, 0
                held = {s: capital * part.get(s, 0.0) / r.open for s, r in rows.items()}
                cash = max(0.0, capital - sum(capital * part.get(s, 0.0) for s in rows))
            cost = next(iter(rows.values())).cost_bps / 1e4
            turnover, trades, fills = 0.0, 0, []
            equity = cash + sum(held[s] * rows[s].open for s in rows)
            adders = [s for s, a in pending.items() if a == "reaccumulate_small"]
            demand = len(adders) * REACCUMULATE * equity
            share = min(1.0, cash / demand) if demand > 0 else 1.0
            for s, a in pending.items():
                price, change = rows[s].open, 0.0
                if a in TARGETS:
                    change = TARGETS[a] * CAP * equity / price - held[s]
                elif a in SCALES:
                    change = held[s] * (SCALES[a] - 1)
                elif a == "reaccumulate_small":
                    change = REACCUMULATE * equity * share / price
                if change > 0:
                    change = min(change, max(0.0, cash) / (price * (1 + cost)))
                if change:
                    held[s] += change
                    fee = abs(change) * price * cost
                    cash -= change * price + fee
                    turnover += abs(change) * price
                    trades += 1
                    fills.append({"symbol": s, "delta_qty": change, "price": price, "cost": fee})
            pending = {}
            equity = cash + sum(held[s] * rows[s].close for s in rows)
            out.append((run_id, bar, equity, cash, turnover, trades, {s: held[s] * rows[s].close / equity if equity > 0 else 0.0 for s in rows}, fills))
            if count % every == 0:
                pending = {s: r.action for s, r in rows.items() if r.action in TARGETS or r.action in SCALES or r.action == "reaccumulate_small"}
            count += 1
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return _spread(rows, ["action", "cost_bps"]).mapInPandas(run, CURVE)


def metrics(curve: DataFrame, granularity: str = "1d") -> DataFrame:
    """The ten figures of each run's equity curve, in one aggregation."""
    ppy = float(PERIODS.get(granularity, 365))
    w = Window.partitionBy("run_id").orderBy("bar_idx")
    before = F.lag("equity").over(w)
    rows = curve.withColumns({"r": F.when((before > 0) & (F.col("equity") > 0), F.col("equity") / before - 1), "peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    first, last, n = F.min_by("equity", "bar_idx"), F.max_by("equity", "bar_idx"), F.count("*")
    sd, down = F.coalesce(F.stddev_samp("r"), F.lit(0.0)), F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0))
    out = rows.groupBy("run_id").agg(
        n.alias("n_bars"), (F.try_divide(last, first) - 1).alias("total_return"), F.when((n > 1) & (last > 0), F.pow(F.try_divide(last, first), F.try_divide(F.lit(ppy), n - 1)) - 1).otherwise(0.0).alias("cagr"),
        (sd * ppy**0.5).alias("ann_vol"), F.coalesce(F.try_divide(F.avg("r"), sd) * ppy**0.5, F.lit(0.0)).alias("sharpe"), F.coalesce(F.try_divide(F.avg("r"), down) * ppy**0.5, F.lit(0.0)).alias("sortino"),
        F.least(F.lit(0.0), F.min(F.try_divide(F.col("equity"), F.col("peak")) - 1)).alias("max_drawdown"), F.sum("trades").alias("n_trades"), F.try_divide(F.sum("turnover"), F.avg("equity")).alias("turnover"),
    )
    return out.withColumn("calmar", F.coalesce(F.try_divide(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0)))


def replay_runs(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Which run speaks at which bar: each at the first bar at or after it was made, the newest of several.

    runs: (product_id, made_at, run_no, regime, confidence). Two exchanges on the product, no
    pairing of all runs with all bars: both sides are merged in time order and carried over.
    """
    w = Window.partitionBy("product_id").orderBy("t", "is_bar", "run_no")
    b = bars.select("product_id", F.unix_micros("ts").alias("t"), F.lit(1).alias("is_bar"), F.lit(None).cast("bigint").alias("run_no"), "bar_idx", F.lit(None).cast("string").alias("regime"), F.lit(None).cast("double").alias("confidence"))
    r = runs.select("product_id", F.unix_micros("made_at").alias("t"), F.lit(0).alias("is_bar"), F.col("run_no").cast("bigint").alias("run_no"), F.lit(None).cast("int").alias("bar_idx"), "regime", "confidence")
    merged = b.unionByName(r)
    said = F.struct("run_no", "regime", "confidence")
    rows = merged.withColumns({"newest": F.last(F.when(F.col("is_bar") == 0, said), ignorenulls=True).over(w), "turn": F.lag("is_bar").over(w)})
    fired = rows.filter("is_bar = 1 AND turn = 0")
    return fired.select("product_id", "bar_idx", "newest.run_no", "newest.regime", "newest.confidence")
