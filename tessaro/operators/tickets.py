"""Trading decisions of the trend state, what became of them, and the tickets they form.

A decision is a row of column arithmetic; only the portfolio is a scan. Tickets are islands of
decisions: a flat one ends with the fill that opens a position, a long one with the fill that
leaves none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import volatility
from . import policy, simulate

MODES = ("policy", "vol_scaled")
NEED = volatility.MIN_BARS
#: Actions that are floors or reductions of the policy: a long position they open is no bullish call.
FLOORS = ("target_weight_20", "halve_position")


def views(bars: DataFrame, *, mode: str = "policy", sigma_target: float = 0.10, ppy: float = 365.0, cap: float = 1.0, every: int = 1) -> DataFrame:
    """(product_id, bar_idx, ok, regime, confidence, action, target, ...) at every `every`-th bar; a null target is no view.

    Halving takes half of the last target given, of nothing if none was. ok is false before the
    trend can be told.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    regime, confidence = volatility.trend_state()
    rows = volatility.trend(bars, ppy).filter(F.col("bar_idx") % every == 0).withColumns({"regime": regime, "confidence": confidence})
    rows = rows.withColumns({"action": policy.action(F.col("regime"), F.col("confidence")), "ok": F.col("score").isNotNull()})
    if mode == "vol_scaled":
        return rows.withColumn("target", F.when(F.col("ok"), volatility.target_weight(F.col("score"), F.col("sigma"), sigma_target)))
    fixed = F.when(F.col("ok"), F.element_at(F.create_map(*(F.lit(x) for item in simulate.TARGETS.items() for x in item)), F.col("action")) * cap)
    w = Window.partitionBy("product_id").orderBy("bar_idx")
    rows = rows.withColumns({"_fixed": fixed, "_halve": (F.col("ok") & (F.col("action") == "halve_position")).cast("int")})
    rows = rows.withColumns({"_base": F.coalesce(F.last("_fixed", ignorenulls=True).over(w), F.lit(0.0)), "_island": F.count("_fixed").over(w)})
    halved = F.sum("_halve").over(Window.partitionBy("product_id", "_island").orderBy("bar_idx"))
    target = F.coalesce("_fixed", F.when(F.col("_halve") == 1, F.col("_base") * F.pow(F.lit(0.5), halved)))
    return rows.withColumn("target", target).drop("_fixed", "_halve", "_base", "_island")


def curve(bars: DataFrame, seen: DataFrame, *, band: float = simulate.BAND, cost_bps: float = 15.0, capital: float = simulate.CAPITAL, every: int = 1) -> DataFrame:
    """The weight engine's curve of each product on its own; cost_bps is the whole cost a side."""
    rows = bars.select("product_id", "bar_idx", "open", "close").join(seen.select("product_id", "bar_idx", F.col("target").alias("weight")), ["product_id", "bar_idx"], "left")
    rows = rows.withColumns({"run_id": F.col("product_id"), "symbol_ord": F.col("product_id"), "cost_bps": F.lit(float(cost_bps))})
    return simulate.weight_engine(rows, every=every, band=band, capital=capital)


def decisions(bars: DataFrame, seen: DataFrame, path: DataFrame, *, band: float = simulate.BAND, mode: str = "policy", sigma_target: float = 0.10, include_warmup: bool = False) -> DataFrame:
    """One row per decision: what was seen, held and done at the next bar. The last bar decides nothing.

    bars needs ts; path is curve(bars, seen).
    """
    w = Window.partitionBy("product_id").orderBy("bar_idx")
    fill = F.get("fills", F.lit(0))
    held = path.select(F.col("run_id").alias("product_id"), "bar_idx", F.coalesce(F.element_at("weights", F.col("run_id")), F.lit(0.0)).alias("position_weight"), fill.alias("fill"))
    rows = bars.select("product_id", "bar_idx", "ts", "close").join(held, ["product_id", "bar_idx"])
    rows = rows.withColumns({"_fill": F.lead("fill").over(w), "_ts": F.lead("ts").over(w), "weight_after": F.lead("position_weight").over(w)}).filter("weight_after IS NOT NULL")
    rows = rows.join(seen.drop("close"), ["product_id", "bar_idx"])
    rows = rows if include_warmup else rows.filter("ok")
    filled = F.col("_fill").isNotNull()
    rows = rows.withColumns({
        "fill_ts": F.when(filled, F.col("_ts")), "fill_px": F.col("_fill.price"), "fee": F.col("_fill.cost"), "delta_qty": F.col("_fill.delta_qty"),
        "side": F.when(F.col("_fill.delta_qty") > 0, "buy").when(filled, "sell"),
    }).drop("fill", "_fill", "_ts")
    return rows.withColumn("reasoning", reasoning(band, mode, sigma_target))


def _signed(x: str) -> Column:
    return F.format_string("%+.2f", F.col(x))


def _plain(x: Column) -> Column:
    return F.format_string("%.2f", x)


# The sentences below are fixed formats.
def reasoning(band: float = simulate.BAND, mode: str = "policy", sigma_target: float = 0.10) -> Column:
    """A sentence that derives a decision from its numbers."""
    pos, target, action, conf = F.col("position_weight"), F.col("target"), F.col("action"), _plain(F.col("confidence"))
    short = F.format_string(f"Insufficient history (%d/{NEED} daily bars) -> %s at confidence %s -> %s (no order); position %s -> hold.", (F.col("bar_idx") + 1).cast("int"), "regime", conf, action, _plain(pos))
    side = F.when(F.col("vol_ratio") > volatility.OVERHEAT, "above").otherwise("below")
    head = F.format_string(
        f"TSMOM blend %s (s22 %s, s261 %s), vol ratio %s %s the {volatility.OVERHEAT:.2f} overheat line -> %s at confidence %s",
        _signed("score"), _signed("s22"), _signed("s261"), _plain(F.col("vol_ratio")), side, F.col("regime"), conf,
    )
    if mode == "vol_scaled":
        act = F.format_string(f"target weight %s (vol-scaled: %s x {sigma_target:.2f} / %s; policy label %s)", _plain(target), _signed("score"), _plain(F.col("sigma")), action)
    else:
        to = F.format_string("target weight %s", _plain(target))
        act = (
            F.when(action == "flat_position", F.concat(to, F.lit(" (flat)"))).when(action.isin(*simulate.TARGETS), to)
            .when(action == "halve_position", F.format_string("halve position to %s", _plain(target))).otherwise(F.format_string("%s (no order)", action))
        )
    done = F.when(target.isNull(), "hold").when(F.abs(target - pos) < band, "inside band, no trade").when(target > pos, F.format_string("buy to %s", _plain(target))).otherwise(F.format_string("sell to %s", _plain(target)))
    return F.when(~F.col("ok"), short).otherwise(F.format_string(f"%s -> %s; position %s -> %s (band {band:.2f}).", head, act, _plain(pos), done))


def _thesis(long: Column) -> Column:
    told = F.coalesce(_signed("score"), F.lit("n/a"))
    told = F.when(F.col("score").isNull(), "n/a").otherwise(told)
    aim = F.when(F.col("target").isNull(), "n/a").otherwise(_plain(F.col("target")))
    conf, regime, action = _plain(F.col("confidence")), F.col("regime"), F.col("action")
    floor = F.format_string(
        "Policy floor, not a bullish call: %s at confidence %s (TSMOM blend %s) -> %s -> target weight %s; the book was flat, so reaching the floor means buying to %s.", regime, conf, told, action, aim, aim
    )
    enter = F.format_string("Enter long: %s at confidence %s (TSMOM blend %s) -> %s -> target weight %s.", regime, conf, told, action, aim)
    stay = F.format_string("Stay flat: %s at confidence %s (TSMOM blend %s) -> %s; no position held.", regime, conf, told, action)
    return F.when(long, F.when((regime == "trend_down") | action.isin(*FLOORS), floor).otherwise(enter)).otherwise(stay)


def tickets(made: DataFrame) -> DataFrame:
    """One row per ticket of decisions(), numbered from 1 within its product.

    A long ticket has its entry, size and fills' fees; once closed also exit, pnl (the net cash of
    its fills) and the return on what was bought. A flat ticket lasts until a position is opened;
    its entry is the close it began at.
    """
    w = Window.partitionBy("product_id").orderBy("bar_idx")
    dust = simulate.DUST
    filled = F.col("fill_px").isNotNull()
    opens = F.coalesce(filled & (F.col("position_weight") <= dust) & (F.col("delta_qty") > 0), F.lit(False))
    ends = F.coalesce(filled & (F.col("delta_qty") < 0) & (F.col("weight_after") <= dust), F.lit(False))
    rows = made.withColumns({"_opens": opens, "_ends": ends})
    rows = rows.withColumn("_starts", (F.col("_opens") | F.coalesce(F.lag("_ends").over(w), F.lit(True))).cast("int"))
    rows = rows.withColumn("ticket_no", F.sum("_starts").over(w)).withColumn("_thesis", _thesis(F.col("_opens")))
    begin, end = (lambda c: F.min_by(c, "bar_idx")), (lambda c: F.max_by(c, "bar_idx"))
    cash, bought = -(F.col("delta_qty") * F.col("fill_px")) - F.col("fee"), F.when(F.col("delta_qty") > 0, F.col("delta_qty") * F.col("fill_px"))
    out = rows.groupBy("product_id", "ticket_no").agg(
        begin("_opens").alias("long"), begin("fill_ts").alias("_fill_ts"), begin("ts").alias("_ts"), begin("fill_px").alias("_px"), begin("close").alias("_close"), begin("weight_after").alias("_size"),
        begin("_thesis").alias("thesis"), begin("reasoning").alias("why_open"), F.count("*").alias("n_decisions"), F.coalesce(F.sum("fee"), F.lit(0.0)).alias("_fees"), F.sum(cash).alias("_cash"), F.sum(bought).alias("_bought"),
        F.max("weight_after").alias("_peak"), end("_ends").alias("closed"), end("fill_ts").alias("_last_ts"), end("fill_px").alias("_last_px"), end("reasoning").alias("_why"),
    )
    following = F.lead(F.when(F.col("long"), F.col("_fill_ts"))).over(Window.partitionBy("product_id").orderBy("ticket_no"))
    long, closed = F.col("long"), F.col("long") & F.col("closed")
    return out.withColumn("_next", following).select(
        F.format_string("%s-T%03d", "product_id", F.col("ticket_no").cast("int")).alias("ticket_id"), "product_id", "ticket_no", F.when(long, "long").otherwise("flat").alias("side"),
        F.when(long, F.col("_fill_ts")).otherwise(F.col("_ts")).alias("open_ts"), F.when(closed, F.col("_last_ts")).when(~long, F.col("_next")).alias("close_ts"),
        F.round(F.when(long, F.col("_px")).otherwise(F.col("_close")), 6).alias("entry"), F.when(closed, F.round("_last_px", 6)).alias("exit"), F.when(long, F.round("_size", 6)).otherwise(0.0).alias("size"),
        F.when(closed, F.round("_cash", 6)).alias("pnl"), F.when(long, F.round("_fees", 6)).otherwise(0.0).alias("fees"), F.when(long, F.round("_peak", 6)).alias("peak_weight"),
        F.when(closed & (F.col("_bought") > 0), F.round(F.try_divide("_cash", "_bought"), 6)).alias("return_on_cost"), "n_decisions", "thesis", "why_open", F.when(closed, F.col("_why")).alias("why_close"),
    )


def summary(bars: DataFrame, seen: DataFrame, *, costs: tuple[float, ...] = (0, 10, 20, 40, 60, 120), band: float = simulate.BAND, cost_bps: float = 15.0, capital: float = simulate.CAPITAL, every: int = 1) -> DataFrame:
    """One row per product: the metrics of its curve, fees paid in bps of the capital, and a grid of costs, all in one scan."""
    rows = bars.select("product_id", "bar_idx", "open", "close").join(seen.select("product_id", "bar_idx", F.col("target").alias("weight")), ["product_id", "bar_idx"], "left")
    rows = rows.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in (-1.0, *costs)))))  # -1 stands for the run itself
    rows = rows.withColumns({"run_id": F.concat_ws("@", "product_id", "cost_bps"), "symbol_ord": F.col("product_id"), "cost_bps": F.when(F.col("cost_bps") < 0, cost_bps).otherwise(F.col("cost_bps"))})
    done = simulate.weight_engine(rows, every=every, band=band, capital=capital).withColumn("fees", F.aggregate("fills", F.lit(0.0), lambda a, f: a + f["cost"]))
    fees = done.groupBy("run_id").agg(F.round(F.sum("fees") / capital * 1e4, 4).alias("fees_paid_bps"))
    facts = simulate.metrics(done, "1d").join(fees, "run_id").withColumns({"product_id": F.substring_index("run_id", "@", 1), "grid_cost": F.substring_index("run_id", "@", -1).cast("double")})
    own = facts.filter("grid_cost < 0").drop("run_id", "grid_cost")
    point = F.struct(F.col("grid_cost").alias("cost_bps"), F.round("total_return", 6).alias("total_return"), F.round("sharpe", 6).alias("sharpe"), "n_trades")
    grid = facts.filter("grid_cost >= 0").groupBy("product_id").agg(F.array_sort(F.collect_list(point)).alias("cost_grid"))
    return own.join(grid, "product_id").withColumn("trial_count", F.lit(1))
