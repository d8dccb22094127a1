"""Costs, grids and quotes as column arithmetic; grid replay as an ordered scan.

Inputs that make no sense (a crossed quote, a negative fee, a price that isn't positive) give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of two venues: (name, spread in bps, fee in bps a side).
PRESETS = (("exchange_intro_taker", 2.0, 120.0), ("retail_venue_markup_2026-08", 190.0, 0.0))
#: Fixed value: how many times the cost a move must be to be worth discussing.
SAFETY = 2.0


def _not_negative(value: Column, *inputs: Column) -> Column:
    fine = F.lit(True)
    for x in inputs:
        fine = fine & (x >= 0)
    return F.when(fine, value)


def mid_spread_bps(bid: Column, ask: Column) -> Column:
    """Spread in bps of the mid; null unless 0 < bid <= ask."""
    return F.when((bid > 0) & (ask >= bid), F.try_divide(ask - bid, (ask + bid) / 2) * 1e4)


def roundtrip_cost_bps(spread: Column, fee: Column, slippage: Column) -> Column:
    """Taking both ways: the whole spread, two fees, two slippages."""
    return _not_negative(spread + 2 * fee + 2 * slippage, spread, fee, slippage)


def maker_roundtrip_bps(fee: Column) -> Column:
    """Resting both ways: two fees."""
    return _not_negative(2 * fee, fee)


def required_move_bps(roundtrip: Column, safety: float = SAFETY) -> Column:
    """The move that an idea must promise: the cost of both ways, several times over."""
    if safety <= 0:
        raise ValueError("the multiple must be positive")
    return _not_negative(roundtrip * safety, roundtrip)


def cost_table(spark: SparkSession, slippage: float = 0.0) -> DataFrame:
    """(preset, roundtrip_bps) of the known venues."""
    rows = spark.createDataFrame(PRESETS, "preset string, spread double, fee double")
    return rows.select("preset", roundtrip_cost_bps(F.col("spread"), F.col("fee"), F.lit(slippage)).alias("roundtrip_bps"))


def grid_levels(low: Column, high: Column, n: Column, geometric: bool) -> Column:
    """n + 1 levels from low to high, evenly spaced or in equal ratios; null for an impossible grid."""
    steps = F.sequence(F.lit(0), n.cast("int"))
    level = (lambda i: low * F.pow(high / low, i / n)) if geometric else (lambda i: low + (high - low) * i / n)
    return F.when((low > 0) & (high > low) & (n >= 1), F.transform(steps, level))


def step_bps(levels: Column) -> Column:
    """The upper median of the steps between levels, in bps of the lower."""
    steps = F.zip_with(F.slice(levels, 1, F.size(levels) - 1), F.slice(levels, 2, F.size(levels) - 1), lambda a, b: (b / a - 1) * 1e4)
    ordered = F.array_sort(steps)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def roundtrip_net_bps(step: Column, roundtrip: Column) -> Column:
    """What one completed round trip of a grid leaves."""
    return step - roundtrip


def reservation_price(mid: Column, inventory: Column, gamma: Column, sigma: Column, horizon: Column) -> Column:
    return F.when((mid > 0) & (gamma > 0) & (sigma > 0) & (horizon >= 0), mid - inventory * gamma * sigma * sigma * horizon)


def optimal_spread(gamma: Column, sigma: Column, horizon: Column, k: Column) -> Column:
    return F.when((gamma > 0) & (sigma > 0) & (k > 0) & (horizon >= 0), gamma * sigma * sigma * horizon + 2 / gamma * F.ln(1 + gamma / k))


def quotes(mid: Column, inventory: Column, gamma: Column, sigma: Column, horizon: Column, k: Column, least: float = 0.0) -> dict[str, Column]:
    """bid and ask around the reservation price, no nearer than `least` to each other."""
    r, s = reservation_price(mid, inventory, gamma, sigma, horizon), optimal_spread(gamma, sigma, horizon, k)
    s = F.when(s.isNotNull(), F.greatest(s, F.lit(least)))
    return {"bid": r - s / 2, "ask": r + s / 2, "reservation": r, "spread": s}


def inventory_skew(base: Column, quote: Column, price: Column, target: Column, width: Column) -> tuple[Column, Column]:
    """(bid ratio, ask ratio), together 2: what is held below its target share buys more and sells less.

    Values are in units of the base. The lean grows in proportion to the distance from the target
    and is whole at `width` below it, but no lower than nothing held, and at `width` above it.
    """
    total = base + F.try_divide(quote, price)
    aim = total * target
    below, above = aim - F.greatest(aim - width, F.lit(0.0)), width
    short = F.when(below > 0, F.least(F.lit(1.0), F.try_divide(aim - base, below))).otherwise(1.0)
    long = F.when(above > 0, F.least(F.lit(1.0), F.try_divide(base - aim, above))).otherwise(1.0)
    lean = F.when(total <= 0, 0.0).when(base < aim, short).when(base > aim, -long).otherwise(0.0)
    fine = (price > 0) & (base >= 0) & (quote >= 0) & (target >= 0) & (target <= 1) & (width >= 0)
    return F.when(fine, 1 + lean), F.when(fine, 1 - lean)


def ladder(mid: Column, first: Column, step: Column, n: int) -> tuple[Column, Column]:
    """(bids, asks): n prices on either side, `first` bps from the mid and then each `step` bps further."""
    if n < 1:
        raise ValueError("a ladder has one level or more")
    fine = (mid > 0) & (first >= 0) & (step >= 0)

    def side(sign: int) -> Column:
        return F.when(fine, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mid * (1 + sign * (first + k * step) / 1e4)))

    return side(-1), side(1)


def anchor_gap_bps(here: Column, elsewhere: Column) -> Column:
    """How far the mid lies above a mid from elsewhere, in bps of that."""
    return F.when((here > 0) & (elsewhere > 0), F.try_divide(here - elsewhere, elsewhere) * 1e4)


def spread_capture_bps(half_spread: Column, maker_fee: Column, adverse: Column) -> Column:
    """What buying at the bid and selling at the ask leaves."""
    return _not_negative(2 * half_spread - 2 * maker_fee - adverse, half_spread, maker_fee, adverse)


RESULT = (
    "product_id string, realized_cash double, fees_paid double, roundtrips bigint, buys bigint, sells bigint, final_inventory double, "
    "max_inventory double, inventory_mark double, total_pnl double"
)


def replay_grid(prices: DataFrame, levels: list[float], quantity: float, *, fee_bps: float = 0.0, start: float = 0.0) -> DataFrame:
    """One row per product of RESULT: a grid of resting orders along its closes, in order of bar_idx.

    Levels below the first price start as purchases, those above as sales. A price at or beyond a
    level fills it, at the level. A filled purchase arms a sale one level up, a filled sale a
    purchase one level down, unless something rests there. Products with fewer than two prices
    don't come out; null prices are passed over. The order of fills is the path's, so a path is
    one scan that carries its levels only.
    """
    if len(levels) < 2 or any(b <= a for a, b in zip(levels, levels[1:])) or quantity <= 0 or fee_bps < 0:
        raise ValueError("levels must rise, the quantity be positive and the fee not be negative")
    at = np.array(levels, float)

    class Book:
        def __init__(self, price: float):
            self.armed = np.where(at < price, 1, np.where(at > price, -1, 0))
            self.seen, self.last, self.cash, self.fees, self.buys, self.sells, self.most = 1, price, 0.0, 0.0, 0, 0, start

        @property
        def held(self) -> float:
            return start + (self.buys - self.sells) * quantity

        def meet(self, price: float) -> None:
            self.seen, self.last = self.seen + 1, price
            for i in np.flatnonzero(((self.armed == 1) & (at >= price)) | ((self.armed == -1) & (at <= price))):
                side = self.armed[i]
                self.cash -= side * at[i] * quantity
                self.fees += at[i] * quantity * fee_bps / 1e4
                self.buys, self.sells = self.buys + (side == 1), self.sells + (side == -1)
                self.armed[i] = 0
                if 0 <= i + side < len(at) and not self.armed[i + side]:
                    self.armed[i + side] = -side
            self.most = max(self.most, self.held)

        def row(self, key: str) -> tuple:
            mark, cash = (self.held - start) * self.last, self.cash - self.fees
            return key, cash, self.fees, min(self.buys, self.sells), self.buys, self.sells, self.held, self.most, mark, cash + mark

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book, done = None, None, []
        for batch in batches:
            for key, price in zip(batch["product_id"], batch["close"]):
                if key != now:
                    done += [book.row(now)] if book and book.seen > 1 else []
                    now, book = key, Book(price)
                else:
                    book.meet(price)
        done += [book.row(now)] if book and book.seen > 1 else []
        yield pd.DataFrame(done, columns=[c.split()[0] for c in RESULT.split(", ")])

    placed = prices.select("product_id", "bar_idx", "close").filter("close IS NOT NULL AND NOT isnan(close)").repartition("product_id").sortWithinPartitions("product_id", "bar_idx")
    return placed.mapInPandas(run, RESULT)
