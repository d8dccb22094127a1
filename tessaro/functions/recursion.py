"""Recursive smoothers along the bars.

A smoother forgets: after `reach` bars what came before is below the last bit of a double. So a
product is cut into stretches that each begin so many bars earlier, and a stretch is computed on
arrays in one pass, however many smoothers are asked for. Only a product's first stretch is seeded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import whole_cells
from ..plans.stretches import KEY, ORDER, OWN, STRETCH, stretched


def reach(keep: float) -> int:
    """After how many steps `keep` per step leaves nothing a double could hold; twice, as bars without a value don't count."""
    return 2 * math.ceil(math.log(1e-17) / math.log(keep))


def recurse(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """v = keep * v + (1 - keep) * x along x, from `start`; in blocks, whose powers stay in range."""
    out, size = np.empty(len(x)), max(1, min(128, int(-300 / math.log(keep)) if keep > 0 else 1))
    powers = keep ** np.arange(1, size + 1)
    for i in range(0, len(x), size):
        block = x[i : i + size]
        p = powers[: len(block)]
        out[i : i + len(block)] = p * (start + (1 - keep) * np.cumsum(block / p))
        start = out[i + len(block) - 1]
    return out


def smoothed(x: np.ndarray, keep: float, seed: int, first: bool) -> np.ndarray:
    """The smoother at each place; places without a value keep the last one.

    In a first stretch it starts as the plain mean of the first `seed` values and is NaN before.
    """
    known = ~np.isnan(x)
    values, place = x[known], np.cumsum(known) - 1
    if not first:
        done = recurse(values, keep, values[0] if len(values) else 0.0)
    elif len(values) < seed:
        done = np.full(len(values), np.nan)
    else:
        done = np.concatenate([np.full(seed - 1, np.nan), [values[:seed].mean()], recurse(values[seed:], keep, values[:seed].mean())])
    return np.where(place >= 0, done[np.maximum(place, 0)], np.nan) if len(done) else np.full(len(x), np.nan)


def scan(df: DataFrame, columns: list[str], out: list[str], back: int, step: Callable[[bool, dict[str, np.ndarray]], dict[str, np.ndarray]], span: int | None = None) -> DataFrame:
    """df with the double columns `out` that step(whether it is the first stretch, arrays) makes of each stretch in order."""

    kept = [*df.columns, *out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, edges in whole_cells(batches, "_cell"):
            made = {c: np.empty(len(rows)) for c in out}
            arrays = {c: rows[c].to_numpy(float, na_value=np.nan) for c in columns}
            stretch = rows[STRETCH].to_numpy()
            for a, z in zip(edges, edges[1:]):
                done = step(stretch[a] == 0, {c: v[a:z] for c, v in arrays.items()})
                for c in out:
                    made[c][a:z] = done[c]
            rows = rows.assign(**{c: pd.array(np.where(np.isfinite(v), v, np.nan), dtype="Float64") for c, v in made.items()})
            yield rows[rows[OWN]][kept]

    rows = stretched(df, back, span=span).withColumn("_cell", F.concat_ws("|", KEY, STRETCH))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in out)])
    return rows.repartition(KEY, STRETCH).sortWithinPartitions("_cell", ORDER).mapInPandas(run, schema)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([np.full(min(by, len(x)), np.nan), x[: max(0, len(x) - by)]])


def squared_returns(close: np.ndarray) -> np.ndarray:
    """Squares of log returns; NaN where a price of the pair isn't positive."""
    before = shifted(close, 1)
    with np.errstate(all="ignore"):
        return np.where((close > 0) & (before > 0), np.log(close / before) ** 2, np.nan)


def volatility_of(r2: np.ndarray, com: float, ppy: float, seed: int, first: bool) -> np.ndarray:
    v = smoothed(r2, com / (com + 1), seed, first)
    if first:  # there must be more returns than the seed takes
        v = np.where(np.cumsum(~np.isnan(r2)) > seed, v, np.nan)
    return np.sqrt(v * ppy)


def ewma_volatility(df: DataFrame, coms: dict[str, float], ppy: float, seed: int = 20, span: int | None = None) -> DataFrame:
    """Annualised volatilities of log returns: seeded by the mean of the first squares, then v = lam v + (1 - lam) r^2.

    One column per name and centre of mass. A pair with a price that isn't positive gives no
    return. Null until there are more returns than the seed takes.
    """

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r2 = squared_returns(x["close"])
        return {name: volatility_of(r2, com, ppy, seed, first) for name, com in coms.items()}

    return scan(df, ["close"], list(coms), max(reach(c / (c + 1)) for c in coms.values()), step, span)


def ema(df: DataFrame, periods: dict[str, int], column: str = "close", span: int | None = None) -> DataFrame:
    """Exponential means, each seeded by the plain mean of its first values; null before, and where the value is."""

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = x[column]
        return {name: np.where(np.isnan(v), np.nan, smoothed(v, 1 - 2 / (p + 1), p, first)) for name, p in periods.items()}

    return scan(df, [column], list(periods), max(reach(1 - 2 / (p + 1)) if p > 1 else 1 for p in periods.values()), step, span)


def rsi_wilder(df: DataFrame, name: str, period: int = 14, span: int | None = None) -> DataFrame:
    """Wilder's relative strength: plain means of the first changes, then smoothed; 100 without a loss."""
    keep = (period - 1) / period

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        d = x["close"] - shifted(x["close"], 1)
        up, down = (smoothed(np.where(np.isnan(d), np.nan, np.maximum(sign * d, 0.0)), keep, period, first) for sign in (1, -1))
        with np.errstate(all="ignore"):
            return {name: np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))}

    return scan(df, ["close"], [name], reach(keep), step, span)


def ewma_beta(df: DataFrame, *, halflife: float = 60, shrink: float = 1 / 3, low: float = 0.0, high: float = 3.0, least: int = 90, span: int | None = None) -> DataFrame:
    """Rows (product_id, bar_idx, asset, bench) of returns get their beta: exponential covariance over variance, shrunk to 1 and clipped.

    Neither is centred; both begin with the first pair. 1 before there are `least` pairs, and
    where the benchmark doesn't move. A pair with a null doesn't count.
    """
    keep = 0.5 ** (1 / halflife)

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a, b = x["asset"], x["bench"]
        known = ~(np.isnan(a) | np.isnan(b))
        cov, var = smoothed(np.where(known, a * b, np.nan), keep, 1, first), smoothed(np.where(known, b * b, np.nan), keep, 1, first)
        enough = (np.cumsum(known) >= least) if first else np.full(len(a), True)
        with np.errstate(all="ignore"):
            beta = np.clip((1 - shrink) * cov / var + shrink, low, high)
        return {"beta": np.where(enough & (var > 1e-18), beta, 1.0)}

    return scan(df, ["asset", "bench"], ["beta"], reach(keep), step, span)
