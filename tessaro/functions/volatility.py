"""Range volatilities, robust scores, momentum states."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stretches import along, in_stretches
from .recursion import reach, scan, shifted, squared_returns, volatility_of
from .safe import clip, sdiv, sln

#: Fixed values of the trend state.
COM_FAST, COM_SLOW, SHORT, MIDDLE, LONG, VOL_FLOOR, THETA, OVERHEAT, MIN_BARS = 5, 180, 22, 65, 261, 0.05, 0.15, 1.25, 263
CONF_FLOOR, CONF_BASE, CONF_SPAN, MAD_SCALE = 0.30, 0.50, 0.45, 1.4826


def rogers_satchell(bars: DataFrame, skip_first: bool = False) -> DataFrame:
    """(product_id, rs): mean of u(u - c) + d(d - c) over log ranges; null if any bar is unusable."""
    u, d, c = (sln(sdiv(F.col(x), F.col("open"))) for x in ("high", "low", "close"))
    rows = bars.filter("bar_idx > 0") if skip_first else bars
    term = u * (u - c) + d * (d - c)
    return rows.groupBy("product_id").agg(F.when(F.count(term) == F.count("*"), F.avg(term)).alias("rs"))


def yang_zhang(bars: DataFrame, ppy: float) -> DataFrame:
    """(product_id, vol): overnight, open-to-close and range variance combined, annualised."""
    rows = in_stretches(bars.select("product_id", "bar_idx", "open", "high", "low", "close"), 1, lambda df: df.withColumn("before", F.lag("close").over(along())))
    gap, day = sln(sdiv(F.col("open"), F.col("before"))), sln(sdiv(F.col("close"), F.col("open")))
    u, d = sln(sdiv(F.col("high"), F.col("open"))), sln(sdiv(F.col("low"), F.col("open")))
    rows = rows.select("product_id", "bar_idx", gap.alias("gap"), day.alias("day"), (u * (u - day) + d * (d - day)).alias("rs")).filter("bar_idx > 0")
    k = F.lit(0.34) / (1.34 + F.try_divide(F.col("m") + 1, F.col("m") - 1))
    out = rows.groupBy("product_id").agg(F.count("*").alias("m"), F.var_samp("gap").alias("vo"), F.var_samp("day").alias("vc"), F.avg("rs").alias("vr"), F.count_if(F.col("gap").isNull() | F.col("rs").isNull()).alias("bad"))
    return out.select("product_id", F.when((F.col("bad") == 0) & (F.col("m") >= 2), F.sqrt(F.greatest(F.lit(0.0), F.col("vo") + k * F.col("vc") + (1 - k) * F.col("vr")) * ppy)).alias("vol"))


def robust_z(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds z: distance from the group's median in scaled median deviations; in standard deviations if those vanish, else 0; within 3."""
    middle = df.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_avg"))
    near = df.join(middle, group)
    spread = near.groupBy(group).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("_mad"))
    both = near.join(spread, group)
    z = F.when(F.col("_mad") * MAD_SCALE > 1e-12, F.try_divide(F.col(value) - F.col("_m"), F.col("_mad") * MAD_SCALE)).when(F.col("_sd") > 1e-12, F.try_divide(F.col(value) - F.col("_m"), F.col("_sd"))).otherwise(F.lit(0.0))
    return both.withColumn("z", clip(z, -3.0, 3.0)).drop("_m", "_sd", "_avg", "_mad")


def rank_scores(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """Adds score: the ordinal rank centred and scaled to unit variance."""
    w = Window.partitionBy(group)
    r, n = F.row_number().over(w.orderBy(value, tie)), F.count("*").over(w)
    return df.withColumn("score", F.coalesce(F.try_divide(r - (n + 1) / 2, F.sqrt((n * n - 1) / 12)), F.lit(0.0)))


def trend(bars: DataFrame, ppy: float = 365.0, span: int | None = None) -> DataFrame:
    """(product_id, bar_idx, close, sigma, s22, s65, s261, score, vol_ratio) of each bar; null before MIN_BARS.

    Both volatilities, as they were known two bars ago, and the earlier closes come from one pass.
    """

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r2 = squared_returns(x["close"])
        slow_fast = {name: shifted(volatility_of(r2, com, ppy, 20, first), 2) for name, com in (("f", COM_FAST), ("s", COM_SLOW))}
        return slow_fast | {f"c{k}": shifted(x["close"], k) for k in (SHORT, MIDDLE, LONG)}

    back = max(reach(COM_SLOW / (COM_SLOW + 1)), LONG)
    rows = scan(bars.select("product_id", "bar_idx", "close"), ["close"], ["f", "s", *(f"c{k}" for k in (SHORT, MIDDLE, LONG))], back, step, span)
    known = F.col("bar_idx") >= MIN_BARS - 1
    rows = rows.withColumns({"sigma": F.when(known, F.greatest(F.lit(VOL_FLOOR), (F.col("f") + F.col("s")) / 2)), "vol_ratio": F.when(known, sdiv(F.col("f"), F.col("s")))})
    for length in (SHORT, MIDDLE, LONG):
        z = sdiv(sln(sdiv(F.col("close"), F.col(f"c{length}"))), F.col("sigma") * (length / ppy) ** 0.5)
        rows = rows.withColumn(f"s{length}", F.tanh(z / 2))
    return rows.withColumn("score", 0.5 * F.col("s22") + 0.5 * F.col("s261")).select("product_id", "bar_idx", "close", "sigma", "s22", "s65", "s261", "score", "vol_ratio")


def trend_state() -> tuple[Column, Column]:
    """(regime, confidence) of a row of trend()."""
    s, strength = F.col("score"), F.least(F.abs("score"), F.lit(1.0))
    directed = F.round(CONF_BASE + CONF_SPAN * strength, 2)
    flat = F.round(CONF_FLOOR + 0.19 * (1 - F.least(F.abs("score"), F.lit(THETA)) / THETA), 2)
    hollow = (F.col("s261") < 0) & (F.col("s22") >= THETA)
    regime = (
        F.when(s.isNull(), "uncertain").when((s >= THETA) & (F.col("vol_ratio") > OVERHEAT), "high_volatility_event").when(s >= THETA, "trend_up")
        .when(s <= -THETA, "trend_down").otherwise("range_bound")
    )
    return regime, F.when(s.isNull(), F.lit(CONF_FLOOR)).when((F.abs("score") >= THETA) | hollow, directed).otherwise(flat)


def target_weight(score: Column, sigma: Column, target: float = 0.10) -> Column:
    return F.when(sigma > 0, clip(score * F.try_divide(F.lit(target), sigma), 0.0, 1.0)).when(score.isNotNull(), F.lit(0.0))


def label(x: Column, steps: tuple[tuple[float, str], ...], lowest: str) -> Column:
    """The label of the first step that x reaches, from above."""
    out = None
    for least, name in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(lowest)


def z_label(z: Column) -> Column:
    return F.when(z.isNull(), "insufficient_data").when(z >= 2, "extremely_high").when(z >= 1, "high").when(z <= -2, "extremely_low").when(z <= -1, "low").otherwise("neutral")


def volatility_label(pct: Column) -> Column:
    return label(pct, ((0.90, "extreme"), (0.70, "elevated"), (0.30, "normal"), (0.10, "compressed")), "extremely_compressed")


def funding_label(pct: Column) -> Column:
    return F.when(pct >= 0.95, "extremely_positive").when(pct >= 0.80, "positive").when(pct <= 0.05, "extremely_negative").when(pct <= 0.20, "negative").otherwise("neutral")


def _against_history(x: np.ndarray, lookback: int) -> dict[str, np.ndarray]:
    """Each value against the `lookback` before it: how many there are, their mean, deviation and median, z, and the midrank.

    Equal, for the midrank, is what differs by 1e-9 of the largest magnitude. NaN is no value.
    """
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(lookback, np.nan), x]), lookback)[: len(x)]
    known = ~np.isnan(seen)
    n = known.sum(axis=1)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")  # windows without a value
        mean = np.where(known, seen, 0.0).sum(axis=1) / n
        sd = np.sqrt(np.where(known, (seen - mean[:, None]) ** 2, 0.0).sum(axis=1) / (n - 1))
        least, most = np.nanmin(seen, axis=1), np.nanmax(seen, axis=1)
        sd = np.where(least == most, 0.0, sd)  # equal values have no deviation, however their sum is rounded
        z = np.where((n >= 2) & (sd > 0), (x - mean) / sd, np.nan)
        near = 1e-9 * np.fmax(np.fmax(np.abs(x), np.fmax(np.abs(least), np.abs(most))), 1e-12)[:, None]
        rank = 0.5 * ((seen < x[:, None] - near) | (seen <= x[:, None] + near)).sum(axis=1) + 0.5 * (seen < x[:, None] - near).sum(axis=1)
        pct = np.where(np.isnan(x), np.nan, np.where(n > 0, rank / n, 0.5))
        return {"samples": n.astype(float), "mean": mean, "sd": sd, "median": np.nanmedian(seen, axis=1), "z": z, "pct": pct}


def momentum_z(bars: DataFrame, h: int, lookback: int = 120, span: int | None = None) -> DataFrame:
    """Adds return_pct, z, pct, samples and label of the h-bar return against those of the `lookback` bars before it."""

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        before = shifted(x["close"], h)
        with np.errstate(all="ignore"):
            r = np.where(before > 0, x["close"] / before - 1, np.nan)
        return {"return_pct": r * 100} | {k: v for k, v in _against_history(r, lookback).items() if k in ("z", "pct", "samples")}

    rows = scan(bars, ["close"], ["return_pct", "z", "pct", "samples"], h + lookback, step, span)
    return rows.withColumns({"label": z_label(F.col("z")), "return_pct": F.round("return_pct", 4), "z": F.round("z", 3), "pct": F.round("pct", 3), "samples": F.col("samples").cast("int")})


def volatility_state(bars: DataFrame, window: int = 24, lookback: int = 120, ppy: float = 8760.0, span: int | None = None) -> DataFrame:
    """Adds vol (annualised), median, pct (tolerant midrank among the estimates before), z, vol_of_vol, samples and regime."""

    def step(first: bool, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        before = shifted(x["close"], 1)
        with np.errstate(all="ignore"):
            r = np.where((x["close"] > 0) & (before > 0), np.log(x["close"] / before), np.nan)
        last = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), r]), window)
        vol = np.where(np.isnan(last).any(axis=1), np.nan, last.std(axis=1, ddof=1) * ppy**0.5)
        h = _against_history(vol, lookback)
        known = ~np.isnan(vol)
        with np.errstate(all="ignore"):
            spread = np.where((h["samples"] >= 2) & (h["mean"] > 0), h["sd"] / h["mean"], 0.0)
        return {"vol": vol, "pct": h["pct"], "z": h["z"]} | {k: np.where(known, v, np.nan) for k, v in (("median", h["median"]), ("vol_of_vol", spread), ("samples", h["samples"]))}

    rows = scan(bars, ["close"], ["vol", "pct", "z", "median", "vol_of_vol", "samples"], window + lookback, step, span)
    regime = F.when(F.col("vol").isNotNull(), F.when(F.col("samples") == 0, "insufficient_history").otherwise(volatility_label(F.col("pct"))))
    return rows.withColumns({"regime": regime, "pct": F.round("pct", 3), "z": F.round("z", 3), "vol_of_vol": F.round("vol_of_vol", 3), "samples": F.col("samples").cast("int")})


def funding_summary(rates: DataFrame, by: list[str], order: list[str], intervals: int = 3 * 365) -> DataFrame:
    """(by..., samples, rate, annual_pct, median, z, pct, regime): each group's newest rate against all before it.

    Plain aggregations, so a group of any size is combined before it is exchanged.
    """
    at = F.struct(*order)
    newest = rates.groupBy(*by).agg(F.max(at).alias("_top"), F.max_by("rate", at).alias("rate"))
    both = rates.withColumn("_at", at).withColumnRenamed("rate", "_rate").join(newest, by)
    past = F.when(F.col("_at") < F.col("_top"), F.col("_rate"))
    rows = both.withColumn("past", past)
    facts = rows.groupBy(*by, "rate").agg(
        F.count("past").alias("samples"), F.percentile("past", F.lit(0.5)).alias("median"), F.avg("past").alias("_mean"), F.stddev_samp("past").alias("_sd"),
        F.greatest(F.abs(F.first("rate")), F.coalesce(F.max(F.abs("past")), F.lit(0.0)), F.lit(1e-12)).alias("_scale"),
    )
    near = F.abs(F.col("past") - F.col("rate")) <= F.col("_scale") * 1e-9
    below = rows.join(facts.select(*by, "_scale"), by).groupBy(*by).agg(F.sum(F.when(near, 0.5).when(F.col("past") < F.col("rate"), 1.0).otherwise(0.0)).alias("_below"))
    z = F.when(F.col("samples") >= 2, F.try_divide(F.col("rate") - F.col("_mean"), F.nullif(F.col("_sd"), F.lit(0.0))))
    pct = F.coalesce(F.try_divide("_below", "samples"), F.lit(0.5))
    return facts.join(below, by).select(
        *by, "samples", F.round("rate", 8).alias("rate"), F.round(F.col("rate") * intervals * 100, 3).alias("annual_pct"), F.round("median", 8).alias("median"), F.round(z, 3).alias("z"),
        F.round(pct, 3).alias("pct"), F.when(F.col("samples") == 0, "insufficient_history").otherwise(funding_label(pct)).alias("regime"),
    )
