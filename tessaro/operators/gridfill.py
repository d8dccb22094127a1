"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

The grid of a source is stated by its runs. Readings are bucketed to the minute by an
aggregation; the series of a run is embedded as a Hankel matrix of lagged copies, its leading
singular vectors rebuild it, missing entries are replaced by what was rebuilt, and so on until
they no longer move. Filled periods are marked. A long run is worked in stretches that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import whole_cells

MINUTE = 60_000_000
#: Minutes of a stretch, of its overlap, lags of the embedding, singular vectors.
STRETCH, OVERLAP, LAGS, VECTORS = 720, 60, 24, 3
#: A guard against a series that never settles; what is left by it is marked. Series of the test data settle within some 400.
ITERATIONS = 5_000
#: How missing values came to be filled, the best first.
NOTHING, SETTLED, LINE, UNSETTLED = 0, 1, 2, 3


def impute(x: np.ndarray, *, lags: int = LAGS, vectors: int = VECTORS, iterations: int = ITERATIONS, tolerance: float = 1e-3) -> tuple[np.ndarray, int]:
    """x with its NaN replaced, and how; all NaN if it holds no number at all. A series too short to embed is filled by lines.

    Values far from the median of their neighbours don't shape the fill, but stay in the result.
    """
    missing = np.isnan(x)
    n, known = len(x), np.flatnonzero(~missing)
    if not len(known) or not missing.any():
        return x.copy(), NOTHING
    if len(known) > 8:
        near = np.lib.stride_tricks.sliding_window_view(np.pad(x[known], 3, mode="edge"), 7)
        off = np.abs(x[known] - np.median(near, axis=1))
        known = known[off <= 12 * (1.4826 * np.median(off) + 1e-12) + 1e-9] if (off > 0).any() else known
    y = np.interp(np.arange(n), known, x[known])
    use = np.ones(n, bool)
    use[known] = False
    lags = min(lags, n // 3)
    if lags < 2 or len(known) < 4:
        return np.where(missing, y, x), LINE
    mean = y[known].mean()
    y = y - mean
    spread = max(y[known].std(), 1e-12)
    counts, how = np.convolve(np.ones(lags), np.ones(n - lags + 1)), UNSETTLED
    for _ in range(iterations):
        hankel = np.lib.stride_tricks.sliding_window_view(y, lags)
        _, axes = np.linalg.eigh(hankel.T @ hankel)
        axes = axes[:, -vectors:]
        scores = hankel @ axes
        # Averaging the anti-diagonals of the rebuilt matrix is a sum of convolutions.
        rebuilt = sum(np.convolve(scores[:, k], axes[:, k]) for k in range(axes.shape[1])) / counts
        moved = np.abs(rebuilt[use] - y[use]).max()
        y[use] = rebuilt[use]
        if moved <= tolerance * spread:
            how = SETTLED
            break
    return np.where(missing, y + mean, x), how


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, cuts in whole_cells(batches):
        close, volume = rows["close"].to_numpy(float), rows["volume"].to_numpy(float)
        with np.errstate(all="ignore"):
            price = np.log(np.where(close > 0, close, np.nan))
            size = np.log1p(np.where(volume >= 0, volume, np.nan))
        how = np.zeros((2, len(rows)), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            for k, x in enumerate((price, size)):
                x[a:b], how[k, a:b] = impute(x[a:b])
        out = rows.drop(columns=["cell", "close", "volume", "own"])
        out["close"] = np.where(np.isnan(close), np.exp(price), close)
        out["volume"] = np.where(np.isnan(volume), np.maximum(np.expm1(size), 0.0), volume)
        out["close_filled"] = np.isnan(close) & ~np.isnan(price)
        out["volume_filled"] = np.isnan(volume) & ~np.isnan(size)
        out["how"] = np.maximum(np.where(out["close_filled"], how[0], NOTHING), np.where(out["volume_filled"], how[1], NOTHING))
        yield out[rows["own"].to_numpy(bool)]


def regular_grid(bars: DataFrame, runs: DataFrame, source: list[str]) -> DataFrame:
    """One row per source and minute of its runs: (source..., minute, close, volume, absent, close_filled, volume_filled, fill).

    bars: source, bar_id, timestamp, open, high, low, close, volume, ingested_at; runs: source,
    started_at (inclusive), ended_at (exclusive). A minute is absent if no bar whose four prices
    are all neither null nor NaN is stamped within it; of several such bars the one ingested last
    counts (then the larger bar_id). Its close is filled, and so is a volume that is null or NaN,
    marked as such; fill says how: ssa, line (too few readings to embed) or unsettled (the guard
    ended it), the less good of both. A stretch without a single reading stays null. Runs that repeat or overlap
    give each minute once; a run whose end isn't after its start, or with a null in its key or
    times, gives none, nor do bars outside every run or with a null key or time. Empty runs give
    an empty result. A column of the source may have any name; further columns are not read.
    """
    key = [f"k{i}" for i in range(len(source))]
    named = lambda df: [F.col(c).cast("string").alias(k) for c, k in zip(source, key)]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    floor = lambda us: F.floor(us / MINUTE)
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    whole = fine("open") & fine("high") & fine("low") & fine("close")
    reading = bars.filter(whole).select(
        *named(bars), floor(micros("timestamp")).alias("minute"), F.struct(F.coalesce(micros("ingested_at"), F.lit(0)).alias("came"), F.coalesce("bar_id", F.lit(0)).alias("bar_id")).alias("turn"),
        F.struct(F.col("close").cast("double").alias("close"), F.nanvl(F.col("volume").cast("double"), F.lit(None)).alias("volume")).alias("x"),
    ).dropna(subset=[*key, "minute"])
    reading = reading.groupBy(*key, "minute").agg(F.max_by("x", "turn").alias("x"))
    # A run is cut into stretches before its minutes are written out, so no array is long.
    span = runs.select(*named(runs), F.ceil(micros("started_at") / MINUTE).alias("first"), F.ceil(micros("ended_at") / MINUTE).alias("end")).dropna().distinct().filter("end > first")
    # Runs that overlap or touch become one; a source's runs are few against its readings.
    order = Window.partitionBy(*key).orderBy("first", "end")
    span = span.withColumn("new", (F.col("first") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 62)))).cast("int"))
    span = span.withColumn("run", F.sum("new").over(order)).groupBy(*key, "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    pieces = span.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - F.col("first") - 1) / STRETCH))))
    own_first = F.col("first") + F.col("piece") * STRETCH
    own_end = F.least(own_first + STRETCH, "end")
    minutes = pieces.select(
        *key, F.xxhash64(*key, "first", "end", "piece").alias("cell"), own_first.alias("own_first"), own_end.alias("own_end"),
        F.explode(F.sequence(F.greatest(own_first - OVERLAP, "first"), F.least(own_end + OVERLAP, "end") - 1)).alias("minute"),
    )
    grid = minutes.join(reading, [*key, "minute"], "left").select(
        "cell", *key, "minute", F.col("minute").alias("us"), F.col("x").isNull().alias("absent"), "x.close", "x.volume",
        ((F.col("minute") >= F.col("own_first")) & (F.col("minute") < F.col("own_end"))).alias("own"),
    )
    placed = grid.repartition("cell").sortWithinPartitions("cell", "us").drop("minute")
    fields = "".join(f"{k} string, " for k in key)
    filled = placed.mapInPandas(_fill, f"{fields}us bigint, absent boolean, close double, volume double, close_filled boolean, volume_filled boolean, how bigint")
    out = filled.select(
        *(F.col(k).alias(c) for k, c in zip(key, source)), F.timestamp_seconds(F.col("us") * 60).alias("minute"),
        *(_number(c).alias(c) for c in ("close", "volume")), "absent", "close_filled", "volume_filled", F.get(F.array(*map(F.lit, (None, "ssa", "line", "unsettled"))), F.col("how").cast("int")).alias("fill"),
    )
    return out


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))
