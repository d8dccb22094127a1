"""Implausible readings of bars: control charts per source, run-length counters, physical limits.

Each source is held against itself. A robust exponentially weighted chart follows its level and
its bar-to-bar scale; a value beyond the limits is clipped before it moves either, and a
run-length counter tells what it was: back within the limits after at most three bars, a spike;
still beyond them at the fourth, a lasting move, to which the level is set. Repeats are counted
likewise. Physical limits need no history.

A source is charted in stretches of time that overlap by a warm-up, so one that holds a third of
all rows is spread like any other. What a stretch needs to know of the whole source (its usual
scale, how often it repeats itself by nature) is aggregated before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import whole_cells

FIELDS = ("open", "high", "low", "close", "volume")
#: Limits in units of the usual bar-to-bar change, and the weights of a new value.
PRICE_LIMIT, VOLUME_LIMIT, LEVEL_WEIGHT, SCALE_WEIGHT = 14.0, 7.5, 0.5, 0.05
#: Most bars of a spike; repeats that make a series; share of repeats from which repeating is natural.
SPIKE_BARS, STUCK_REPEATS, NATURAL_SHARE = 3, 5, 0.12
#: A suspected value counts as this many scales off; deliveries that were replaced are judged with so many bars on either side.
CLIP, AROUND = 3.0, 128
STRETCH_US, WARM_UP_US, GAP_US = 6 * 3600 * 1_000_000, 90 * 60 * 1_000_000, 30 * 60 * 1_000_000


def impossible() -> Column:
    """The bar contradicts itself; null and NaN readings take no part in any comparison."""
    x = {c: F.when(~F.isnan(c), F.col(c)) for c in FIELDS}
    o, h, lo, c, v = (x[f] for f in FIELDS)
    parts = [h < lo, h < o, h < c, lo > o, lo > c, o <= 0, h <= 0, lo <= 0, c <= 0, v < 0]
    out = F.lit(False)
    for part in parts:
        out = out | F.coalesce(part, F.lit(False))
    return out


def chart(x: np.ndarray, usual: float, limit: float, weight: float = LEVEL_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, scale, spike) along x, a log series where NaN is missing.

    level and scale are what the chart expected at each place; spike marks runs of at most
    SPIKE_BARS values beyond the limits, after which the series is back.
    """
    n = len(x)
    level, scale, spike = np.empty(n), np.empty(n), np.zeros(n, bool)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return np.full(n, np.nan), np.full(n, usual), spike
    m, s, held, up = float(np.median(x[known[:7]])), usual, [], False
    for i, value in enumerate(x.tolist()):
        level[i], scale[i] = m, s
        if value != value:
            continue
        error = value - m
        if abs(error) > limit * s:
            if held and (error > 0) != up:
                spike[held] = True  # beyond the limits on the other side: the former run is over
                held = []
            up = error > 0
            held.append(i)
            m += weight * math.copysign(CLIP * s, error)
            s += SCALE_WEIGHT * (CLIP - 1) * s
            if len(held) > SPIKE_BARS:
                m, held = float(np.median(x[held])), []
            continue
        if held:
            spike[held] = True
            held = []
        m += weight * error
        s = max(0.5 * usual, s + SCALE_WEIGHT * (min(abs(error), CLIP * s) - s))
    if held:
        spike[held] = True
    return level, scale, spike


def _two_sided(x: np.ndarray, usual: float, limit: float, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Charts along and against time: a value is a spike if both say so."""
    before, s1, a = chart(x, usual, limit, weight)
    after, s2, b = (y[::-1] for y in chart(x[::-1], usual, limit, weight))
    return before, after, np.maximum(s1, s2), a & b


def _held_runs(beyond: np.ndarray) -> np.ndarray:
    """The runs of at most SPIKE_BARS true values."""
    out, i, n = np.zeros(len(beyond), bool), 0, len(beyond)
    while i < n:
        if beyond[i]:
            j = i
            while j < n and beyond[j]:
                j += 1
            if j - i <= SPIKE_BARS:
                out[i:j] = True
            i = j
        else:
            i += 1
    return out


def spiked(rows: dict[str, np.ndarray], price_scale: float, volume_scale: float) -> np.ndarray:
    """Which rows of one unbroken stretch, in order, hold a spike."""
    with np.errstate(all="ignore"):
        log = {f: np.log(np.where(rows[f] > 0, rows[f], np.nan)) for f in FIELDS}
    bad = rows["bad"]
    close = np.where(bad, np.nan, log["close"])
    before, after, scale, spike = _two_sided(close, price_scale, PRICE_LIMIT, LEVEL_WEIGHT)
    good = np.where(spike, np.nan, close)
    # The open stands for the level before a gap; where the whole bar is off, its close says so.
    top = np.fmax(np.fmax(before, after), np.fmax(good, log["open"]))
    low = np.fmin(np.fmin(before, after), np.fmin(good, log["open"]))
    with np.errstate(invalid="ignore"):
        over = ~bad & (log["high"] - top > PRICE_LIMIT * scale)
        under = ~bad & (low - log["low"] > PRICE_LIMIT * scale)
    # High and low are charted themselves too: their level is that of their own former bars.
    high, lower = (_two_sided(np.where(bad, np.nan, log[f]), price_scale, PRICE_LIMIT, LEVEL_WEIGHT)[3] for f in ("high", "low"))
    _, _, _, loud = _two_sided(log["volume"], volume_scale, VOLUME_LIMIT, 0.3)
    return spike | (_held_runs(over) & high) | (_held_runs(under) & lower) | loud


def repeats(rows: dict[str, np.ndarray], fields: list[str]) -> np.ndarray:
    """Which rows are part of a series of STUCK_REPEATS or more repeats of all the fields, without its first."""
    x = np.column_stack([rows[f] for f in fields])
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]).all(axis=1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    for start, end in zip(edges[::2], edges[1::2]):
        if end - start < STUCK_REPEATS:
            same[start:end] = False
    return same


def _judge(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spikes and stuck readings among one source's rows of one stretch, in order."""
    n = len(rows["us"])
    spike, stuck = np.zeros(n, bool), np.zeros(n, bool)
    newest = rows["newest"]
    # The newest delivery of each stamp makes the chart; an earlier one is judged in its place.
    slots = {f: rows[f][newest] for f in ("us", "bad", *FIELDS)}

    def judge(table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ends = [0, *(np.flatnonzero(np.diff(table["us"]) > GAP_US) + 1), len(table["us"])]
        out = [spiked({f: x[a:b] for f, x in table.items()}, rows["price_scale"][0], rows["volume_scale"][0]) for a, b in zip(ends, ends[1:])]
        kept = np.zeros(len(table["us"]), bool)
        if rows["price_moves"][0]:
            kept |= repeats(table, ["high", "low", "close"])
        if rows["volume_moves"][0]:
            kept |= repeats(table, ["volume"]) & (table["volume"] != 0)
        return np.concatenate(out), kept

    spike[newest], stuck[newest] = judge(slots)
    older = np.flatnonzero(~newest)
    if len(older):
        # A stamp's newest delivery is in the same stretch: both are cut by the stamp.
        at = np.searchsorted(slots["us"], rows["us"]) if (np.diff(slots["us"]) >= 0).all() else np.array([{us: i for i, us in enumerate(slots["us"].tolist())}[us] for us in rows["us"].tolist()])
        # One look per rank of delivery, at its surroundings only.
        for turn in np.unique(rows["turn"][older]):
            mine = older[rows["turn"][older] == turn]
            mine = mine[np.argsort(at[mine], kind="stable")]
            for group in np.split(mine, np.flatnonzero(np.diff(at[mine]) > 2 * AROUND) + 1):
                first, last = max(0, at[group[0]] - AROUND), at[group[-1]] + AROUND + 1
                variant = {f: x[first:last].copy() for f, x in slots.items()}
                for f in ("bad", *FIELDS):
                    variant[f][at[group] - first] = rows[f][group]
                a, b = judge(variant)
                spike[group], stuck[group] = a[at[group] - first], b[at[group] - first]
    return spike, stuck


def _judge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, cuts in whole_cells(batches):
        table = {c: rows[c].to_numpy() for c in rows.columns if c != "cell"}
        parts = [_judge({c: x[a:b] for c, x in table.items()}) for a, b in zip(cuts, cuts[1:])]
        out = pd.DataFrame({"bar_id": table["bar_id"], "impossible": table["bad"], "spike": np.concatenate([p[0] for p in parts]), "stuck": np.concatenate([p[1] for p in parts])})
        yield out[table["own"]]


def flag_readings(bars: DataFrame, source: list[str]) -> DataFrame:
    """One row per bar_id: (bar_id, impossible, spike, stuck).

    bars needs the source's columns, bar_id, timestamp, open, high, low, close, volume and
    ingested_at; further columns are not read. Copies of a bar_id count once. Bars of a source
    run by minute and, within it, by first delivery; several deliveries of a stamp are each judged
    in that place, and the latest makes the chart. Null and NaN readings are missing: never a
    case, nor a break of a chart, but a break of a series of repeats. A bar without bar_id gives
    no row; one without timestamp or source is held against the physical limits only. A source
    that never moves, or has a single bar, has no spikes. An empty table gives an empty result.
    """
    key = [f"k{i}" for i in range(len(source))]
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = bars.select(
        *(F.col(c).cast("string").alias(k) for c, k in zip(source, key)), "bar_id", us.alias("us"),
        *(F.col(f).cast("double").alias(f) for f in FIELDS), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("came"),
    ).filter("bar_id IS NOT NULL").dropDuplicates(["bar_id"])
    rows = rows.withColumn("bad", impossible())
    usable = rows.dropna(subset=[*key, "us"])
    # Deliveries of one stamp share their stretch, so one exchange serves this window and the next.
    usable = usable.withColumn("stretch", F.floor(F.col("us") / STRETCH_US)).repartition(*key, "stretch")
    stamp = Window.partitionBy(*key, "stretch", "us")
    turn = F.row_number().over(stamp.orderBy(F.col("came").asc_nulls_first(), "bar_id"))
    usable = usable.withColumns({"turn": turn, "place": F.min("bar_id").over(stamp), "last": F.count("*").over(stamp)})
    usable = usable.withColumn("newest", F.col("turn") == F.col("last")).drop("last").withColumn("minute", F.floor(F.col("us") / 60_000_000))
    # The source's own usual behaviour, over all its bars: changes from bar to bar within stretches.
    along = Window.partitionBy(*key, "stretch").orderBy("minute", "place", "bar_id")
    log = lambda c: F.when(~F.col("bad") & (F.col(c) > 0) & ~F.isnan(c), F.ln(c))
    step = usable.filter("newest").select(
        *key, F.abs(log("close") - F.lag(log("close")).over(along)).alias("dp"), F.abs(log("volume") - F.lag(log("volume")).over(along)).alias("dv"),
        *((F.col(f) == F.lag(f).over(along)).alias(f"same_{f}") for f in ("high", "low", "close", "volume")), (F.col("volume") != 0).alias("traded"),
    )
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    usual = step.groupBy(*key).agg(
        F.percentile_approx("dp", F.array(F.lit(0.5), F.lit(0.9)), 1000).alias("p"), F.percentile_approx("dv", F.array(F.lit(0.5), F.lit(0.9)), 1000).alias("v"),
        share(F.col("same_high") & F.col("same_low") & F.col("same_close")).alias("still"), F.coalesce(F.avg(F.when(F.col("traded"), F.coalesce("same_volume", F.lit(False)).cast("double"))), F.lit(0.0)).alias("still_volume"),
        F.percentile_approx(F.when(F.col("dp") > 0, F.col("dp")), 0.1, 1000).alias("least"),
    )
    scale = lambda c, k: F.greatest(F.get(c, F.lit(0)) / 0.6745 * 0.8, F.get(c, F.lit(1)) / 1.645 * 0.8, k)
    usual = usual.select(
        *key, F.coalesce(scale("p", F.coalesce("least", F.lit(0.0))), F.lit(math.inf)).alias("price_scale"), F.coalesce(F.greatest(scale("v", F.lit(0.0)), F.lit(0.1)), F.lit(math.inf)).alias("volume_scale"),
        (F.col("still") < NATURAL_SHARE).alias("price_moves"), (F.col("still_volume") < NATURAL_SHARE).alias("volume_moves"),
    )
    usual = usual.withColumn("price_scale", F.when(F.col("price_scale") > 0, F.col("price_scale")).otherwise(F.lit(math.inf)))
    # A stretch takes the bars of its neighbours' edges along as warm-up.
    first, last = F.floor((F.col("us") - WARM_UP_US) / STRETCH_US), F.floor((F.col("us") + WARM_UP_US) / STRETCH_US)
    charted = usable.join(usual, key).withColumn("at", F.explode(F.sequence(first, last))).withColumn("own", F.col("at") == F.col("stretch"))
    charted = charted.withColumn("cell", F.xxhash64(*key, "at")).repartition("cell").sortWithinPartitions(*key, "at", "minute", "place", "bar_id")
    needed = ["cell", "bar_id", "us", "turn", "newest", "own", "bad", *FIELDS, "price_scale", "volume_scale", "price_moves", "volume_moves"]
    judged = charted.select(*needed).mapInPandas(_judge_sorted, "bar_id bigint, impossible boolean, spike boolean, stuck boolean")
    never = F.lit(False)
    outside = rows.filter(F.col("us").isNull() | F.array_contains(F.array(*(F.col(k).isNull() for k in key)), True))
    return judged.unionByName(outside.select("bar_id", F.col("bad").alias("impossible"), never.alias("spike"), never.alias("stuck")))
