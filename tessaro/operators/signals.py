"""What a strategy thinks of each bar, as (product_id, bar_idx, regime, confidence)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import volatility
from . import policy, simulate

#: Fixed value: the states a coin may fall on.
REGIMES = ("trend_up", "trend_down", "range_bound", "high_volatility_event", "uncertain")
NAMES = ("buy_and_hold", "random", "momentum", "institutional", "replay")


def draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(no, regime, confidence) of the first n throws of a seeded coin; one sequence, so one task, a chunk at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random(seed)
        for _ in batches:
            for begin in range(0, n, 10_000):
                thrown = [(i, rng.choice(REGIMES), rng.uniform(0.5, 0.95)) for i in range(begin, min(n, begin + 10_000))]
                yield pd.DataFrame(thrown, columns=["no", "regime", "confidence"])

    return spark.range(1).repartition(1).mapInPandas(run, "no bigint, regime string, confidence double")


def states(bars: DataFrame, name: str, *, every: int = 1, seed: int = 42, ppy: float = 365.0, log: DataFrame | None = None) -> DataFrame:
    """The states of every `every`-th bar by the named signal.

    replay takes a log of decisions as sources.lake.decisions() reads it: of flat rows those of
    exactly a bar's time, of runs (rows with a run) each at the first bar asked after it was made.
    A bar nothing is said of is uncertain.
    """
    if name not in NAMES:
        raise ValueError(f"unknown signal {name!r}")
    asked = bars.filter(F.col("bar_idx") % every == 0).select("product_id", "bar_idx", "ts")
    unsure = asked.select("product_id", "bar_idx", F.lit("uncertain").alias("regime"), F.lit(0.0).alias("confidence"))
    if name == "buy_and_hold":
        return unsure
    if name == "momentum":
        return policy.momentum_signal(bars).filter(F.col("bar_idx") % every == 0)
    if name == "institutional":
        regime, confidence = volatility.trend_state()
        return volatility.trend(bars, ppy).filter(F.col("bar_idx") % every == 0).select("product_id", "bar_idx", regime.alias("regime"), confidence.alias("confidence"))
    if name == "random":
        # Bars in order and, within one, products in order: small, as a portfolio's bars are.
        numbered = asked.withColumn("no", F.row_number().over(Window.orderBy("bar_idx", "product_id")).cast("bigint") - 1)
        return numbered.join(draws(bars.sparkSession, asked.count(), seed), "no").select("product_id", "bar_idx", "regime", "confidence")
    if log is None:
        raise ValueError("a replay needs a log of decisions")
    key = policy.canonical_symbol
    asked = asked.withColumn("_key", key(F.col("product_id")))
    told = log.select(key(F.col("symbol")).alias("_key"), "ts", "regime", "confidence", F.monotonically_increasing_id().alias("run_no"), F.col("is_run"))
    flat = told.filter("NOT is_run").groupBy("_key", "ts").agg(F.max_by(F.struct("regime", "confidence"), "run_no").alias("s"))
    runs = told.filter("is_run").select(F.col("_key").alias("product_id"), F.col("ts").alias("made_at"), "run_no", "regime", "confidence")
    fired = simulate.replay_runs(asked.select(F.col("_key").alias("product_id"), "ts", "bar_idx"), runs)
    fired = fired.select(F.col("product_id").alias("_key"), "bar_idx", F.struct("regime", "confidence").alias("r"))
    out = asked.join(flat, ["_key", "ts"], "left").join(fired, ["_key", "bar_idx"], "left")
    said = F.coalesce("s", "r")
    return out.select("product_id", "bar_idx", F.coalesce(said["regime"], F.lit("uncertain")).alias("regime"), F.coalesce(said["confidence"], F.lit(0.0)).alias("confidence"))
