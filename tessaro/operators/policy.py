"""Signals as columns: states to actions, the momentum baseline, symbol names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stretches import along, frame, in_stretches

#: Action by state at high, middle and low confidence.
STRONG, FAIR, LEGACY_SMALL = 0.70, 0.50, 0.60
TABLE = {
    "trend_up": ("target_weight_100", "target_weight_60", "maintain"),
    "trend_down": ("flat_position", "target_weight_20", "maintain"),
    "range_bound": ("target_weight_30", "target_weight_30", "maintain"),
    "high_volatility_event": ("halve_position", "halve_position", "maintain"),
}
LEGACY = {
    "late_bull_reduce": ("reduce_25_percent", "reduce_10_percent", "stop_adding"),
    "trend_continuation_hold": ("hold", "hold", "hold"),
    "uncertain_need_more_info": ("hold", "hold", "hold"),
}


def action(regime: Column, confidence: Column) -> Column:
    """The action of a state at a confidence; an unknown state is maintained."""
    out = F.when((regime == "deep_bear_reaccumulate") & (confidence >= LEGACY_SMALL), "reaccumulate_small").when(regime == "deep_bear_reaccumulate", "hold")
    for state, (strong, fair, weak) in (TABLE | LEGACY).items():
        out = out.when(regime == state, F.when(confidence >= STRONG, strong).when(confidence >= FAIR, fair).otherwise(weak))
    return out.otherwise("maintain")


def action_sql(regime: str, confidence: str) -> str:
    cases = " ".join(f"WHEN {regime} = '{s}' THEN CASE WHEN {confidence} >= 0.7 THEN '{a}' WHEN {confidence} >= 0.5 THEN '{b}' ELSE '{c}' END" for s, (a, b, c) in (TABLE | LEGACY).items())
    return f"CASE {cases} WHEN {regime} = 'deep_bear_reaccumulate' THEN CASE WHEN {confidence} >= 0.6 THEN 'reaccumulate_small' ELSE 'hold' END ELSE 'maintain' END"


_LEVELS = (0.3, 0.5, 0.55, 0.6, 0.65, 0.7, 0.9)


def grid(spark: SparkSession, legacy: bool = False) -> DataFrame:
    """Every state at a range of confidences."""
    states = [*LEGACY, "deep_bear_reaccumulate"] if legacy else [*TABLE, "uncertain", "unheard_of"]
    rows = spark.createDataFrame([(s, c) for s in states for c in _LEVELS], "regime string, confidence double")
    return rows.withColumn("action", action(F.col("regime"), F.col("confidence")))


def _grid_sql(*rows: tuple[str, ...]) -> str:
    """The expected table written out: state, then the action at each confidence."""
    values = ", ".join(f"('{r[0]}', {c}, '{a}')" for r in rows for c, a in zip(_LEVELS, r[1:]))
    return f"SELECT regime, CAST(confidence AS DOUBLE) AS confidence, action FROM (VALUES {values}) AS t(regime, confidence, action)"


GRID_SQL = _grid_sql(
    ("trend_up", "maintain", *["target_weight_60"] * 4, *["target_weight_100"] * 2), ("trend_down", "maintain", *["target_weight_20"] * 4, *["flat_position"] * 2),
    ("range_bound", "maintain", *["target_weight_30"] * 6), ("high_volatility_event", "maintain", *["halve_position"] * 6), ("uncertain", *["maintain"] * 7), ("unheard_of", *["maintain"] * 7),
)
LEGACY_SQL = _grid_sql(
    ("late_bull_reduce", "stop_adding", *["reduce_10_percent"] * 4, *["reduce_25_percent"] * 2), ("trend_continuation_hold", *["hold"] * 7),
    ("uncertain_need_more_info", *["hold"] * 7), ("deep_bear_reaccumulate", *["hold"] * 3, *["reaccumulate_small"] * 4),
)


def canonical_symbol(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[-_/]", ""), "(USDT|USDC)$", "USD")


def momentum_signal(bars: DataFrame, short: int = 20, long: int = 80, hot: float = 75.0, cold: float = 25.0, period: int = 14) -> DataFrame:
    """(product_id, bar_idx, regime, confidence) from two plain means and a plain-mean strength index."""
    def make(df: DataFrame) -> DataFrame:
        df = df.withColumn("dx", F.col("close") - F.lag("close").over(along()))
        up, down = (F.sum(F.greatest(e, F.lit(0.0))).over(frame(period)) for e in (F.col("dx"), -F.col("dx")))
        rsi = F.when(down == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down)))
        return df.withColumns({"rsi": rsi, "a": F.avg("close").over(frame(short)), "b": F.avg("close").over(frame(long))})

    rows = in_stretches(bars.select("product_id", "bar_idx", "close"), max(long, period + 1), make)
    r, a, b, c = (F.col(x) for x in ("rsi", "a", "b", "close"))
    early = F.col("bar_idx") < long
    regime = F.when(early, "uncertain").when(r >= hot, "high_volatility_event").when((r <= cold) & (c < b), "range_bound").when(a > b, "trend_up").when(a < b, "trend_down").otherwise("uncertain")
    confidence = (
        F.when(early, 0.3).when(r >= hot, F.least(F.lit(0.95), 0.6 + (r - hot) / 100)).when((r <= cold) & (c < b), F.least(F.lit(0.95), 0.6 + (cold - r) / 100))
        .when(a > b, 0.7).when(a < b, 0.6).otherwise(0.4)
    )
    return rows.select("product_id", "bar_idx", regime.alias("regime"), F.round(confidence, 5).alias("confidence"))
