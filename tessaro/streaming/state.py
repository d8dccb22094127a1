"""What follows a stream with a state per product: the last written row, a running volatility, runs that fire once.

State lives in the query's checkpoint, so a stopped query goes on where it was. A product's state
is a few numbers; its rows must arrive in order of time from batch to batch, within a batch in any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_last_written(rows: DataFrame, written: str, lateness: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Of the rows of a product and stamp the one that is last by `written`, once the watermark has passed its minute.

    A built-in aggregation: only the best row of each open stamp is held. Columns product_id and
    ts name the key; all others come along.
    """
    others = [c for c in rows.columns if c not in ("product_id", "ts")]
    kept = rows.withWatermark("ts", lateness).groupBy("product_id", F.window("ts", every).alias("_w"), F.unix_micros("ts").alias("_us")).agg(F.max_by(F.struct(*others), written).alias("x"))
    return kept.select("product_id", F.timestamp_micros("_us").alias("ts"), "x.*")


def streamed_volatility(bars: DataFrame, com: float, ppy: float, seed: int = 20) -> DataFrame:
    """(product_id, ts, vol) of each bar (product_id, ts, close): the seeded exponential volatility of the bars so far.

    The same recursion as functions.recursion.ewma_volatility(), carried from batch to batch.
    """
    lam = com / (com + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, n, v = state.get if state.exists else (None, 0, 0.0)
        out = []
        for ts, close in pd.concat(batches).sort_values("ts", kind="stable")[["ts", "close"]].itertuples(index=False):
            close = None if close is None or close != close else float(close)
            if before is not None and close is not None and before > 0 and close > 0:
                r2 = math.log(close / before) ** 2
                n += 1
                v = v + r2 / seed if n <= seed else lam * v + (1 - lam) * r2
            before = close
            out.append((key[0], ts, math.sqrt(v * ppy) if n > seed else None))
        state.update((before, n, v))
        yield pd.DataFrame(out, columns=["product_id", "ts", "vol"])

    return bars.select("product_id", "ts", "close").groupBy("product_id").applyInPandasWithState(step, "product_id string, ts timestamp, vol double", "before double, n bigint, v double", "append", GroupStateTimeout.NoTimeout)


def streamed_replay(events: DataFrame) -> DataFrame:
    """Which run speaks at which bar: each at the first bar at or after it was made, the newest of several.

    events: (product_id, ts, run_no, regime, confidence), a bar having no run_no. A run waits in
    the state until a bar comes; one that is followed by another before that is never heard.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get if state.exists else None
        rows = pd.concat(batches)
        rows = rows.assign(is_bar=rows["run_no"].isna()).sort_values(["ts", "is_bar", "run_no"], kind="stable")
        out = []
        for ts, run_no, regime, confidence, is_bar in rows[["ts", "run_no", "regime", "confidence", "is_bar"]].itertuples(index=False):
            if not is_bar:
                waiting = (int(run_no), regime, float(confidence))
            elif waiting:
                out.append((key[0], ts, *waiting))
                waiting = None
        if waiting:
            state.update(waiting)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["product_id", "ts", "run_no", "regime", "confidence"])

    columns = events.select("product_id", "ts", F.col("run_no").cast("double").alias("run_no"), "regime", "confidence")
    return columns.groupBy("product_id").applyInPandasWithState(
        step, "product_id string, ts timestamp, run_no bigint, regime string, confidence double", "run_no bigint, regime string, confidence double", "append", GroupStateTimeout.NoTimeout
    )
