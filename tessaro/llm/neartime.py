"""Pairing the rows of two tables by nearest time, as a stateful streaming join.

Both sides travel as one tagged log. The state is kept in a fixed number of shards; a shard owns
cells of (entity, stretch of time), chosen by hash, so an entity that holds a third of all rows
is spread over all shards like any other. A shard buffers both sides, emits a left row once the
watermark has passed its tolerance horizon, and evicts right rows that no left row can reach any
more. Within a shard all entities are matched at once on sorted arrays.

A finished table is replayed through the same operator in slices of event time, so that no row
is late; the number of slices follows from the number of rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import Scratch

LEFT, RIGHT, MARK = 0, 1, 2
#: The stretch of time of a cell, and how many rows of an entity it may hold.
CELL_US, CELL_ROWS = 600_000_000, 200_000
LOG = "kind int, entity string, us bigint, left_id string, right_id bigint, at timestamp"
OUT = "left_id string, right_id bigint, gap_us bigint"


def tagged(left: DataFrame, right: DataFrame, by: list[str], time: str, left_id: str, right_id: str) -> DataFrame:
    """The two tables as one log; rows without a time, an identifier or part of the key are left out.

    Only the named columns are read, so further columns of clashing names do no harm.
    """
    # Parts of a key carry their length, so that no two keys can look alike.
    entity = F.concat(*(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")) for c in by))
    when = F.unix_micros(F.col(time).cast("timestamp"))

    def side(df: DataFrame, kind: int, lid, rid) -> DataFrame:  # noqa: ANN001
        return df.select(
            F.lit(kind).alias("kind"), entity.alias("entity"), when.alias("us"), lid.cast("string").alias("left_id"),
            rid.cast("bigint").alias("right_id"), F.col(time).cast("timestamp").alias("at"),
        ).dropna()

    # The other side's identifier is a filler: a null would turn the integers into floats in pandas.
    return side(left, LEFT, F.col(left_id), F.lit(0)).unionByName(side(right, RIGHT, F.lit(""), F.col(right_id)))


def match(left: pd.DataFrame, right: pd.DataFrame, tolerance_us: int) -> pd.DataFrame:
    """For each left row the nearest right row of its entity within the tolerance, else null.

    Equally near: the one before. One stamp: the smallest right identifier.
    """
    right = right.sort_values(["entity", "us", "right_id"], kind="stable").drop_duplicates(["entity", "us"])
    n, m = len(left), len(right)
    codes = pd.factorize(np.concatenate([left["entity"].to_numpy(object), right["entity"].to_numpy(object)]))[0]
    us = np.concatenate([left["us"].to_numpy(np.int64), right["us"].to_numpy(np.int64)])
    is_right = np.concatenate([np.zeros(n, bool), np.ones(m, bool)])
    order = np.lexsort((~is_right, us, codes))
    codes, us, is_right = codes[order], us[order], is_right[order]
    place = np.arange(n + m)
    before = np.maximum.accumulate(np.where(is_right, place, -1)) if n + m else place
    after = np.minimum.accumulate(np.where(is_right, place, n + m)[::-1])[::-1] if n + m else place
    rows = np.flatnonzero(~is_right)
    far = np.int64(2**62)

    def gap(at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < n + m)
        safe = np.where(inside, at, 0)
        return np.where(inside & (codes[safe] == codes[rows]), np.abs(us[safe] - us[rows]), far)

    b, a = before[rows], after[rows]
    gap_b, gap_a = gap(b), gap(a)
    best, pick = np.minimum(gap_b, gap_a), np.where(gap_b <= gap_a, b, a)
    found = best <= tolerance_us
    ids = np.concatenate([np.full(n, -1, np.int64), right["right_id"].to_numpy(np.int64)])[order] if n + m else np.empty(0, np.int64)
    got = pd.Series(ids[np.where(found, pick, 0)] if n else np.empty(0, np.int64), dtype="Int64").mask(~found)
    width = pd.Series(best, dtype="Int64").mask(~found)
    return pd.DataFrame({"left_id": left["left_id"].to_numpy(object)[order[rows]], "right_id": got, "gap_us": width})


def nearest_in_time(log: DataFrame, tolerance_us: int, *, lateness: str, shards: int = 64, stretch_us: int = CELL_US) -> DataFrame:
    """Streaming: every left row of the log once, with its nearest right row or null.

    log has the columns of LOG; rows later than `lateness` behind the newest are dropped by the
    watermark. Copies of a left row (same entity, time and identifier) come out once. Rows of
    kind MARK only move the watermark on.
    """
    if tolerance_us < 0 or stretch_us <= 0:
        raise ValueError("the tolerance can't be negative, nor a stretch empty")
    stretch = lambda us: F.floor(us / F.lit(stretch_us)).cast("bigint")
    reach = F.when(F.col("kind") == RIGHT, F.lit(tolerance_us)).otherwise(F.lit(0))
    cells = (
        log.withWatermark("at", lateness)
        # a right row near an end of its stretch is held by the neighbour too
        .withColumn("stretch", F.explode(F.sequence(stretch(F.col("us") - reach), stretch(F.col("us") + reach))))
        .withColumn("shard", F.when(F.col("kind") == MARK, F.lit(0)).otherwise(F.pmod(F.xxhash64("entity", "stretch"), F.lit(shards))).cast("int"))
        .withColumn("entity", F.concat("entity", F.lit("@"), F.col("stretch").cast("string")))
        .select("shard", "kind", "entity", "us", "left_id", "right_id", "at")
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        names = ["kind", "entity", "us", "left_id", "right_id"]
        rows = pd.concat([*held, *(b[names] for b in batches)], ignore_index=True) if not state.hasTimedOut else held[0]
        mark = state.getCurrentWatermarkMs() * 1000
        left, right = rows[rows["kind"] == LEFT], rows[rows["kind"] == RIGHT]
        due = left["us"] + tolerance_us <= mark
        waiting, kept = left[~due], right[right["us"] >= mark - 2 * tolerance_us]
        if len(waiting) or len(kept):
            state.update((pickle.dumps(pd.concat([waiting, kept], ignore_index=True)),))
            horizon = max(waiting["us"].min() + tolerance_us if len(waiting) else 0, kept["us"].max() + 2 * tolerance_us + 1 if len(kept) and not len(waiting) else 0)
            state.setTimeoutTimestamp(int(max(horizon // 1000 + 1, mark // 1000 + 1)))
        elif state.exists:
            state.remove()
        ready = left[due].drop_duplicates(["entity", "us", "left_id"])
        if len(ready):
            yield match(ready, right, tolerance_us)

    return cells.groupBy("shard").applyInPandasWithState(step, OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def replay_nearest(
    spark: SparkSession, log: DataFrame, tolerance_us: int, *, rows_per_slice: int | None = None, shards: int | None = None, stretch_us: int | None = None
) -> DataFrame:
    """The streaming join over a finished log: (left_id, right_id, gap_us), one row per left row.

    The log is written to the shared folder cut into slices of event time of about
    `rows_per_slice` rows (250,000 per core by default), and the slices are handed to the stream
    oldest first; a closing mark lets the watermark pass the last row. An empty log gives an
    empty result.
    """
    scratch = Scratch(spark, "nearest")
    cores = spark.sparkContext.defaultParallelism
    rows_per_slice = rows_per_slice or 250_000 * cores
    shards = shards or 4 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log = scratch.keep(log, "log")
    # One pass tells the rows of each cell of ten minutes and, of all, the number, the end and the quantiles of time.
    cells = log.groupBy("entity", F.floor(F.col("us") / CELL_US).alias("cell")).agg(F.count("*").alias("n"))
    n, hottest = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    if not n:
        return spark.createDataFrame([], OUT)
    # A cell isn't split, so where ten minutes of an entity hold more than CELL_ROWS rows, cells are shorter.
    stretch_us = stretch_us or max(4 * tolerance_us, CELL_US * CELL_ROWS // max(hottest, CELL_ROWS))
    slices = -(-n // rows_per_slice)
    inner = F.percentile_approx("us", F.array(*(F.lit(i / slices) for i in range(1, slices))), 100 * slices) if slices > 1 else F.array().cast("array<bigint>")
    last, cuts = log.agg(F.max("us"), inner).first()
    cuts = sorted({*cuts, last})  # as many as there are slices
    # The rows are arranged by time first, so that a task writes into the one or two slices that its stretch of time meets:
    # as many files as cores in a slice, whatever the number of slices. Each slice then arrives by a rename, without being read.
    bounds = [-math.inf, *map(float, cuts[:-1]), math.inf]  # microseconds are exact as doubles
    arranged = log.repartitionByRange(len(cuts) * cores, "us") if len(cuts) > 1 else log
    numbered = Bucketizer(splits=bounds, inputCol="_us", outputCol="_slice").transform(arranged.withColumn("_us", F.col("us").cast("double"))) if len(cuts) > 1 else log.withColumn("_slice", F.lit(0))
    numbered.select(*log.columns, F.col("_slice").cast("int").alias("slice")).write.partitionBy("slice").parquet(scratch.path("sliced"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(scratch.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop(scratch.path("arrived")))
    for i in range(len(cuts)):
        system.rename(hadoop(scratch.path(f"sliced/slice={i}")), hadoop(scratch.path(f"arrived/s{i}")))
        if i == len(cuts) - 1:
            end = last + 2 * tolerance_us + 10_000_000
            closing = spark.range(1).select(
                F.lit(MARK).alias("kind"), F.lit("end").alias("entity"), F.lit(end).cast("bigint").alias("us"), F.lit("").alias("left_id"),
                F.lit(0).cast("bigint").alias("right_id"), F.timestamp_micros(F.lit(end)).alias("at"),
            )
            closing.write.parquet(scratch.path("arrived/end"))
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(scratch.path("arrived"))
        joined = nearest_in_time(stream, tolerance_us, lateness="0 seconds", shards=shards, stretch_us=stretch_us)
        query = (
            joined.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch.path("progress"))
            .option("path", scratch.path("pairs")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    scratch.drop("log", "sliced")
    return spark.read.schema(OUT).parquet(scratch.path("pairs"))
