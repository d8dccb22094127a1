"""The N best items of every group, in two salted stages.

A group of any size is spread over `salts` subgroups by a hash of the item's identifier; every
subgroup ranks its own rows and keeps N, and the survivors (at most salts x N of a group) are
ranked again. No task ever holds more than one subgroup, and a group of a handful of rows costs
nothing extra beyond the second, small exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, score: Column | str, item: str, n: int, *, salts: int = 64) -> DataFrame:
    """Rows (group, item, score, rank) of the n items of highest score in each group.

    Ties of the score go to the smaller identifier. A row whose group, item or score is null, or
    whose score is NaN, takes no part. An item that occurs several times in a group counts once,
    with its highest score. A group of fewer than n items gives what it has; an empty table gives
    an empty result. Other columns, whatever their names, are not read. Needs n >= 1, salts >= 1.

    The group column comes back under its own name, as do item and score ("score" for a
    Column); a score or item called "rank" is refused, as is one name used twice.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    score_name = score if isinstance(score, str) else "score"
    value = F.col(score) if isinstance(score, str) else score
    if len({group, item, score_name, "rank"}) < 4:
        raise ValueError("group, item, score and 'rank' must be four different names")
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), value.cast("double").alias("_s"))
    rows = rows.filter(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("_i"), F.lit(salts)))
    # Copies of an item share its hash, so removing them and ranking both stay inside the
    # partitioning by (group, subgroup): one exchange carries the table, the next the survivors.
    spread = rows.repartition("_g", "_h")
    once = spread.groupBy("_g", "_h", "_i").agg(F.max("_s").alias("_s"))
    order = [F.col("_s").desc(), F.col("_i").asc()]
    first = once.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_h").orderBy(*order))).filter(F.col("_r") <= n)
    final = first.withColumn("rank", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return final.filter(F.col("rank") <= n).select(
        F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score_name), "rank"
    )
