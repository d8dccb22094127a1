"""The subpackage's queries and, where SQL can state the result, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encode import decode, encode, vocabulary_file
from .mojibake import restore
from .neartime import replay_nearest, tagged
from .packing import pack, token_sizes
from .topn import top_n_per_group

SCORED = ("noise", "redundant", "unstable", "candidate")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best scored expressions of each family."""
    scored = table(spark, d, "archive_records").filter(F.col("verdict").isin(*SCORED))
    best = top_n_per_group(scored, "family", F.col("insample.abs_ic"), "expr_id", 3)
    return best.select("family", "expr_id")


def readable_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The rows of book_top10 that lie in finished files."""
    done = table(spark, d, "book_files").filter(~F.col("path").endswith(".tmp")).select("file_id")
    return table(spark, d, "book_top10").join(done, "file_id", "left_semi")


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every print that has a time and a product, with its nearest snapshot within two seconds, or null."""
    prints = table(spark, d, "market_trades")
    log = tagged(prints, readable_snapshots(spark, d), ["venue", "product_id"], "ts", "trade_id", "snap_id")
    pairs = replay_nearest(spark, log, 2_000_000)
    return pairs.select(F.col("left_id").alias("trade_id"), F.col("right_id").alias("snap_id"), "gap_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The prints that have a snapshot within two seconds."""
    return p3_nearest(spark, d).filter("snap_id IS NOT NULL").select("trade_id", "snap_id")


VOCABULARY = "byte_bpe_50k"
CAPACITY = 2048


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, d, "documents"), vocabulary_file(VOCABULARY))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document with whether its decoded ids give its text again; a null text comes back empty."""
    back = decode(p7_ids(spark, d), vocabulary_file(VOCABULARY)).withColumnRenamed("text", "back")
    return table(spark, d, "documents").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of a document with its container of 2,048 tokens."""
    sizes = token_sizes(table(spark, d, "documents"), vocabulary_file(VOCABULARY))
    return pack(spark, sizes, CAPACITY)[0]


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the packing comes to: containers, their lower bound, whether it is proven to be the best, and the room unused."""
    sizes = token_sizes(table(spark, d, "documents"), vocabulary_file(VOCABULARY))
    s = pack(spark, sizes, CAPACITY)[1]
    return spark.createDataFrame([(s["containers"], s["lower_bound"], bool(s["proven"]), s["containers"] * s["capacity"] - s["used"])], "containers bigint, lower_bound bigint, proven boolean, unused bigint")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every document with whether it was garbled, its text restored where possible, and the chains that were undone."""
    return restore(spark, table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a sentence that was read with the wrong encoding."""
    return p9_restored(spark, d).filter("garbled").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_containers": p8_containers,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_NEAREST = """
        WITH s AS (
            SELECT venue, product_id, ts, min(snap_id) AS snap_id FROM book_top10
            WHERE ts IS NOT NULL AND file_id IN (SELECT file_id FROM book_files WHERE path NOT LIKE '%.tmp')
            GROUP BY ALL),
        t AS (SELECT DISTINCT venue, product_id, ts, trade_id FROM market_trades WHERE ts IS NOT NULL AND product_id IS NOT NULL),
        b AS (SELECT t.*, s.snap_id AS b_id, epoch_us(t.ts) - epoch_us(s.ts) AS b_gap
              FROM t ASOF LEFT JOIN s ON t.venue = s.venue AND t.product_id = s.product_id AND t.ts >= s.ts),
        a AS (SELECT b.*, s.snap_id AS a_id, epoch_us(s.ts) - epoch_us(b.ts) AS a_gap
              FROM b ASOF LEFT JOIN s ON b.venue = s.venue AND b.product_id = s.product_id AND b.ts < s.ts),
        p AS (SELECT trade_id, CASE WHEN least(b_gap, a_gap) > 2000000 OR (b_gap IS NULL AND a_gap IS NULL) THEN NULL
                     WHEN a_gap IS NULL OR b_gap <= a_gap THEN b_id ELSE a_id END AS snap_id,
                     CASE WHEN least(b_gap, a_gap) <= 2000000 THEN least(b_gap, a_gap) END AS gap_us FROM a)"""

SQL: dict[str, str] = {
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p3_found": _NEAREST + " SELECT trade_id, snap_id FROM p WHERE snap_id IS NOT NULL",
    "p3_nearest": _NEAREST + " SELECT trade_id, snap_id, gap_us FROM p",
    "p2_found": """
        WITH s AS (
            SELECT family, expr_id, max(insample.abs_ic) AS s FROM archive_records
            WHERE verdict IN ('noise', 'redundant', 'unstable', 'candidate') AND family IS NOT NULL
              AND insample.abs_ic IS NOT NULL AND NOT isnan(insample.abs_ic)
            GROUP BY ALL)
        SELECT family, expr_id FROM s
        QUALIFY row_number() OVER (PARTITION BY family ORDER BY s DESC, expr_id) <= 3""",
}
