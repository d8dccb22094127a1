"""The core's pN queries over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import compact
from ..operators.gridfill import regular_grid
from ..operators.hierarchy import descendants, hierarchies, lineages, paths
from ..operators.spikes import flag_readings
from ..session import table


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every bar with what is wrong with it."""
    return flag_readings(table(spark, d, "bars"), ["venue", "product_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The bars that are impossible, a spike or stuck."""
    return p1_flags(spark, d).filter("impossible OR spike OR stuck").select("bar_id")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every expression with its root, depth and interval of descendants along first parents."""
    return hierarchies(spark, _first_parents(spark, d), "expr_id", "parent")


def _first_parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_records").groupBy("expr_id").agg(F.min_by(F.get("parents", F.lit(0)), "line_no").alias("parent"))


def _lineages(spark: SparkSession, d: str) -> DataFrame:
    return lineages(spark, _first_parents(spark, d), p4_hierarchy(spark, d), "expr_id", "parent")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every expression's path from its root, or from the node of a cycle that it hangs on, down to itself."""
    return paths(_lineages(spark, d), "expr_id")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every expression, and how far below it lies."""
    return descendants(_lineages(spark, d), "expr_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every expression; a lineage that never ends has root 'cycle' and depth -1."""
    return p4_hierarchy(spark, d).select("expr_id", F.coalesce("root_id", F.lit("cycle")).alias("root_id"), "depth")


def _compacted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    done = table(spark, d, "book_files").filter(~F.col("path").endswith(".tmp")).select("file_id", "path").distinct()
    book = table(spark, d, "book_top10")
    columns = [c for c in book.columns if c != "file_id"]
    return compact(spark, book.join(done, "file_id"), "path", columns, target_bytes=64 << 20)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots read back from the consolidated files."""
    return _compacted(spark, d)[0].select("snap_id")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """Close and volume of every source for every minute of its capture runs."""
    return regular_grid(table(spark, d, "bars"), table(spark, d, "capture_runs"), ["venue", "product_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The absent minutes."""
    return p6_grid(spark, d).filter("absent").select("venue", "product_id", F.unix_seconds("minute").alias("minute_s"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_flags": p1_flags,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_grid": p6_grid,
}

# Everything above each expression along first parents; a cycle's own members have nothing above them.
_ABOVE = """
        WITH RECURSIVE f AS (SELECT expr_id, arg_min({'p': parents[1]}, line_no).p AS p FROM archive_records GROUP BY expr_id),
        g AS (SELECT f.expr_id, CASE WHEN f.p IN (SELECT expr_id FROM f) THEN f.p END AS p FROM f),
        r AS (SELECT expr_id FROM g WHERE p IS NULL UNION ALL SELECT g.expr_id FROM g JOIN r ON g.p = r.expr_id),
        lost AS (SELECT * FROM g WHERE expr_id NOT IN (SELECT expr_id FROM r)),
        up AS (SELECT expr_id AS origin, p AS cur, 1 AS n FROM lost UNION SELECT up.origin, lost.p, n + 1 FROM up JOIN lost ON lost.expr_id = up.cur WHERE up.cur <> up.origin AND n <= (SELECT count(*) FROM lost)),
        looped AS (SELECT DISTINCT origin AS expr_id FROM up WHERE cur = origin),
        h AS (SELECT expr_id, CASE WHEN expr_id NOT IN (SELECT expr_id FROM looped) THEN p END AS p FROM g),
        a AS (SELECT expr_id, expr_id AS ancestor, CAST(0 AS BIGINT) AS distance FROM h UNION ALL SELECT a.expr_id, h.p, distance + 1 FROM a JOIN h ON h.expr_id = a.ancestor WHERE h.p IS NOT NULL)"""
SQL: dict[str, str] = {
    "p4_paths": _ABOVE + " SELECT expr_id, list(ancestor ORDER BY distance DESC) AS path FROM a GROUP BY 1",
    "p4_descendants": _ABOVE + " SELECT ancestor AS expr_id, expr_id AS descendant, distance FROM a WHERE distance > 0",
    "p4_found": """
        WITH RECURSIVE f AS (SELECT expr_id, arg_min({'p': parents[1]}, line_no).p AS p FROM archive_records GROUP BY expr_id),
        g AS (SELECT f.expr_id, CASE WHEN f.p IN (SELECT expr_id FROM f) THEN f.p END AS p FROM f),
        r AS (SELECT expr_id, expr_id AS root_id, CAST(0 AS BIGINT) AS depth FROM g WHERE p IS NULL
              UNION ALL SELECT g.expr_id, r.root_id, r.depth + 1 FROM g JOIN r ON g.p = r.expr_id)
        SELECT expr_id, root_id, depth FROM r
        UNION ALL SELECT expr_id, 'cycle', -1 FROM g WHERE expr_id NOT IN (SELECT expr_id FROM r)""",
    "p5_found": """
        SELECT DISTINCT snap_id FROM book_top10
        WHERE file_id IN (SELECT file_id FROM book_files WHERE path NOT LIKE '%.tmp')""",
    "p6_found": """
        WITH g AS (
            SELECT DISTINCT venue, product_id, unnest(range(epoch_us(started_at) // 60000000, epoch_us(ended_at) // 60000000)) AS m FROM capture_runs),
        b AS (SELECT DISTINCT venue, product_id, epoch_us("timestamp") // 60000000 AS m FROM bars
              WHERE NOT isnan(open) AND NOT isnan(high) AND NOT isnan(low) AND NOT isnan(close))
        SELECT venue, product_id, m * 60 AS minute_s FROM g ANTI JOIN b USING (venue, product_id, m)""",
}
