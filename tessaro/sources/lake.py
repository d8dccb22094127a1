"""The lake: {root}/{venue}/{table}/date=YYYY-MM-DD/{HH}-{writer}.parquet.

Venue and table are plain folders, only the date is a partition. Each venue's folder is read on
its own, so filters on the date prune whole days, and with a stated schema, so no file is opened
to learn it. Unfinished writes end in .tmp and are never listed; unreadable files are skipped.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import last_written, minutes_of, resample

_KEYS = "venue string, product_id string, ts timestamp"
CANDLES = f"{_KEYS}, open double, high double, low double, close double, volume double"
TRADES = f"{_KEYS}, trade_id string, price double, size double, side string"
BOOKS = f"{_KEYS}, seq bigint, " + ", ".join(f"{side}_{what}_{i} double" for side in ("bid", "ask") for what in ("px", "sz") for i in range(1, 11))
SCHEMAS = {"candles_1m": CANDLES, "market_trades": TRADES, "book_top10": BOOKS}


def default_root() -> str:
    """The lake that is meant where none is named: $TESSARO_LAKE_ROOT, else data/lake below the working folder."""
    return os.environ.get("TESSARO_LAKE_ROOT") or f"file://{os.getcwd()}/data/lake"


def _venues(spark: SparkSession, root: str, table: str) -> list[str]:
    """The venues' folders that hold the table; none if the root doesn't exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{table}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.globStatus(path) or [])


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a table over its venues, with the file and position they were written at."""
    schema = SCHEMAS[table]
    full = f"{schema}, date date"
    parts = []
    for folder in _venues(spark, root, table):
        rows = spark.read.schema(full).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").option("basePath", folder).parquet(folder)
        parts.append(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")))
    if not parts:
        return spark.createDataFrame([], f"{full}, _file string, _row bigint")
    return reduce(DataFrame.unionByName, parts)


def candles(spark: SparkSession, root: str, product_id: str | None = None, granularity: str = "1m", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one product, or of all: times from start to end, both inclusive; the last written candle of a minute counts.

    A candle without a time or a price is left out, a missing volume is nothing. Coarser bars
    leave out an unfinished last one.
    """
    minutes_of(granularity)
    rows = scan(spark, root, "candles_1m").filter("ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    if product_id is not None:
        rows = rows.filter(F.col("product_id") == product_id)
    if start is not None:
        rows = rows.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("date") >= F.lit(start).cast("timestamp").cast("date")))
    if end is not None:
        rows = rows.filter((F.col("ts") <= F.lit(end).cast("timestamp")) & (F.col("date") <= F.lit(end).cast("timestamp").cast("date")))
    kept = last_written(rows.filter("product_id IS NOT NULL"), ["product_id", "ts"], ["_file", "_row"])
    minutes = kept.select("product_id", "ts", "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return resample(minutes, granularity)


def write(rows: DataFrame, root: str, venue: str, table: str, writer: str = "spark") -> None:
    """Append rows to a venue's table, one file per hour, or per day for candles; readers never see a part of one.

    Files are written aside and take their names, {HH}-{writer}.parquet, by a rename; where a name
    is taken, the new one sorts after it. As many renames as there are hours.
    """
    names = [x.split()[0] for x in SCHEMAS[table].split(", ")]
    dated = rows.withColumn("venue", F.lit(venue)).select(*names, F.col("ts").cast("date").alias("date"), (F.lit("00") if table == "candles_1m" else F.date_format("ts", "HH")).alias("hour"))
    spark, run = rows.sparkSession, uuid.uuid4().hex[:12]
    home, aside = f"{root}/{venue}/{table}", f"{root}/{venue}/{table}/_{run}.tmp"
    dated.repartition("date", "hour").sortWithinPartitions("date", "hour", "ts").write.partitionBy("date", "hour").parquet(aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken: dict[str, set[str]] = {}
    for made in [s.getPath().toString() for s in system.globStatus(path(f"{aside}/date=*/hour=*/*.parquet")) or []]:
        day, hour = made.split("/")[-3], made.split("/")[-2].removeprefix("hour=")
        if day not in taken:
            system.mkdirs(path(f"{home}/{day}"))
            taken[day] = {s.getPath().getName() for s in system.listStatus(path(f"{home}/{day}"))}
        name = f"{hour}-{writer}.parquet"
        if name in taken[day]:
            name = f"{hour}-{writer}~{time.time_ns():020d}-{run}.parquet"
        taken[day].add(name)
        system.rename(path(made), path(f"{home}/{day}/{name}"))
    system.delete(path(aside), True)


def hour_end(path: str) -> int | None:
    """The second at which the hour a file is named after ends; null for a name that tells none."""
    found = re.search(r"date=(\d{4}-\d{2}-\d{2})/(\d{1,2})-[^/]*$", path)
    try:
        return int(dt.datetime.fromisoformat(f"{found[1]}T{int(found[2]):02d}:00:00+00:00").timestamp()) + 3600 if found else None
    except ValueError:
        return None


def files_since(spark: SparkSession, folder: str, since: float | None = None, hours: float | None = None) -> list[str]:
    """A table's finished files whose hour ends after `since`, or no more than so many hours before the newest file's.

    Names alone decide: no file is opened, and days before are not even listed. Files whose name
    tells no hour are always among them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted((s.getPath().toString() for s in system.globStatus(path(f"{folder}/date=*")) or []), reverse=True)
    kept: list[str] = []
    for day in days:
        files = [s.getPath().toString() for s in system.globStatus(path(f"{day}/*.parquet")) or []]
        told = {f: hour_end(f) for f in files}
        if hours is not None and since is None and any(told.values()):
            since = max(t for t in told.values() if t) - hours * 3600 - 1
        kept += [f for f, t in told.items() if t is None or since is None or t > since]
        if since is not None and told and all(t is not None and t <= since for t in told.values()):
            break
    return sorted(kept)


def read_files(spark: SparkSession, folder: str, table: str, files: list[str]) -> DataFrame:
    """Rows of some of a table's files, with the file and position they were written at; unreadable files are skipped."""
    if not files:
        return spark.createDataFrame([], f"{SCHEMAS[table]}, _file string, _row bigint")
    rows = spark.read.schema(SCHEMAS[table]).option("ignoreCorruptFiles", True).option("basePath", folder).parquet(*files)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def book_tail(spark: SparkSession, root: str, n: int = 600, hours: float = 48.0) -> DataFrame:
    """The newest n snapshots of each product on the venue where its newest one is, the last written of a stamp.

    Only files named after the last hours before each venue's newest file are read.
    """
    from ..operators.microstructure import freshest_venue, newest

    parts = []
    for folder in _venues(spark, root, "book_top10"):
        rows = read_files(spark, folder, "book_top10", files_since(spark, folder, hours=hours))
        parts.append(rows.withColumn("venue", F.lit(folder.rstrip("/").split("/")[-2])))
    if not parts:
        return spark.createDataFrame([], BOOKS)
    rows = reduce(DataFrame.unionByName, parts).filter("ts IS NOT NULL AND product_id IS NOT NULL")
    rows = rows.join(freshest_venue(rows), ["product_id", "venue"], "left_semi")
    return newest(last_written(rows, ["product_id", "venue", "ts"], ["_file", "_row"]).drop("_file", "_row"), ["product_id"], ["ts"], n)


def trade_window(spark: SparkSession, root: str, venue: str, since: float, until: float) -> DataFrame:
    """A venue's prints from one second to another, both inclusive; files of hours that ended before aren't read."""
    folder = f"{root}/{venue}/market_trades"
    rows = read_files(spark, folder, "market_trades", files_since(spark, folder, since=since))
    return rows.filter(F.col("ts").between(F.timestamp_micros(F.lit(int(since * 1e6))), F.timestamp_micros(F.lit(int(until * 1e6)))))


def missing_columns(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(file, missing): files whose footer lacks a column, which a scan would read as null. Footers are read on the executors."""
    want = [x.split()[0] for x in SCHEMAS[table].split(", ")]
    files = scan(spark, root, table).select(F.col("_file").alias("file")).distinct()

    def look(batches):  # noqa: ANN001, ANN202
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for file in batch["file"]:
                system, path = fs.FileSystem.from_uri(file)
                names = set(pq.ParquetFile(system.open_input_file(path)).schema_arrow.names)
                out.append([c for c in want if c not in names])
            yield pd.DataFrame({"file": batch["file"], "missing": out})

    return files.mapInPandas(look, "file string, missing array<string>").filter("size(missing) > 0")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A decision log as (ts, symbol, regime, confidence, is_run), from flat rows or from documents of runs; a mix is refused."""
    raw = spark.read.option("multiLine", True).schema(DECISIONS).json(path)
    flat, nested = (F.count_if(F.col(c).isNotNull()) for c in ("timestamp", "decisions"))
    n_flat, n_nested, n_bad = raw.agg(flat, nested, F.count_if(F.col("decisions").isNotNull() & F.col("generated_at").try_cast("timestamp").isNull())).first()
    if n_flat and n_nested or n_bad:
        raise ValueError("the log mixes flat rows with documents of runs" if n_flat and n_nested else "a run doesn't say when it was made")
    if n_nested:
        rows = raw.select(F.col("generated_at").try_cast("timestamp").alias("ts"), F.explode("decisions").alias("d"))
        out = rows.select("ts", "d.symbol", F.col("d.regime_decision").alias("regime"), F.col("d.confidence").alias("confidence"), F.lit(True).alias("is_run"))
        if not out.filter("symbol IS NULL OR regime IS NULL OR confidence IS NULL").isEmpty():
            raise ValueError("a decision of a run needs symbol, regime_decision and confidence")
        return out
    return raw.select(F.col("timestamp").try_cast("timestamp").alias("ts"), "symbol", "regime", "confidence", F.lit(False).alias("is_run"))


#: Both forms of the log: flat rows, and documents of runs.
DECISIONS = "timestamp string, symbol string, regime string, confidence double, generated_at string, decisions array<struct<symbol: string, regime_decision: string, confidence: double>>"
ARCHIVE = (
    "expr_id string, text string, family string, verdict string, insample struct<ic: double, n: bigint, abs_ic: double, threshold: double>, parents array<string>, op string, mode string, generation bigint, "
    "trial_no bigint, n_trials_at_verdict bigint, gates_version string, cleared_null boolean, reason string"
)


def archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(records in order with line_no, meta) of a verdict archive in JSON lines, one of which, the first, is its meta."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    is_meta = F.coalesce(F.get_json_object("value", "$._meta") == "true", F.lit(False))
    meta = lines.filter(is_meta).select("value").take(1)
    records = lines.filter(~is_meta & (F.trim("value") != "")).select(F.from_json("value", ARCHIVE).alias("r"), "line_no")
    return records.select("r.*", "line_no"), {k: v for k, v in json.loads(meta[0][0]).items() if k != "_meta"} if meta else {}


def read_archive(spark: SparkSession, path: str) -> tuple[list[dict], dict]:
    """The records and the meta of one search's own archive, for the driver to go on with; both empty if there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return [], {}
    rows = [json.loads(r[0]) for r in spark.read.text(path).collect() if r[0].strip()]  # one line per proposal of the search
    meta = next((r for r in rows if r.get("_meta") is True), {})
    return [r for r in rows if r.get("_meta") is not True], {k: v for k, v in meta.items() if k != "_meta"}


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of the driver's, on whatever file system the path names."""
    fs, at = _file(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_archive(spark: SparkSession, path: str, meta: dict, records: list[dict]) -> None:
    """One search's archive: meta first, keys sorted."""
    write_text(spark, path, "".join(json.dumps(row, sort_keys=True) + "\n" for row in ({"_meta": True, **meta}, *records)))


def replayed_differently(records: DataFrame, again: DataFrame) -> DataFrame:
    """expr_ids whose verdict isn't the same in a second run, or that it lacks."""
    other = again.select("expr_id", F.col("verdict").alias("_again"))
    return records.join(other, "expr_id", "left").filter(~F.col("verdict").eqNullSafe(F.col("_again"))).select("expr_id")
