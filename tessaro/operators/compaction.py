"""Consolidating many tiny files into few well-sized ones by joining their bytes.

A tiny file is a header frame followed by a body frame, both complete zstandard frames of
newline-delimited text. Complete frames may simply be written one after the other, so a
consolidated file is one header frame and then the bodies of its members, byte for byte. Nothing
is parsed: a body is opened only where a record in it is an exact copy of one that lies in an
earlier file; that line is cut out at its newlines. Lengths and checksums are held at every step.

    files      (path, part, content, n_bytes, checksum, n_rows, lines)   tiny_files()
    duplicates (path, part, line_no)                                     repeated_lines()
    manifest   (name, start, n_bytes, checksum, n_rows, n_files)         consolidate()
    lines      (line)                                                    read_lines()

The manifest lists stretches of complete frames, so that a large file is read in parallel.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

_CSV = {"nullValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
FILES = "path string, part int, content binary, n_bytes bigint, checksum bigint, n_rows bigint, lines binary"
MANIFEST = "name string, start bigint, n_bytes bigint, checksum bigint, n_rows bigint, n_files bigint"


def _checksum(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh64(data).digest(), "big", signed=True)


def _header(columns: list[str]) -> bytes:
    return zstandard.ZstdCompressor().compress((",".join(columns) + "\n").encode())


def as_line(df: DataFrame, columns: list[str]) -> Column:
    """A row as one line of text that holds no line break; null is an empty field, an empty text a mark."""
    marks = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))
    escape = lambda c: F.when(F.col(c) == "", F.lit("\\e")).otherwise(reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), marks, F.col(c)))
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    stamp = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    field = lambda c: escape(c) if c in text else F.unix_micros(c) if c in stamp else F.col(c)
    return F.to_csv(F.struct(*(field(c).alias(c) for c in columns)), _CSV)


def from_line(line: Column, schema: T.StructType) -> Column:
    """The struct that as_line() wrote, with its fields' types restored."""
    held = ", ".join(f"`{f.name}` {'bigint' if isinstance(f.dataType, T.TimestampType) else f.dataType.simpleString()}" for f in schema)
    row = F.from_csv(line, held, _CSV | {"mode": "FAILFAST"})
    out = []
    for f in schema:
        value = row[f.name]
        if isinstance(f.dataType, T.StringType):
            for mark, char in (("\\e", ""), ("\\n", "\n"), ("\\r", "\r"), ("\\s", "\\")):
                value = F.replace(value, F.lit(mark), F.lit(char))
        elif isinstance(f.dataType, T.TimestampType):
            value = F.timestamp_micros(value)
        out.append(value.alias(f.name))
    return F.struct(*out)


def tiny_files(rows: DataFrame, path: str, columns: list[str], *, part_bytes: int = 1 << 20) -> DataFrame:
    """The rows as the files they are stored in: one frame for each, or one for each part_bytes of a large one.

    Rows of a file are sought out by one exchange; where a file holds far more than its share,
    the exchange may split it, and it comes out in several parts.
    """
    lines = rows.select(F.col(path).alias("path"), *columns).hint("rebalance", "path").sortWithinPartitions("path")
    lines = lines.select("path", F.spark_partition_id().alias("part"), as_line(lines, columns).alias("line"))
    header = _header(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=6)
        done: list[tuple] = []
        now, held, size, serial = None, [], 0, 0

        def close() -> None:
            body = b"".join(x + b"\n" for x in held)
            content = header + compress.compress(body)
            # The part is unique within a file: the partition, then the parts it made of it.
            done.append((now[0], now[1] * 4096 + serial % 4096, content, len(content), _checksum(content), len(held), b"".join(xxhash.xxh3_128_digest(x) for x in held)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "part", "content", "n_bytes", "checksum", "n_rows", "lines"])
            done.clear()
            return batch

        for batch in batches:
            for p, k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if now != (p, k) or size >= part_bytes:
                    if now is not None:
                        close()
                    serial = serial + 1 if now == (p, k) else 0
                    now, held, size = (p, k), [], 0
                held.append(line)
                size += len(line)
            if len(done) >= 512:
                yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    return lines.mapInArrow(pack, FILES)


def repeated_lines(files: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, part, drop): the numbers of the lines that are exact copies of a line in an earlier place.

    Copies are recognised by 128-bit hashes of the line's bytes. The earliest place (by path,
    part, line) keeps its line; it is found by an aggregation that is combined before the
    exchange, so a record that fills a third of the lake costs no single task anything. The places
    are written once, as they are read twice.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2).to_pylist()
            n = np.array([len(x) // 16 for x in held], np.int64)
            halves = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(held)), n)
            line = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(line.astype(np.int32))],
                names=["h", "g", "path", "part", "line_no"],
            )

    places = files.select("path", "part", "lines").mapInArrow(spread, "h bigint, g bigint, path string, part int, line_no int")
    places = scratch.keep(places.select("h", "g", F.struct("path", "part", "line_no").alias("place")), "places")
    first = places.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = places.join(first, ["h", "g"]).filter("place > first")
    return scratch.keep(repeated.groupBy("place.path", "place.part").agg(F.collect_list("place.line_no").alias("drop")), "repeated")


def consolidate(files: DataFrame, repeated: DataFrame, folder: str, columns: list[str], *, target_bytes: int, total_bytes: int, stretch_bytes: int = 4 << 20) -> DataFrame:
    """Write the files' bodies into files of about target_bytes in folder; the manifest of what was written.

    The result must be materialised exactly once; a retried task writes under a new name, and
    names that aren't in the manifest are leftovers.
    """
    header = _header(columns)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strip and verify on the reading side, so the exchange carries bodies only."""
        for batch in batches:
            out = []
            for p, k, content, n, check in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if len(content) != n or _checksum(content) != check:
                    raise ValueError(f"{p}, part {k}: its bytes aren't those that were recorded")
                if content[: len(header)] != header:
                    raise ValueError(f"{p}: another header")
                out.append(content[len(header) :])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(5)], names=["path", "part", "body", "n_rows"])

    bodies = files.select("path", "part", "content", "n_bytes", "checksum", "n_rows").mapInArrow(body, "path string, part int, body binary, n_rows bigint")
    both = bodies.withColumn("drop", F.lit(None).cast("array<int>")).unionByName(repeated.select("path", "part", F.lit(None).cast("binary").alias("body"), F.lit(0).cast("bigint").alias("n_rows"), "drop"))
    # A file's list of lines to drop travels just ahead of its body.
    bins = max(1, round(total_bytes / target_bytes))
    placed = both.repartitionByRange(bins, "path", "part").sortWithinPartitions("path", "part", F.col("body").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        compress, expand = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        out, name, at, cut, rows, members = None, "", 0, [], 0, 0
        rest, size = [], 0
        listed: list[tuple] = []

        def stretch() -> None:
            nonlocal rest, size, rows, members, at
            if rest:
                data = b"".join(rest)
                out.write(data)
                listed.append((name, at, len(data), _checksum(data), rows, members))
                at += len(data)
                rest, size, rows, members = [], 0, 0, 0

        def close() -> None:
            nonlocal out
            stretch()
            out.close()
            if system.get_file_info(f"{root}/{name}").size != at:
                raise ValueError(f"{name} isn't as long as what was written")
            out = None

        for batch in batches:
            for _, _, data, n, drop in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if data is None:
                    cut = drop
                    continue
                if cut:
                    gone = set(cut)
                    kept = [x for i, x in enumerate(expand.decompress(data).split(b"\n")[:-1]) if i not in gone]
                    data, n, cut = compress.compress(b"".join(x + b"\n" for x in kept)) if kept else b"", len(kept), []
                if not n:
                    continue
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.csv.zst", len(header)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(header)
                rest.append(data)
                rows, members = rows + n, members + 1
                size += len(data)
                if size >= stretch_bytes:
                    stretch()
                    if at >= target_bytes:
                        close()
        if out is not None:
            close()
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*listed)], names=["name", "start", "n_bytes", "checksum", "n_rows", "n_files"])

    return placed.mapInArrow(write, MANIFEST)


def read_lines(manifest: DataFrame, folder: str) -> DataFrame:
    """The lines of the consolidated files, read by stretches; raises where length or checksum differ."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, n, check in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with system.open_input_file(f"{root}/{name}") as file:
                    file.seek(start)
                    data = file.read(n)
                if len(data) != n or _checksum(data) != check:
                    raise ValueError(f"{name} at {start}: its bytes aren't those that were written")
                text = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
                lines = text.split(b"\n")[:-1]
                for i in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[i : i + 10_000], pa.binary()).cast(pa.string())], names=["line"])

    stretches = manifest.select("name", "start", "n_bytes", "checksum")
    return stretches.repartition(F.col("name"), F.col("start")).mapInArrow(read, "line string")


def compact(spark: SparkSession, rows: DataFrame, path: str, columns: list[str], *, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """Consolidate the rows' files in the shared folder: (rows read back, manifest).

    rows: one per record, with the path of its file, which is no part of the record; a null path
    is a file of its own name, "". Records that equal each other in all columns come out once;
    nulls, NaN, empty and very long texts and texts with line breaks come back as they were.
    No rows give an empty table without files. Columns that aren't named aren't read.
    """
    scratch = Scratch(spark, "compact")
    schema = rows.select(*columns).schema
    files = scratch.keep(tiny_files(rows.withColumn("_path", F.coalesce(F.col(path).cast("string"), F.lit(""))), "_path", columns), "files")
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    folder = scratch.path("consolidated")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    manifest = scratch.keep(consolidate(files, repeated_lines(files, scratch), folder, columns, target_bytes=target_bytes, total_bytes=total), "manifest")
    names = {r[0] for r in manifest.select("name").distinct().collect()}  # as many as there are consolidated files
    for status in system.listStatus(where):
        if status.getPath().getName() not in names:
            system.delete(status.getPath(), False)
    scratch.drop("files", "places")
    back = read_lines(manifest, folder).select(from_line(F.col("line"), schema).alias("r")).select("r.*")
    return back, manifest
