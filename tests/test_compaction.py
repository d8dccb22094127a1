import datetime as dt

import pytest

from tessaro.operators.compaction import compact, consolidate, repeated_lines, tiny_files
from tessaro.session import Scratch

SCHEMA = "path string, id bigint, name string, px double, at timestamp, line string"


def rows():
    t = dt.datetime(2024, 1, 1, 0, 0, 1, 234567)
    return [
        ("f/1", 1, "plain", 1.5, t, "x"), ("f/1", 2, "comma, \"quoted\" \\n", float("nan"), None, "a\nb\r\\s\\"), ("f/2", 3, None, None, t, ""), ("f/2", 1, "plain", 1.5, t, "x"),
        ("f/3", 1, "plain", 1.5, t, "x"), ("f/3", 4, "ünï→", -2.0, t, "y" * 100_000), ("f/3", 4, "ünï→", -2.0, t, "y" * 100_000), (None, 5, "", 1e-300, t, "z"),
    ]


COLUMNS = ["id", "name", "px", "at", "line"]


def test_round_trip_each_record_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    back, manifest = compact(spark, df, "path", COLUMNS)
    got, want = back.collect(), df.select(*COLUMNS).dropDuplicates().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and back.schema == df.select(*COLUMNS).schema
    assert manifest.select("name").distinct().count() == 1
    assert sum(r.n_rows for r in manifest.collect()) == len(want)


def test_many_small_targets(spark):
    df = spark.range(2000).selectExpr("concat('f/', id % 300) AS path", "id", "'n' AS name", "id * 0.5 AS px", "timestamp_micros(id) AS at", "'' AS line")
    back, manifest = compact(spark, df, "path", COLUMNS, target_bytes=4000)
    assert back.count() == back.select("id").distinct().count() == 2000 and manifest.select("name").distinct().count() > 2


def test_nothing(spark):
    back, manifest = compact(spark, spark.createDataFrame([], SCHEMA), "path", COLUMNS)
    assert back.count() == manifest.count() == 0


def test_altered_bytes_are_noticed(spark):
    files = tiny_files(spark.createDataFrame(rows()[:3], SCHEMA), "path", COLUMNS)
    broken = files.withColumn("checksum", files["checksum"] + 1)
    scratch = Scratch(spark, "broken")
    with pytest.raises(Exception, match="recorded"):
        consolidate(broken, repeated_lines(files, scratch), scratch.root, COLUMNS, target_bytes=1 << 20, total_bytes=100).collect()
