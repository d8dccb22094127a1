import datetime as dt
import json
import math
import statistics

import pytest

from tessaro.operators.resample import closed
from tessaro.sources import lake, synthetic
from tessaro.streaming.bars import streamed_bars

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROW = "product_id string, ts timestamp, open double, high double, low double, close double, volume double"


def minutes(spark, n, price=1.0):
    return spark.createDataFrame([("p", T0 + dt.timedelta(minutes=i), price, price, price, price, None if i == 3 else 1.0) for i in range(n)], ROW)


def test_lake_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert lake.candles(spark, root).count() == 0
    lake.write(minutes(spark, 130), root, "a", "candles_1m")
    lake.write(minutes(spark, 2, 9.0), root, "b", "candles_1m")
    day = tmp_path / "a/candles_1m/date=2024-01-01"
    (day / "05-w.parquet.tmp").write_bytes(b"unfinished")
    (day / "06-w.parquet").write_bytes(b"not parquet at all")
    got = lake.candles(spark, root).orderBy("ts").collect()
    assert len(got) == 130 and [r.close for r in got[:3]] == [9.0, 9.0, 1.0] and got[3].volume == 0.0
    hours = lake.candles(spark, root, "p", "1h").orderBy("ts").collect()
    assert len(hours) == 2 and hours[0].volume == 59.0
    assert lake.candles(spark, root, "p", start="2024-01-01 00:10:00", end="2024-01-01 00:12:00").count() == 3
    with pytest.raises(ValueError):
        lake.candles(spark, root, granularity="7m")


def test_files_are_named_after_hours_and_pruned_by_them(spark, tmp_path):
    root = f"file://{tmp_path}"
    cells = [f"{side}_{what}_{i}" for side in ("bid", "ask") for what in ("px", "sz") for i in range(1, 11)]

    def snaps(hours, product="p", price=1.0):
        rows = [(product, T0 + dt.timedelta(hours=h), h, *([price] * 40)) for h in hours]
        return spark.createDataFrame(rows, "product_id string, ts timestamp, seq bigint, " + ", ".join(f"{c} double" for c in cells))

    lake.write(snaps(range(0, 120, 10)), root, "a", "book_top10", "w")
    lake.write(snaps([110], price=2.0), root, "a", "book_top10", "w")
    lake.write(snaps([5, 40], "q"), root, "b", "book_top10", "w")
    names = sorted(p.name for p in (tmp_path / "a/book_top10").rglob("*.parquet"))
    assert len(names) == 13 and "14-w.parquet" in names and not list((tmp_path / "a").rglob("*.tmp"))
    assert lake.hour_end("x/date=2024-01-01/05-w.parquet") == T0.timestamp() + 6 * 3600 and lake.hour_end("x/date=2024-01-01/part-0.parquet") is lake.hour_end("x/05-w.parquet") is None
    folder = f"{root}/a/book_top10"
    (tmp_path / "a/book_top10/date=2024-01-01/00-w.parquet").write_bytes(b"never opened")
    assert [lake.hour_end(f) for f in lake.files_since(spark, folder, hours=48)] == [T0.timestamp() + (h + 1) * 3600 for h in (70, 80, 90, 100, 110, 110)]
    got = lake.book_tail(spark, root).orderBy("product_id", "ts").collect()
    assert [(r.product_id, r.venue, r.seq, r.bid_px_1) for r in got] == [("p", "a", h, 2.0 if h == 110 else 1.0) for h in (70, 80, 90, 100, 110)] + [("q", "b", 5, 1.0), ("q", "b", 40, 1.0)]
    assert lake.book_tail(spark, f"{root}/none").count() == 0
    prints = spark.createDataFrame([("p", T0 + dt.timedelta(hours=h), f"t{h}", 1.0, 1.0, "BUY") for h in range(6)], "product_id string, ts timestamp, trade_id string, price double, size double, side string")
    lake.write(prints, root, "a", "market_trades")
    window = lake.trade_window(spark, root, "a", T0.timestamp() + 7200, T0.timestamp() + 4 * 3600)
    assert {r.trade_id for r in window.collect()} == {"t2", "t3", "t4"} and len(lake.files_since(spark, f"{root}/a/market_trades", since=T0.timestamp() + 7200)) == 4


def test_logs(spark, tmp_path):
    flat, nested = tmp_path / "flat.json", tmp_path / "nested.json"
    flat.write_text(json.dumps([{"timestamp": "2024-01-01T00:00:00Z", "symbol": "A", "regime": "trend_up", "confidence": 1}]))
    nested.write_text(json.dumps([{"generated_at": "2024-01-01T00:00:00Z", "decisions": [{"symbol": "A", "regime_decision": "x", "confidence": 0.5}] * 2}]))
    assert lake.decisions(spark, str(flat)).first().regime == "trend_up" and lake.decisions(spark, str(nested)).count() == 2
    path = f"file://{tmp_path}/a.jsonl"
    assert lake.read_archive(spark, path) == ([], {})
    told = [{"expr_id": "a", "verdict": "noise", "parents": ["x", "y"], "insample": {"ic": 0.1, "n": 40, "abs_ic": 0.1, "threshold": 0.2}}, {"expr_id": "b", "verdict": "candidate", "generation": 3}]
    lake.write_archive(spark, path, {"seed": 7, "split": {"n": 3}}, told)
    records, meta = lake.archive(spark, path)
    got = records.orderBy("line_no").collect()
    assert meta == {"seed": 7, "split": {"n": 3}} and [(r.expr_id, r.verdict) for r in got] == [("a", "noise"), ("b", "candidate")]
    assert got[0].parents == ["x", "y"] and got[0].insample.threshold == 0.2 and got[1].generation == 3
    assert lake.read_archive(spark, path) == (told, meta)
    assert [r.expr_id for r in lake.replayed_differently(records, records.filter("expr_id = 'a'")).collect()] == ["b"]


def test_walks_are_reproducible(spark):
    a, b = (synthetic.walks(spark, [1, 2], 50).orderBy("seed", "bar_idx").collect() for _ in range(2))
    assert a == b and len(a) == 100 and all(r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high for r in a)


def test_paths_keep_their_moments():
    plain, planted = (synthetic.path(5, 20_000, sigma=0.01, phi=phi) for phi in (0.0, -0.3))
    r = lambda bars: [math.log(b[3] / a[3]) for a, b in zip(bars, bars[1:])]
    for bars, phi in ((plain, 0.0), (planted, -0.3)):
        x = r(bars)
        assert abs(statistics.stdev(x) - 0.01) < 0.0002 and abs(statistics.correlation(x[1:], x[:-1]) - phi) < 0.02
    with pytest.raises(ValueError):
        synthetic.path(1, 5, phi=1.0)


def test_candles_books_and_prints(spark):
    rows = sorted(synthetic.candles(spark, ["A", "B"], "1h", 7_200_100.0, limit=5).collect())
    assert len(rows) == 10 and rows[0].open != rows[5].open and float(rows[4].ts) == 7_200_000.0
    assert rows[1:5] == synthetic.candles(spark, ["A"], "1h", 7_200_100.0, limit=4).collect()
    done = closed(synthetic.candles(spark, ["A"], "1h", 7_200_100.0, limit=5), "1h", 7_200_100.0)
    assert done.count() == 4 and dict(done.dtypes)["close"] == "double"
    with pytest.raises(ConnectionError):
        synthetic.candles(spark, ["A"], "1h", 0.0, failing=frozenset("A"))
    b = synthetic.book(1)
    assert b["bids"][0][0] == 99.99 and b["asks"][0][0] == 100.01 and b["bids"][9][0] == 99.9 and b == synthetic.book(1)
    assert len(synthetic.prints(3, 50)) == 50 and {p[2] for p in synthetic.prints(3, 50)} == {"buy", "sell"}
    assert synthetic.minutes(spark, "A", 1).count() == 1440


def test_streamed_bars(spark, tmp_path):
    rows = [("p", T0 + dt.timedelta(minutes=m), m, float(m + 1), 2.0) for m in range(0, 200, 10)]
    spark.createDataFrame(rows, "product_id string, ts timestamp, seq bigint, price double, size double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("product_id string, ts timestamp, seq bigint, price double, size double").parquet(str(tmp_path / "in"))
    query = streamed_bars(stream, "1h").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(1.0, 51.0, 12.0), (61.0, 111.0, 12.0), (121.0, 171.0, 12.0)]
