import datetime as dt
import math

from tessaro.functions.recursion import ewma_volatility
from tessaro.sources import synthetic
from tessaro.streaming.state import streamed_last_written, streamed_replay, streamed_volatility

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(spark, folder, schema, make, batches):
    """Each batch is written, then the query is started anew from its checkpoint; what it has put out in the end."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_the_last_written_counts(spark, tmp_path):
    schema = "product_id string, ts timestamp, close double, written bigint"
    batches = [[("p", at(0), 1.0, 1), ("p", at(0), 2.0, 3), ("q", at(0), 9.0, 1)], [("p", at(0), 3.0, 2), ("p", at(5), 4.0, 4)], [("p", at(60), 5.0, 5)], [("p", at(120), 6.0, 6), ("p", at(0), 7.0, 7)]]
    got = feed(spark, str(tmp_path), schema, lambda s: streamed_last_written(s, "written"), batches)
    assert sorted((r.product_id, r.close, r.written) for r in got) == [("p", 2.0, 3), ("p", 4.0, 4), ("p", 5.0, 5), ("q", 9.0, 1)]  # the row at 120 is still open, the late one is lost


def test_a_volatility_goes_on_where_it_was(spark, tmp_path):
    closes = {p: [b[3] for b in synthetic.path(k, 90)] for k, p in enumerate("pq")}
    closes["p"][40] = 0.0
    closes["q"][50] = None
    rows = [(p, at(i), c) for p, path in closes.items() for i, c in enumerate(path)]
    cut = [[r for r in rows if a <= r[1] < z] for a, z in ((at(0), at(10)), (at(10), at(55)), (at(55), at(90)))]
    got = {(r.product_id, r.ts.replace(tzinfo=dt.timezone.utc)): r.vol for r in feed(spark, str(tmp_path), "product_id string, ts timestamp, close double", lambda s: streamed_volatility(s, 5, 365.0), [list(reversed(b)) for b in cut])}
    table = spark.createDataFrame([(p, i, c) for p, path in closes.items() for i, c in enumerate(path)], "product_id string, bar_idx int, close double")
    want = {(r.product_id, at(r.bar_idx)): r.vol for r in ewma_volatility(table, {"vol": 5}, 365.0).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-12)) for k, v in want.items())


def test_runs_fire_once(spark, tmp_path):
    bar = lambda m: ("p", at(m), None, None, None)
    run = lambda m, n: ("p", at(m), n, f"r{n}", 0.5)
    batches = [[bar(0), run(1, 1), run(2, 2), bar(10), bar(20), run(21, 3)], [run(25, 4)], [bar(30), bar(40), run(40, 5), ("q", at(0), None, None, None)]]
    got = feed(spark, str(tmp_path), "product_id string, ts timestamp, run_no bigint, regime string, confidence double", streamed_replay, batches)
    assert sorted((r.ts.replace(tzinfo=dt.timezone.utc), r.run_no, r.regime) for r in got) == [(at(10), 2, "r2"), (at(30), 4, "r4"), (at(40), 5, "r5")]
