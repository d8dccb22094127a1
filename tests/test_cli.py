import datetime as dt
import json

import pytest

from tessaro.__main__ import main
from tessaro.operators import signals
from tessaro.sources import lake, synthetic

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lake')}"
    for symbol in ("AA-USD", "BBUSDT"):
        lake.write(synthetic.minutes(spark, symbol, 12), path, "v", "candles_1m")
    return path


def test_backtests(spark, root, tmp_path, capsys):
    out = f"file://{tmp_path}/o"
    common = ["backtest", "--lake-root", root, "--granularity", "1h"]
    assert main([*common, "--symbols", "AA-USD,BBUSDT,NONE", "--signal", "momentum", "--out", out]) == 0
    said = capsys.readouterr()
    assert "288 bars of 1h" in said.out and "NONE: 0 bars" in said.err
    assert spark.read.json(f"{out}/equity_curve").count() == 288 and spark.read.json(f"{out}/decisions").count() == 2 * 288 and spark.read.json(f"{out}/trades").count() > 0
    assert main([*common, "--symbols", "AA-USD", "--mode", "weight"]) == 0
    assert main([*common, "--symbols", "NONE"]) == 2
    for bad in (["--mode", "weight", "--signal", "random"], ["--sigma-target", "0.2"], ["--signal", "replay"]):
        with pytest.raises(SystemExit):
            main([*common, "--symbols", "AA-USD", *bad])


def test_replays(spark, root, tmp_path):
    runs = tmp_path / "runs.json"
    made = [{"generated_at": "2026-01-01T02:30:00+00:00", "decisions": [{"symbol": "BB-USD", "regime_decision": "trend_down", "confidence": 0.9, "action": "x"}]}, {"generated_at": "2026-01-01T02:45:00+00:00", "decisions": [{"symbol": "BB-USD", "regime_decision": "trend_up", "confidence": 0.8}]}]
    runs.write_text(json.dumps(made))
    out = f"file://{tmp_path}/o"
    assert main(["backtest", "--lake-root", root, "--symbols", "BBUSDT", "--signal", "replay", "--replay-path", str(runs), "--out", out]) == 0
    got = [(r.ts, r.regime) for r in spark.read.json(f"{out}/decisions").filter("regime <> 'uncertain'").collect()]
    assert got == [("2026-01-01T03:00:00.000Z", "trend_up")]  # the newest run, once, at the first bar after it
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps([{"timestamp": "2026-01-01T05:00:00+00:00", "symbol": "bb_usd", "regime": "range_bound", "confidence": 0.6}, {"timestamp": "2026-01-01T05:30:00+00:00", "symbol": "BB-USD", "regime": "trend_up", "confidence": 0.6}]))
    bars = spark.createDataFrame([("BBUSDT", h, T0 + dt.timedelta(hours=h), 1.0) for h in range(8)], "product_id string, bar_idx int, ts timestamp, close double")
    said = {r.bar_idx: (r.regime, r.confidence) for r in signals.states(bars, "replay", log=lake.decisions(spark, str(flat))).collect()}
    assert said.pop(5) == ("range_bound", 0.6) and set(said.values()) == {("uncertain", 0.0)} and len(said) == 7
    flat.write_text(json.dumps([made[0], {"timestamp": "2026-01-01T05:00:00+00:00", "symbol": "A", "regime": "x", "confidence": 1}]))
    with pytest.raises(ValueError):
        lake.decisions(spark, str(flat))
    flat.write_text(json.dumps([{"generated_at": "nonsense", "decisions": []}]))
    with pytest.raises(ValueError):
        lake.decisions(spark, str(flat))


def test_coins(spark):
    import random

    bars = spark.createDataFrame([(p, i, T0, 1.0) for i in range(6) for p in ("a", "b")], "product_id string, bar_idx int, ts timestamp, close double")
    rng = random.Random(42)
    want = [(p, i, rng.choice(signals.REGIMES), rng.uniform(0.5, 0.95)) for i in (0, 2, 4) for p in ("a", "b")]
    got = signals.states(bars, "random", every=2).orderBy("bar_idx", "product_id").collect()
    assert [tuple(r) for r in got] == want
    assert {r.regime for r in signals.states(bars, "buy_and_hold").collect()} == {"uncertain"}
    with pytest.raises(ValueError):
        signals.states(bars, "other")


def test_searches(spark, root, tmp_path, capsys):
    archive, out = f"file://{tmp_path}/a.jsonl", f"file://{tmp_path}/o.json"
    run = ["search", "--lake-root", root, "--symbol", "AA-USD", "--generations", "0", "--archive", archive]
    assert main([*run, "--out", out]) == 0 and "trials" in capsys.readouterr().out
    records, meta = lake.read_archive(spark, archive)
    assert len(records) == 7 and meta["symbol"] == "AA-USD" and json.loads(spark.read.text(out, wholetext=True).first()[0])["symbol"] == "AA-USD"
    assert main(run) == 2
    assert main([*run, "--resume"]) == (3 if meta.get("holdout") else 0)
    assert main(["search", "--lake-root", root, "--symbol", "NONE"]) == 2
