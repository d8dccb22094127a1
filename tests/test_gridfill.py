import datetime as dt
import math

import numpy as np

from tessaro.operators.gridfill import LINE, SETTLED, UNSETTLED, impute, regular_grid

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BARS = "venue string, product_id string, bar_id bigint, timestamp timestamp, open double, high double, low double, close double, volume double, ingested_at timestamp, minute string, cell int"
RUNS = "venue string, product_id string, started_at timestamp, ended_at timestamp, writer string"


def at(m, s=0):
    return T0 + dt.timedelta(minutes=m, seconds=s)


def bar(m, close, s=0, bar_id=0, volume=1.0, came=0, open_=1.0):
    return ("v", "p", bar_id, at(m, s), open_, 1.0, 1.0, close, volume, at(m + 1 + came), "x", 1)


def grid(spark, bars, runs):
    return regular_grid(spark.createDataFrame(bars, BARS), spark.createDataFrame(runs, RUNS), ["venue", "product_id"]).orderBy("minute").collect()


def test_impute_follows_the_series_and_beats_the_line():
    t = np.arange(400)
    truth = np.sin(t / 5) + 0.01 * t
    x = truth.copy()
    hidden = np.random.default_rng(1).choice(400, 60, replace=False)
    x[hidden] = np.nan
    x[150] = 500.0  # a wild reading doesn't shape the fill
    y, how = impute(x)
    assert how == SETTLED and impute(x, iterations=2)[1] == UNSETTLED
    known = np.flatnonzero(~np.isnan(x))
    line = np.interp(t, known[known != 150], truth[known[known != 150]])
    error = lambda z: np.abs(z[hidden] - truth[hidden]).mean()
    assert error(y) < 0.5 * error(line) and y[150] == 500.0 and not np.isnan(y).any()
    assert np.isnan(impute(np.full(5, np.nan))[0]).all() and impute(np.array([np.nan, 2.0]))[0][0] == 2.0 and impute(np.array([np.nan, 2.0]))[1] == LINE


def test_absent_minutes_and_the_latest_delivery(spark):
    bars = [bar(0, 1.0), bar(1, 2.0, s=59), bar(1, 3.0, s=10, bar_id=9, came=5), bar(2, None), bar(3, float("nan")), bar(5, 4.0, volume=None), bar(6, 5.0, open_=None), bar(50, 7.0)]
    runs = [("v", "p", at(0), at(8), None), ("v", "p", at(0), at(8), None), ("v", "p", at(6), at(9), "w"), ("v", "p", at(20), at(20), "w"), ("v", None, at(0), at(5), "w"), ("v", "q", at(0), at(2), "w")]
    rows = grid(spark, bars, runs)
    mine = [r for r in rows if r.product_id == "p"]
    assert [r.absent for r in mine] == [False, False, True, True, True, False, True, True, True]
    assert mine[1].close == 3.0 and mine[5].volume_filled and mine[5].volume is not None and all(r.close > 0 for r in mine)
    empty = [r for r in rows if r.product_id == "q"]
    assert len(empty) == 2 and all(r.absent and r.close is None and not r.close_filled for r in empty)


def test_long_runs_give_each_minute_once(spark):
    bars = [bar(m, math.exp(math.sin(m / 30))) for m in range(0, 2000) if m % 11]
    rows = grid(spark, bars, [("v", "p", at(0), at(2000), None)])
    assert len(rows) == len({r.minute for r in rows}) == 2000 and sum(r.absent for r in rows) == len([m for m in range(2000) if not m % 11])
    assert max(abs(math.log(r.close) - math.sin(i / 30)) for i, r in enumerate(rows)) < 0.02
    assert {r.fill for r in rows} == {None, "ssa"} and all((r.fill is None) == (not r.close_filled and not r.volume_filled) for r in rows)


def test_nothing(spark):
    assert grid(spark, [], []) == [] and grid(spark, [bar(0, 1.0)], []) == []
