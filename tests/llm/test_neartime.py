import datetime as dt
import os
import random

import pytest

from tessaro.llm import neartime
from tessaro.llm.neartime import nearest_in_time, replay_nearest, tagged

from tessaro.session import Scratch

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
L = "venue string, product_id string, ts timestamp, trade_id string, snap_id string"
R = "venue string, product_id string, ts timestamp, snap_id bigint, kind string"


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def pairs(spark, left, right, tolerance=2_000_000, **more):
    log = tagged(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["venue", "product_id"], "ts", "trade_id", "snap_id")
    return sorted((r.left_id, r.right_id, r.gap_us) for r in replay_nearest(spark, log, tolerance, **more).collect())


def test_rules(spark):
    s = 1_000_000
    left = [("v", "p", at(10 * s), "mid", ""), ("v", "p", at(10 * s), "mid", ""), ("v", "p", at(20 * s), "far", ""), ("v", "p", at(30 * s), "edge", ""), ("v", "p", at(40 * s), "beyond", ""),
            ("v", "p", None, "n1", ""), ("v", None, at(10 * s), "n2", ""), ("w", "p", at(10 * s), "other", ""), ("v", "p", at(600 * s - 1), "border", ""), ("v", "p", at(50 * s), "", "")]
    right = [("v", "p", at(9 * s), 2**60 + 1, ""), ("v", "p", at(11 * s), 3, ""), ("v", "p", at(28 * s), 9, ""), ("v", "p", at(28 * s), 5, ""), ("v", "p", at(42 * s + 1), 6, ""),
             ("v", "p", None, 7, ""), (None, "p", at(10 * s), 8, ""), ("v", "p", at(600 * s + 5), 11, ""), ("v", "p", at(28 * s), None, "")]
    assert pairs(spark, left, right) == [("", None, None), ("beyond", None, None), ("border", 11, 6), ("edge", 5, 2 * s), ("far", None, None), ("mid", 2**60 + 1, s), ("other", None, None)]


def test_against_brute_force_in_slices(spark, monkeypatch):
    rng = random.Random(5)
    stamps = rng.sample(range(0, 400_000_000), 900)
    entity = lambda: ("v", "hot") if rng.random() < 0.5 else (rng.choice("vw"), rng.choice("ab"))
    left = [(*entity(), at(t), f"t{i}", "") for i, t in enumerate(stamps[:500])]
    right = [(*entity(), at(t), i, "") for i, t in enumerate(stamps[500:])]
    want = []
    for v, p, ts, i, _ in left:
        near = min(((abs(ts - r[2]), r[2] > ts, r[3]) for r in right if r[:2] == (v, p)), default=None)
        ok = near is not None and near[0] <= dt.timedelta(microseconds=1_500_000)
        want.append((i, near[2] if ok else None, near[0] // dt.timedelta(microseconds=1) if ok else None))
    assert pairs(spark, left, right, 1_500_000, rows_per_slice=300, shards=3, stretch_us=5_000_000) == sorted(want)
    # an entity with too many rows in ten minutes has shorter cells; slices meet few files
    monkeypatch.setattr(neartime, "CELL_ROWS", 10)
    kept = []
    monkeypatch.setattr(neartime, "Scratch", lambda *a: kept.append(Scratch(*a)) or kept[-1])
    assert pairs(spark, left, right, 1_500_000, rows_per_slice=100, shards=3) == sorted(want)
    arrived = os.path.join(kept[0].root.removeprefix("file://"), "arrived")
    files = [f for at, _, names in os.walk(arrived) for f in names if f.endswith(".parquet")]
    slices = len(os.listdir(arrived)) - 1
    assert slices >= 9 and len(files) <= slices * (spark.sparkContext.defaultParallelism + 2) + 1


def test_nothing_one_side_and_wrong_arguments(spark):
    assert pairs(spark, [], []) == []
    assert pairs(spark, [("v", "p", at(5), "t", "")], []) == [("t", None, None)]
    assert pairs(spark, [], [("v", "p", at(5), 1, "")]) == []
    with pytest.raises(ValueError):
        nearest_in_time(spark.createDataFrame([], "kind int"), -1, lateness="0 seconds")
