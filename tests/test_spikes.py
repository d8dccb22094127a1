import datetime as dt
import math

import numpy as np
import pytest

from tessaro.operators.spikes import chart, flag_readings

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "bar_id bigint, venue string, product_id string, timestamp timestamp, open double, high double, low double, close double, volume double, ingested_at timestamp, spike string"


def path(n, product="P", first=0, seed=1, start=100.0):
    rng, rows, price = np.random.default_rng(seed), [], start
    for i in range(n):
        open_, price = price, price * math.exp(rng.normal(0, 0.0005))
        rows.append([first + i, "v", product, T0 + dt.timedelta(minutes=i), open_, max(open_, price) * 1.0002, min(open_, price) * 0.9998, price, float(np.exp(rng.normal(3, 0.4))), T0 + dt.timedelta(minutes=i + 1), "x"])
    return rows


def flags(spark, rows):
    out = flag_readings(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), ["venue", "product_id"]).collect()
    return {r.bar_id: (r.impossible, r.spike, r.stuck) for r in out}


def test_chart_tells_spikes_from_moves():
    x = np.zeros(60) + np.random.default_rng(0).normal(0, 0.001, 60)
    x[20:22] += 1.0
    x[40:] += 1.0
    spike = chart(x, 0.001, 10.0)[2]
    assert spike[20:22].all() and spike.sum() == 2


def test_planted_cases(spark):
    rows = path(600)
    rows[100][5] = rows[100][7] * 1.06  # a high alone
    for i in (200, 201, 202):  # three bars ten times too large, then back
        rows[i][4:8] = [x * 10 for x in rows[i][4:8]]
    for i in range(300, 600):  # a lasting move isn't a spike
        rows[i][4:8] = [x * 1.08 for x in rows[i][4:8]]
    for i in range(401, 407):  # six repeats of bar 400
        rows[i][5:8] = rows[400][5:8]
        rows[i][4] = rows[400][7]
    rows[450][8] = rows[450][8] * 200
    rows[500][6], rows[500][5] = rows[500][5] * 1.01, rows[500][5]  # low above high
    rows[510][8] = -1.0
    got = flags(spark, rows)
    assert {b for b, f in got.items() if f[1]} == {100, 200, 201, 202, 450}
    assert {b for b, f in got.items() if f[2]} == set(range(401, 407))
    assert {b for b, f in got.items() if f[0]} == {500, 510}
    assert len(got) == 600


def test_nulls_copies_revisions_and_nothing(spark):
    rows = path(120)
    rows[10][7] = None
    rows[11][7] = float("nan")
    rows[12][8] = None
    rows[13][4:9] = [None] * 5
    rows.append(list(rows[20]))  # the same delivery again
    revised = list(rows[30])
    revised[0], revised[9] = 5000, T0 + dt.timedelta(hours=3)
    rows[30][4:8] = [x * 50 for x in rows[30][4:8]]  # the first delivery was off, the correction isn't
    rows.append(revised)
    lost = list(rows[40])
    lost[0], lost[3], lost[7] = 6000, None, -1.0
    rows.append(lost)
    nobody = list(rows[41])
    nobody[0], nobody[1] = 6001, None
    rows.append(nobody)
    got = flags(spark, rows)
    assert got[30][1] and not got[5000][1] and got[6000][0] and got[6001] == (False, False, False)
    assert {b for b, f in got.items() if any(f)} == {30, 6000}
    assert flag_readings(spark.createDataFrame([], SCHEMA), ["venue", "product_id"]).count() == 0


def test_a_source_that_repeats_by_nature_is_not_stuck(spark):
    rows = path(400)
    for i in range(1, 400):
        if i % 8:
            rows[i][4:8] = rows[i - 1][4:8]
    assert not any(f[2] for f in flags(spark, rows).values())


@pytest.mark.parametrize("stretch", [1, 500])
def test_many_sources_in_stretches(spark, stretch):
    rows = [r for k in range(3) for r in path(stretch, f"P{k}", first=k * 1000, seed=k)]
    assert len(flags(spark, rows)) == 3 * stretch


def test_recall_by_kind(spark):
    """Planted on twenty sources of different levels: nearly all of each kind is found, and little else."""
    rows, truth = [], {"impossible": set(), "spike": set(), "stuck": set()}
    for k in range(20):
        own, rng = path(1500, f"P{k}", first=10_000 * k, seed=k, start=10.0 ** (k % 7 - 3)), np.random.default_rng(100 + k)
        for n, i in enumerate(range(60, 1440, 60)):
            i += int(rng.integers(0, 30))
            kind = ("spike", "stuck", "impossible", "volume", "high")[n % 5]
            if kind == "spike":
                span, factor = int(rng.integers(1, 4)), float(rng.choice([0.9, 1.1, 10.0]))
                for r in own[i : i + span]:
                    r[4:8] = [x * factor for x in r[4:8]]
                    truth["spike"].add(r[0])
            elif kind == "stuck":
                for r in own[i + 1 : i + 1 + int(rng.integers(5, 12))]:
                    r[5:8], r[4] = own[i][5:8], own[i][7]
                    truth["stuck"].add(r[0])
            elif kind == "impossible":
                own[i][5], own[i][6] = own[i][6] * 0.999, own[i][5]
                truth["impossible"].add(own[i][0])
            else:
                place = 8 if kind == "volume" else 5
                own[i][place] *= 200.0 if kind == "volume" else 1.08
                truth["spike"].add(own[i][0])
        rows += own
    got = flags(spark, rows)
    for at, kind in enumerate(("impossible", "spike", "stuck")):
        found = {b for b, f in got.items() if f[at]}
        recall, precision = len(found & truth[kind]) / len(truth[kind]), len(found & truth[kind]) / len(found)
        print(kind, len(truth[kind]), round(recall, 4), round(precision, 4))
        assert recall >= 0.98 and precision >= 0.95, (kind, recall, precision)
