import random

import pytest

from tessaro.plans import expr
from tessaro.plans.compiler import evaluate
from tessaro.plans.factors import FACTORS


def test_text_round_trips_and_ids_are_stable():
    rng = random.Random(1)
    for _ in range(300):
        node = expr.sample(rng, 4)
        assert expr.parse(expr.to_text(node)) == node
        assert expr.expr_id(node) == expr.expr_id(expr.parse(expr.to_text(node))) and len(expr.expr_id(node)) == 12


@pytest.mark.parametrize("text", ["", "close +", "nope", "sma(close)", "sma(close, x)", "delay(close, 0)", "2 * close", "delay(close, 1.5)", "close close", "(close", "close $ open", "-close"])
def test_what_cannot_be_read(text):
    with pytest.raises(ValueError):
        expr.parse(text)


def test_measures_and_rewrites():
    node = expr.parse("-1 * correlation(ts_rank(close, 20), delay(volume, 5), 10)")
    assert (expr.size(node), expr.depth(node), expr.nesting(node), expr.warmup(node)) == (6, 4, 2, 28)
    assert expr.terminals(node) == {"close", "volume"} and expr.validate(node) is None
    assert expr.validate(node, max_warmup=20) == "warmup"
    assert expr.to_text(expr.replace_at(node, 3, "open")) == "-1 * correlation(ts_rank(open, 20), delay(volume, 5), 10)"


def bars(spark, values, seed=3):
    rng = random.Random(seed)
    rows = [("p", i, *(x if x is None else x + d for d in (rng.uniform(-0.9, 0.9), 1.0, -1.0, 0.0)), rng.uniform(1, 5)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "product_id string, bar_idx int, open double, high double, low double, close double, volume double")


def series(spark, values, node):
    return [r.v for r in evaluate(bars(spark, values), {"v": node}).orderBy("bar_idx").collect()]


def near(got, want):
    return len(got) == len(want) and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))


N = None


@pytest.mark.parametrize(("node", "values", "want"), [
    (("delay", "close", 2), [1.0, 2, 4, 7], [N, N, 1, 2]), (("delta", "close", 2), [1.0, 2, 4, 7], [N, N, 3, 5]), (("ts_min", "close", 3), [1.0, 3, 2, 5, 4], [N, N, 1, 2, 2]),
    (("ts_max", "close", 3), [1.0, 3, 2, 5, 4], [N, N, 3, 5, 5]), (("ts_argmax", "close", 3), [1.0, 3, 2, 5, 4], [N, N, 2, 3, 2]), (("ts_rank", "close", 3), [2.0, 1, 2], [N, N, 2.5 / 3]),
    (("ts_rank", "close", 2), [1.0, N, 3, 4], [N, N, N, 1.0]), (("correlation", "close", ("add", "close", ("add", "close", ("const", 1))), 4), [1.0, 2, 4, 3], [N, N, N, 1.0]),
    (("correlation", "close", ("const", 5), 3), [1.0, 2, 4], [N, N, N]), (("signedpower", "close", 2), [-4.0, 3, 0], [-16, 9, 0]), (("ts_scale", "close", 3), [1.0, -2, 3], [N, N, 1.5]),
    (("ts_scale", "close", 3), [0.0, 0, 0], [N, N, N]), (("log", "close"), [-1.0, 0, 1], [N, N, 0]), (("div", "close", ("sub", "close", "close")), [1.0], [N]), (("mul", "close", "close"), [1e200], [N]),
    (("stddev", "close", 2), [1.0, 3, N, 4], [N, 2**0.5, N, N]), ("returns", [1.0, 2, 0, 3], [N, 1, -1, N]), (("sma", "close", 2), [1.0, 2, N, 3, 5], [N, 1.5, N, N, 4]),
    (("where", ("gt", "close", ("const", 1)), ("const", 7), ("neg", "close")), [0.5, 2, N], [-0.5, 7, N]),
])
def test_known_answers(spark, node, values, want):
    assert near(series(spark, values, node), want)


def test_factors_never_look_ahead_and_warm_up_in_time(spark):
    rng = random.Random(9)
    values, x = [], 100.0
    for _ in range(320):
        x *= 1 + rng.gauss(0, 0.02)
        values.append(x)
    nodes = {k: f.node for k, f in FACTORS.items()}
    whole = evaluate(bars(spark, values), nodes).orderBy("bar_idx").collect()
    part = evaluate(bars(spark, values[:310]), nodes).orderBy("bar_idx").collect()
    for k, f in FACTORS.items():
        assert near([r[k] for r in part], [r[k] for r in whole[:310]]), k
        assert whole[-1][k] is not None and all(r[k] is not None for r in whole[f.lookback :]), k
