import datetime as dt

import pytest

from tessaro.operators import simulate, tickets

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

SCHEMA = "run_id string, bar_idx int, product_id string, symbol_ord string, open double, close double, weight double, action string, cost_bps double"


def rows(spark, prices, weights=None, actions=None, cost=0.0):
    out = []
    for s, path in prices.items():
        for i, p in enumerate(path):
            out.append(("r", i, s, s, float(p), float(p), float(weights[s][i]) if weights and weights[s][i] is not None else None, actions[s][i] if actions else None, cost))
    return spark.createDataFrame(out, SCHEMA)


def test_weights_fill_a_bar_later_and_pay_costs(spark):
    curve = simulate.weight_engine(rows(spark, {"A": [100.0, 100, 200, 200]}, {"A": [1.0, 1, 1, 0]}, cost=100.0), every=1).orderBy("bar_idx").collect()
    assert [round(r.equity, 4) for r in curve] == [10_000, round(10_000 / 1.01, 4), round(20_000 / 1.01, 4), round(20_000 / 1.01, 4)]
    assert [r.trades for r in curve] == [0, 1, 0, 0] and min(r.cash for r in curve) >= -1e-9


def test_band_null_and_gross(spark):
    flat = {"A": [10.0] * 4, "B": [10.0] * 4}
    curve = simulate.weight_engine(rows(spark, flat, {"A": [1.0, None, 0.45, 0.0], "B": [1.0, None, 0.55, 0.0]}), every=1).orderBy("bar_idx").collect()
    assert [round(r.weights["A"], 6) for r in curve] == [0, 0.5, 0.5, 0.5]


def test_actions_and_initial_fractions(spark):
    prices = {"A": [10.0, 10, 10, 10]}
    curve = simulate.action_engine(rows(spark, prices, actions={"A": ["halve_position", "maintain", "target_weight_100", "flat_position"]})).orderBy("bar_idx").collect()
    assert [round(r.weights["A"], 6) for r in curve] == [1, 0.5, 0.5, 0.1]
    with pytest.raises(ValueError):
        simulate.action_engine(rows(spark, prices), initial={"A": 1.5})


def test_metrics(spark):
    curve = simulate.weight_engine(rows(spark, {"A": [10.0, 10, 12, 12, 12, 12]}, {"A": [1.0, None, 0.0, None, 1.0, None]}), every=1)
    m = simulate.metrics(curve).first()
    assert m.n_bars == 6 and round(m.total_return, 9) == 0.2 and m.max_drawdown == 0 and m.calmar == 0


def test_a_purchase_ends_where_cash_does(spark):
    prices = {s: [10.0] * 3 for s in "AB"}
    actions = {s: ["reaccumulate_small", "maintain", "maintain"] for s in "AB"}
    curve = simulate.action_engine(rows(spark, prices, actions=actions, cost=100.0), initial={"A": 0.5, "B": 0.45}, capital=1000.0).orderBy("bar_idx").collect()
    # 50 in cash, 100 asked for: half of each 50; with its cost the second takes what is left
    fills = [f.asDict() for f in curve[1].fills]
    assert [round(f["delta_qty"], 6) for f in fills] == [2.5, round(24.75 / 10.1, 6)] and abs(curve[1].cash) < 1e-9 and curve[1].trades == 2


def state(bars):
    """Decisions as tickets() takes them: (position, weight after, quantity, price, fee) per bar."""
    return [("p", i, T0 + dt.timedelta(days=i), 10.0 + i, True, "trend_up", 0.8, "target_weight_100", 1.0, 0.5, p, after, *((T0 + dt.timedelta(days=i + 1), px, fee, q) if q else (None,) * 4), f"why{i}") for i, (p, after, q, px, fee) in enumerate(bars)]


def test_tickets(spark):
    made = spark.createDataFrame(
        state([(0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.6, 6.0, 12.0, 0.1), (0.6, 0.9, 3.0, 13.0, 0.1), (0.9, 0.0, -9.0, 14.0, 0.2), (0.0, 0.5, 5.0, 15.0, 0.1)]),
        "product_id string, bar_idx int, ts timestamp, close double, ok boolean, regime string, confidence double, action string, target double, score double, position_weight double, weight_after double, fill_ts timestamp, fill_px double, fee double, delta_qty double, reasoning string",
    )
    flat, first, second = tickets.tickets(made).orderBy("ticket_no").collect()
    assert (flat.ticket_id, flat.side, flat.entry, flat.size, flat.pnl, flat.n_decisions) == ("p-T001", "flat", 10.0, 0.0, None, 1) and flat.close_ts == first.open_ts
    assert (first.side, first.entry, first.exit, first.size, first.peak_weight, first.fees, first.n_decisions) == ("long", 12.0, 14.0, 0.6, 0.9, 0.4, 3)
    assert first.pnl == round(-72 - 0.1 - 39 - 0.1 + 126 - 0.2, 6) and first.return_on_cost == round(14.6 / 111, 6) and first.why_close == "why3"
    assert (second.side, second.close_ts, second.pnl, second.exit) == ("long", None, None, None)
    assert first.thesis == "Enter long: trend_up at confidence 0.80 (TSMOM blend +0.50) -> target_weight_100 -> target weight 1.00."


def test_decisions_of_a_trend_and_a_crash(spark):
    closes = [100 * 1.004**i for i in range(400)] + [100 * 1.004**400 * 0.98**i for i in range(60)]
    bars = spark.createDataFrame([("p", i, T0 + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, 1.0) for i, c in enumerate(closes)], "product_id string, bar_idx int, ts timestamp, open double, high double, low double, close double, volume double")
    seen = tickets.views(bars)
    made = tickets.decisions(bars, seen, tickets.curve(bars, seen)).orderBy("bar_idx").collect()
    assert [r.bar_idx for r in made] == list(range(262, 459))
    assert made[0].action == "target_weight_100" and made[0].side == "buy" and made[0].weight_after > 0.99
    assert made[0].reasoning.startswith("TSMOM blend +") and made[0].reasoning.endswith("position 0.00 -> buy to 1.00 (band 0.10).")
    halved = [r for r in made if r.action == "halve_position"]
    assert all(abs(b.target - a.target / 2) < 1e-12 for a, b in zip(made, made[1:]) if b.action == "halve_position" and a.target is not None) or not halved
    assert made[-1].action == "flat_position" and made[-1].weight_after == 0.0
    long = [t for t in tickets.tickets(tickets.decisions(bars, seen, tickets.curve(bars, seen))).collect() if t.side == "long" and t.pnl is not None]
    assert long and tickets.views(bars, mode="vol_scaled").filter("target IS NOT NULL").count() == 460 - 262
    warm = tickets.decisions(bars, seen, tickets.curve(bars, seen), include_warmup=True).orderBy("bar_idx").first()
    assert warm.reasoning == "Insufficient history (1/263 daily bars) -> uncertain at confidence 0.30 -> maintain (no order); position 0.00 -> hold."
    with pytest.raises(ValueError):
        tickets.views(bars, mode="other")
