"""Formulas by numbers that were worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessaro.functions import recursion, volatility
from tessaro.operators import evaluation as ev
from tessaro.operators import microstructure as micro
from tessaro.operators import quoting, technical
from tessaro.plans import expr, stretches
from tessaro.plans.compiler import evaluate
from tessaro.plans.factors import FACTORS
from tessaro.sources import synthetic

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)


def one(spark, **columns):
    """The values of columns that need no table."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def lit(x):
    return F.lit(float(x))


def books(spark, rows):
    """rows: (snap, bids, asks) with [(px, sz), ...] per side."""
    names = [f"{side}_{what}_{i}" for i in range(1, 11) for side in ("bid", "ask") for what in ("px", "sz")]
    flat = []
    for at, bids, asks in rows:
        cells = {}
        for side, levels in (("bid", bids), ("ask", asks)):
            for i, (px, sz) in enumerate(levels, 1):
                cells[f"{side}_px_{i}"], cells[f"{side}_sz_{i}"] = px, sz
        flat.append(("p", T0 + dt.timedelta(seconds=at), at, *(cells.get(n) for n in names)))
    return micro.with_levels(spark.createDataFrame(flat, "product_id string, ts timestamp, seq bigint, " + ", ".join(f"{n} double" for n in names)))


def test_pressure_and_quotes(spark):
    two = [(100.0, 5.0), (99.0, 3.0)], [(101.0, 2.0), (102.0, 4.0)]
    got = books(spark, [(0, *two), (1, [], two[1]), (2, [(100.0, 0.0)], [(101.0, 0.0)]), (3, [(100.0, 1.0)], [(100.5, 1.0)]), (4, [(math.nan, 1.0), (99.0, 3.0)], two[1])])
    rows = got.select("seq", micro.pressure().alias("p"), micro.depth_ratio().alias("d"), *(c.alias(n) for n, c in micro.quotes().items())).orderBy("seq").collect()
    assert rows[0].p == near(2.5 / 10.5) and rows[0].d == near(8 / 14) and rows[0].queue_imbalance == near(3 / 7)
    assert rows[1].p is rows[1].d is rows[1].spread_bps is None and rows[2].p is None and rows[2].queue_imbalance is None
    assert rows[3].spread_bps == near(50) and rows[0].micro == near((101 * 5 + 100 * 2) / 7)
    assert rows[4].queue_imbalance is None and rows[4].p is not None  # the best level can't be used; the others can


def test_flow_imbalance(spark):
    start = ([(100.0, 5.0)], [(101.0, 7.0)])
    for after, want in (([(100.5, 4.0)], [(101.5, 6.0)]), 11.0), (([(100.0, 8.0)], [(101.0, 4.0)]), 6.0), (([(99.0, 2.0)], [(100.5, 3.0)]), -8.0):
        rows = micro.flow_imbalance(books(spark, [(0, *start), (1, *after)]), ["product_id"], ["ts", "seq"]).orderBy("seq").collect()
        assert rows[0].ofi is None and rows[1].ofi == near(want)


def trades(spark, rows):
    return spark.createDataFrame([("p", T0 + dt.timedelta(minutes=40 * i), i, *r) for i, r in enumerate(rows)], "product_id string, ts timestamp, seq bigint, price double, size double, side string")


def test_trade_flow_and_impact(spark):
    got = micro.trade_flow(trades(spark, [(100.0, 2.0, "BUY"), (100.1, 1.0, "SELL"), (100.2, 1.0, "buy"), (1.0, 9.0, "?"), (1.0, 0.0, "buy"), (1.0, None, "buy")]), ["product_id"], ["ts", "seq"]).first()
    assert (got.n, got.tfi, got.cvd, got.accel, got.intensity, got.large_share) == (3, 0.5, 2.0, -1.0, 3.0, 0.0)
    assert micro.trade_flow(trades(spark, [(1.0, s, "b") for s in (1.0, 1.0, 1.0, 10.0)]), ["product_id"], ["ts", "seq"]).first().large_share == near(10 / 13)
    assert micro.trade_flow(trades(spark, [(1.0, 2.0, "ask")]), ["product_id"], ["ts", "seq"]).first().accel == 0.0
    assert micro.kyle_lambda(trades(spark, [(100.0, 1.0, "buy"), (101.0, 4.0, "sell")]), ["product_id"], ["ts", "seq"]).first().kyle_lambda == near(20)
    assert micro.kyle_lambda(trades(spark, [(100.0, 1.0, "buy")]), ["product_id"], ["ts", "seq"]).first().kyle_lambda is None


def test_costs(spark):
    r = one(spark, a=quoting.required_move_bps(lit(190)), b=quoting.required_move_bps(lit(190), 1.5), m=quoting.maker_roundtrip_bps(lit(60)), s=quoting.mid_spread_bps(lit(0), lit(10)), e=quoting.mid_spread_bps(lit(10), lit(10)), t=quoting.roundtrip_cost_bps(lit(-1), lit(0), lit(0)))
    assert (r.a, r.b, r.m, r.s, r.e, r.t) == (380.0, 285.0, 120.0, None, 0.0, None)
    assert {x.preset: x.roundtrip_bps for x in quoting.cost_table(spark).collect()} == {"retail_venue_markup_2026-08": 190.0, "exchange_intro_taker": 242.0}
    r = one(spark, a=quoting.spread_capture_bps(lit(1), lit(60), lit(0)), b=quoting.spread_capture_bps(lit(60), lit(60), lit(0)), g=quoting.anchor_gap_bps(lit(99.9), lit(100)), n=quoting.roundtrip_net_bps(lit(100), lit(190)))
    assert r.a == near(-118) and r.b == 0 and r.g == near(-10) and r.n == -90


def test_skew_and_ladder(spark):
    def skew(base, quote, price, target, width):
        return tuple(one(spark, **dict(zip("ba", quoting.inventory_skew(lit(base), lit(quote), lit(price), lit(target), lit(width))))))

    assert skew(0.0, 9000, 9000, 0.5, 0.1) == (2.0, 0.0) and skew(2.0, 0, 9000, 0.5, 0.5) == (0.0, 2.0)
    # total 1.3, target 0.65, lower end held at 0: (0.65 - 0.3) / 0.65
    assert skew(0.3, 9000, 9000, 0.5, 0.7) == (near(1 + 0.35 / 0.65), near(1 - 0.35 / 0.65))
    # total 2.1, target 1.05, upper end 1.55
    assert skew(1.1, 9000, 9000, 0.5, 0.5) == (near(1 - 0.05 / 0.5), near(1 + 0.05 / 0.5))
    assert skew(0.0, 0, 9000, 0.5, 0.5) == (1.0, 1.0) and skew(-1.0, 0, 9000, 0.5, 0.5) == (None, None)
    r = one(spark, **dict(zip(("bids", "asks"), quoting.ladder(lit(100), lit(10), lit(5), 3))))
    assert r.bids == [near(99.9), near(99.85), near(99.8)] and r.asks == [near(100.1), near(100.15), near(100.2)]


def test_grid(spark):
    def run(prices, levels, quantity, **more):
        return quoting.replay_grid(spark.createDataFrame([("p", i, p) for i, p in enumerate(prices)], "product_id string, bar_idx int, close double"), levels, quantity, **more).first()

    r = run([100.0, 99.0, 100.0], [98.0, 99.0, 100.0, 101.0, 102.0], 1.0)
    assert (r.buys, r.sells, r.roundtrips, r.final_inventory, r.realized_cash, r.total_pnl) == (1, 1, 1, 0.0, 1.0, 1.0)
    assert run([100.0, 99.0, 100.0], [98.0, 99.0, 100.0, 101.0, 102.0], 1.0, fee_bps=60.0).realized_cash == near(1 - 0.006 * 199)
    r = run([100.0, 95.0, 90.0], [90.0 + k for k in range(21)], 0.5)
    assert (r.buys, r.sells, r.final_inventory, r.inventory_mark, r.max_inventory) == (10, 0, 5.0, 450.0, 5.0) and r.total_pnl < 0
    r = run([100.0, 102.0, 101.0], [99.0, 100.0, 101.0, 102.0, 103.0], 1.0, start=2.0)
    # both sales above fill at 102; the upper one arms a purchase at 101, which then fills
    assert (r.buys, r.sells, r.final_inventory, r.realized_cash) == (1, 2, 1.0, 102.0)
    assert run([100.0], [99.0, 101.0], 1.0) is None
    with pytest.raises(ValueError):
        run([100.0, 99.0], [99.0, 99.0], 1.0)


def closes(spark, values, product="p"):
    return spark.createDataFrame([(product, i, float(v) + 0.5, float(v) + 1, float(v) - 1, float(v), 1.0) for i, v in enumerate(values)], "product_id string, bar_idx int, open double, high double, low double, close double, volume double")


def test_crossings(spark):
    r = technical.ema_cross(closes(spark, [100.0] * 22 + [110.0, 120.0, 130.0])).first()
    assert (r.state, r.recent_cross) == ("bullish", "golden")  # from equality
    assert tuple(technical.ema_cross(closes(spark, [100.0] * 21)).first())[1:] == (None, None, None, None)
    assert technical.ema_cross(closes(spark, range(200, 160, -1))).first().state == "bearish"
    assert technical.ema_cross(closes(spark, [100.0] * 30)).first().state == "flat"
    s = technical.candle_summary(closes(spark, range(100, 110))).first()
    assert (s.candles_used, s.first_close, s.last_close, s.change_pct, s.range_pct, s.rsi_14, s.ema_9) == (10, 100.0, 109.0, 9.0, 11.11, None, None)


def test_beta(spark):
    # constant returns of 2 and 1 per mille: uncentred, the raw beta is 2
    rows = spark.createDataFrame([("p", i, 0.002, 0.001) for i in range(100)] + [("q", i, 0.002, 0.0) for i in range(100)], "product_id string, bar_idx int, asset double, bench double")
    got = {(r.product_id, r.bar_idx): r.beta for r in recursion.ewma_beta(rows).collect()}
    assert got["p", 88] == 1.0 and got["p", 89] == near(2 / 3 * 2 + 1 / 3) and got["q", 99] == 1.0


def test_labels_and_funding(spark):
    base = [0.0001 + 0.00001 * ((i % 5) - 2) for i in range(1500)]
    rows = [(k, i, r) for k, last in (("up", 0.001), ("down", -0.001)) for i, r in enumerate([*base, last])] + [("flat", i, 0.0001) for i in range(100)] + [("one", 0, 0.0001)]
    got = {r.k: r for r in volatility.funding_summary(spark.createDataFrame(rows, "k string, i int, rate double"), ["k"], ["i"]).collect()}
    assert got["up"].samples == 1500 and got["up"].z > 3 and got["up"].pct == 1.0 and got["up"].regime == "extremely_positive"
    assert got["down"].regime == "extremely_negative" and got["flat"].z is None and (got["flat"].pct, got["flat"].median, got["flat"].regime) == (0.5, 0.0001, "neutral")
    assert got["one"].regime == "insufficient_history" and got["one"].annual_pct == 10.95
    z = [x[0] for x in spark.createDataFrame([(None,), (2.0,), (1.0,), (0.9,), (-1.0,), (-2.0,)], "z double").select(volatility.z_label(F.col("z"))).collect()]
    assert z == ["insufficient_data", "extremely_high", "high", "neutral", "low", "extremely_low"]


def test_text_form():
    assert expr.expr_id(expr.parse("-1 * delta(close, 1)")) == "12c9a2980df7"
    assert expr.to_text(expr.parse("signedpower(close, 2)")) == "signedpower(close, 2.0)"
    assert [expr.to_text(n) for n, _ in expr.seed_nodes()] == [t for t, _ in expr.SEEDS]
    for text, why, caps in (
        ("close", "bare_terminal", {}), ("abs(abs(abs(abs(abs(close)))))", "too_deep", {}), ("ts_rank(sma(stddev(returns, 5), 5), 5)", "too_nested", {}), ("sma(close, 60)", "warmup", {"max_warmup": 40}),
        ("close + open + high + low + volume + returns + vwap", "too_big", {"max_depth": 20}), ("-1 * delta(close, 1)", None, {}),
    ):
        assert expr.validate(expr.parse(text), **caps) == why


def test_stretches_change_nothing(spark):
    """One product holds nine tenths of all bars; cut into stretches, every result is what it is uncut."""
    walk = synthetic.walks(spark, [4], 3000, sigma=0.01).drop("seed").unionByName(synthetic.walks(spark, [5], 300, sigma=0.01).drop("seed")).cache()
    nodes = {k: f.node for k, f in FACTORS.items()} | {"y24": ("forward", 24)}
    whole, cut = ({(r.product_id, r.bar_idx): r for r in evaluate(walk, nodes, span).collect()} for span in (None, 400))
    for key, r in whole.items():
        for n in nodes:
            a, b = r[n], cut[key][n]
            # rolling sums begin elsewhere, so the last digits of what cancels out may differ
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)), (key, n)
    assert len(whole) == len(cut) == 3300
    sizes = [r["count"] for r in stretches.stretched(walk, 295, 24, 400).groupBy("product_id", "_stretch").count().collect()]
    assert max(sizes) <= 400 + 295 + 24
    for make in (
        lambda span: recursion.ewma_volatility(walk, {"a": 5, "b": 3}, 365.0, span=span), lambda span: recursion.ema(walk, {"a": 9}, span=span), lambda span: recursion.rsi_wilder(walk, "a", 3, span=span),
        lambda span: volatility.momentum_z(walk, 24, span=span).select("product_id", "bar_idx", F.col("z").alias("a")), lambda span: volatility.volatility_state(walk, span=span).select("product_id", "bar_idx", F.col("pct").alias("a")),
    ):
        one, many = ({(r.product_id, r.bar_idx): r.a for r in make(span).collect()} for span in (None, 600))
        assert len(one) == len(many) == 3300 and all((one[k] is None) == (many[k] is None) and (one[k] is None or math.isclose(one[k], many[k], rel_tol=1e-9, abs_tol=2e-3 if one[k] == round(one[k], 3) else 1e-9)) for k in one)


def test_ranks_of_hot_groups(spark):
    """Ranks in parts equal plain ranks, also with ties, nulls in the key and values of any magnitude."""
    rows = [(g, float(v % 97) * scale, math.sin(v)) for g, n, scale in (("hot", 3000, 1e-9), (None, 400, 1.0), ("small", 50, 1e6)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double").cache()
    plain, parts = ({r.g: (r.n, r.rho) for r in ev.spearman(df, ["g"], most=most).collect()} for most in (1 << 20, 100))
    assert plain.keys() == parts.keys() and all(plain[g][0] == parts[g][0] and plain[g][1] == near(parts[g][1]) for g in plain)


def test_correlation_does_not_depend_on_the_price_level(spark):
    rows = [(f"x{k}", i, *(x * k for x in bar[:4]), bar[4]) for k in (1.0, 1e-10, 1e6) for i, bar in enumerate(synthetic.path(3, 400, sigma=0.01))]
    df = spark.createDataFrame(rows, "product_id string, bar_idx int, open double, high double, low double, close double, volume double")
    got = {r.product_id: (r.n, r.ic) for r in ev.information(df, {"d": ("neg", ("delta", "close", 1))}, [1]).collect()}
    assert len(got) == 3 and len(set(got.values())) == 1
