"""Queries against DuckDB on the smallest tables, a row of each group; the driver holds all of them."""

import math
import os

import duckdb
import pytest

from tessaro.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
PICKED = ("bars_1h", "op_correlation", "alpha_009", "ic_h1_h24", "yang_zhang", "tsmom_regime", "ema_cross", "micro_section", "trade_flow", "lake_trade_flow", "grid_replay", "inventory_skew", "book_pressure", "ewma_beta", "funding_z", "candles_technical", "fee_after", "holdout_split", "ladder", "weight_engine_single", "weight_engine_multi", "discrete_engine_multi", "tickets", "metrics", "replay_asof", "dedupe_last_wins", "p4_found", "p5_found", "p6_found")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", PICKED)
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    at = [[x[0] for x in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert len(got) == len(want) and got == want


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_the_null_band(spark):
    """The published percentiles of 380 correlations on 20 walks; here, other than there, values that differ by float noise tie."""
    from tessaro.plans.factors import FACTORS
    from tessaro.plans.search_queries import QUERIES

    band = {r.factor_id: r for r in QUERIES["null_band"](spark, "").collect()}
    pooled = band.pop("pooled")
    assert {*band} == {*FACTORS} and pooled.n == 380
    assert max(abs(a - b) for a, b in zip((pooled.p50, pooled.p95, pooled.p99), (0.0377, 0.1227, 0.1956))) < 0.00015


def test_the_registered_search_makes_all_proposals(spark, monkeypatch):
    from tessaro.operators import search
    from tessaro.plans import expr
    from tessaro.plans.search_queries import QUERIES

    monkeypatch.setattr(search, "measures", lambda *rest: {})
    assert QUERIES["search_run"](spark, "").count() == len(expr.SEEDS) + 8 * 6
