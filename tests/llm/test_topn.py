import pytest

from tessaro.llm.topn import top_n_per_group

SCHEMA = "family string, expr_id string, s double, rank string"


def top(spark, rows, n=3, **more):
    out = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "family", "s", "expr_id", n, **more)
    return sorted((r.family, r["rank"], r.expr_id, r.s) for r in out.collect())


def test_ties_nulls_repeats_and_short_groups(spark):
    rows = [("f", "b", 1.0, ""), ("f", "a", 1.0, ""), ("f", "a", 1.0, ""), ("f", "c", 0.5, ""), ("f", "d", 0.4, ""), ("f", "d", 0.9, ""), ("g", "x" * 3000, -1.0, ""),
            (None, "a", 9.0, ""), ("f", None, 9.0, ""), ("f", "z", None, ""), ("f", "z", float("nan"), ""), ("", "e", 0.0, "")]
    assert top(spark, rows) == [("", 1, "e", 0.0), ("f", 1, "a", 1.0), ("f", 2, "b", 1.0), ("f", 3, "d", 0.9), ("g", 1, "x" * 3000, -1.0)]


def test_a_hot_group_against_sorting(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 997)) AS family", "cast(id AS string) AS expr_id", "cast(pmod(hash(id), 50) AS double) AS s")
    want = {}
    for r in df.collect():
        want.setdefault(r.family, []).append((-r.s, r.expr_id))
    for salts in (1, 7):
        got = {}
        for r in top_n_per_group(df, "family", "s", "expr_id", 4, salts=salts).collect():
            got.setdefault(r.family, []).append((-r.s, r.expr_id))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:4] for k, v in want.items()}


def test_nothing_and_wrong_arguments(spark):
    assert top(spark, []) == []
    df = spark.createDataFrame([], SCHEMA)
    for bad in (dict(n=0), dict(n=1, salts=0)):
        with pytest.raises(ValueError):
            top_n_per_group(df, "family", "s", "expr_id", **bad)
    with pytest.raises(ValueError):
        top_n_per_group(df, "family", "s", "rank", 1)
