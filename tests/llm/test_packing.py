import itertools
import random

import numpy as np
import pytest

from tessaro.llm.packing import EXACT, Limits, best_fit, bin_completion, fillings, lower_bound, pack


def counts(sizes, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for s in sizes:
        out[s] += 1
    return out


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_small_cases_against_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice((10, 20, 50))
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        c = counts(sizes, capacity)
        packing, need, proven = bin_completion(c)
        used, got = sum(t for _, t in packing), np.zeros_like(c)
        for filling, times in packing:
            assert sum(s * n for s, n in filling.items()) <= capacity
            for s, n in filling.items():
                got[s] += n * times
        best = optimum(sizes, capacity)
        assert (got == c).all() and need <= best <= used <= sum(t for _, t in best_fit(c)) and used == best and (not proven or need == used)


def test_search_beats_best_fit_where_it_can():
    c = counts([6, 5, 4, 4, 4, 3, 2, 2] * 1, 10)
    assert sum(t for _, t in bin_completion(c)[0]) == lower_bound(c) == 3
    rng = random.Random(2)
    hard = counts([rng.randint(26, 50) for _ in range(300)], 100)
    assert sum(t for _, t in bin_completion(hard, Limits(nodes=500))[0]) < sum(t for _, t in best_fit(hard))


def test_fillings_are_undominated():
    left = counts([7, 3, 2, 2, 1], 10)
    assert fillings(left)[0][0] == {7: 1, 3: 1}
    for a, b in itertools.permutations(fillings(left)[0], 2):
        assert a != b
    assert fillings(left, EXACT)[1] and not fillings(counts([9, *range(1, 9)] * 3, 30), Limits(breadth=1, width=None))[1]


def test_the_exact_way_is_proven(spark):
    rng = random.Random(7)
    for _ in range(40):
        capacity = rng.choice((12, 30, 60))
        sizes = sorted((rng.randint(capacity // 6, capacity // 2 + 2) for _ in range(rng.randint(3, 9))), reverse=True)
        packing, _, proven = bin_completion(counts(sizes, capacity), EXACT)
        assert proven and sum(t for _, t in packing) == optimum(sizes, capacity)
    df = spark.createDataFrame([(i, s) for i, s in enumerate([6, 6, 6, 4, 4, 3, 3, 3])], "doc_id bigint, n_tokens bigint")
    out, summary = pack(spark, df, 13, limits=EXACT)
    assert summary["proven"] and out.select("container_id").distinct().count() == summary["containers"] == 3


def test_table(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 5), (4, None), (5, 0), (6, 7), (6, 7), (None, 3), (7, 1000)], "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' AS size", "1 AS container_id")
    out, summary = pack(spark, df, 10)
    rows = out.collect()
    load = {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.size
        assert r.start == r.piece * 10 and (r.piece == 0 or r.doc_id in (2, 7))
    assert max(load.values()) <= 10 and sorted(load) == list(range(summary["containers"])) and summary["proven"]
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
    assert total == {1: 10, 2: 25, 3: 5, 6: 14, 7: 1000} and sum(load.values()) == summary["used"]
    empty, summary = pack(spark, df.limit(0), 10)
    assert empty.count() == 0 and summary["containers"] == 0
    with pytest.raises(ValueError):
        pack(spark, df, 0)


def test_a_size_that_most_have(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 1 + id % 7, 4) AS n_tokens")
    out, summary = pack(spark, df, 12)
    assert out.count() == 3000 and out.groupBy("container_id").sum("size").agg({"sum(size)": "max"}).first()[0] <= 12
    assert summary["containers"] == summary["lower_bound"]
