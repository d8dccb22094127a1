import random

from tessaro.operators.hierarchy import descendants, hierarchies, lineages, paths
from tessaro.session import Scratch


def brute(parent, x):
    seen, d = set(), 0
    while True:
        if x in seen:
            return None, -1
        seen.add(x)
        p = parent.get(x)
        if p is None or p not in parent:
            return x, d
        x, d = p, d + 1


def forest(n, seed):
    rng = random.Random(seed)
    parent = {}
    for i in range(n):
        r = rng.random()
        parent[f"n{i}"] = None if r < 0.05 else f"n{rng.randrange(max(1, i))}" if r < 0.4 else f"n{i - 1}" if i and r < 0.97 else "gone" if r < 0.98 else f"n{rng.randrange(n)}"
    parent |= {"self": "self", "a": "b", "b": "c", "c": "a", "below": "a"}
    parent |= {f"star{i}": "n0" for i in range(200)}
    return parent


def run(spark, parent, last=1 << 18):
    return hierarchies(spark, spark.createDataFrame(list(parent.items()), "x string, p string"), "x", "p", last=last)


def test_against_brute_force_in_one_task_and_contracted(spark):
    parent = forest(1500, 4)
    for last in (1 << 18, 1500):
        rows = run(spark, parent, last).collect()
        assert {r.x: (r.root_id, r.depth) for r in rows} == {x: brute(parent, x) for x in parent}
        assert all(r.looped == (r.depth < 0) for r in rows)


def test_intervals_paths_and_descendants(spark):
    parent = {"r": None, "a": "r", "b": "a", "c": "a", "d": "r", "s": None}
    nodes = run(spark, parent).cache()
    by = {r.x: r for r in nodes.collect()}
    assert (by["r"].leave - by["r"].entry + 1) // 2 == 5
    steps = lineages(spark, spark.createDataFrame(list(parent.items()), "x string, p string"), nodes, "x", "p").cache()
    got = {(r.x, r.descendant, r.distance) for r in descendants(steps, "x").collect()}
    assert got == {("r", "a", 1), ("r", "b", 2), ("r", "c", 2), ("r", "d", 1), ("a", "b", 1), ("a", "c", 1)}
    assert got == {(y.x, x.x, x.depth - y.depth) for x in by.values() for y in by.values() if x.tree == y.tree and y.entry < x.entry <= y.leave}
    assert {(r.x, "/".join(r.path)) for r in paths(steps, "x").collect()} == {("r", "r"), ("a", "r/a"), ("b", "r/a/b"), ("c", "r/a/c"), ("d", "r/d"), ("s", "s")}


def test_one_parent_of_most_nodes(spark):
    parent = {"hub": None} | {f"n{i}": "hub" for i in range(3000)} | {f"m{i}": f"n{i}" for i in range(500)}
    got = {r.x: (r.root_id, r.depth) for r in run(spark, parent, 200).collect()}  # the hub and its tree are hot
    assert got == {x: ("hub", 0 if x == "hub" else 1 if x[0] == "n" else 2) for x in parent}


def test_more_trees_and_cycles_than_one_task_may_finish(spark, monkeypatch):
    written, keep = [], Scratch.keep

    def counted(self, df, name):
        written.append(name)
        assert len(written) < 80, "the rounds don't end"
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", counted)
    parent = {f"r{i}": None for i in range(300)} | {f"c{i}": f"r{i}" for i in range(200)}
    assert {r.x: (r.root_id, r.depth) for r in run(spark, parent, 60).collect()} == {x: brute(parent, x) for x in parent}
    written.clear()
    parent = {f"s{i}": f"s{i}" for i in range(80)} | {f"{a}{i}": f"{b}{i}" for i in range(80) for a, b in ("uv", "vu", "wu")} | {"r": None, "c": "r"}
    assert {r.x: (r.root_id, r.depth) for r in run(spark, parent, 60).collect()} == {x: brute(parent, x) for x in parent}


def test_nulls_repeats_clashing_columns_and_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "a", 3), (None, "a", 4), ("", "a", 5), ("x" * 5000, "b", 6)], "id string, parent string, arc int")
    got = {r.id: (r.root_id, r.depth) for r in hierarchies(spark, df, "id", "parent").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "": ("a", 1), "x" * 5000: ("a", 2)}
    assert hierarchies(spark, df.limit(0), "id", "parent").count() == 0


def test_all_lineages_against_brute_force(spark):
    parent = forest(600, 5)
    links = spark.createDataFrame(list(parent.items()), "x string, p string")
    want = set()
    for x in parent:
        at, d, seen = x, 0, []
        while at in parent:
            seen.append(at)
            want.add((x, at, d))
            up, over = parent[at], set()
            while up in parent and up not in over and up != at:
                over.add(up)
                up = parent[up]
            if up == at:  # a cycle's node ends the path
                break
            at, d = parent[at], d + 1
    got = [tuple(r) for r in lineages(spark, links, run(spark, parent), "x", "p").select("x", "ancestor", "distance").collect()]
    assert len(got) == len(want) and {*got} == want


def test_paths_and_descendants_are_queries():
    from tessaro.plans.found import QUERIES

    assert {"p4_paths", "p4_descendants"} <= {*QUERIES}
