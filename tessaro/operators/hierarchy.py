"""Parent-child rows to whole hierarchies: tree contraction, Euler tours, list ranking.

1. peel()   exposes the cycles. Every round takes off the leaves and, where nodes form a chain,
   an independent part of it, so the rounds grow with the logarithm of the number of nodes,
   not with the depth. A node taken out of a chain lies on a cycle exactly if its only child does.
   A cycle shrinks to a node that is its own parent, which is then set aside.
2. tours()  cuts the cycles open, so that what is left is a forest, and writes down each
   tree's Euler tour as a linked list: one arc into and one arc out of every node.
3. rank()   ranks the lists in parallel: an independent third of the arcs is spliced out in each
   round (an arc that has a larger hash than its neighbours, the first of a list too), and lists
   of one arc are set aside, until few enough remain to be ranked in one task of bounded size,
   however many lists there are; then the rounds are undone in reverse.

The ranks of a node's two arcs give entry and exit. They nest, so descendants and ancestors are
intervals; the balance of in-arcs and out-arcs gives the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch

#: What one task may finish: arcs or nodes of 40 bytes each. So many rounds are taken before, however few there are.
LAST, ROUNDS = 1 << 18, 2


def _finish_peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    rows = pd.concat(parts, ignore_index=True)
    at = pd.Series(np.arange(len(rows)), index=rows["id"])
    parent = at.reindex(rows["parent"]).to_numpy(float)
    parent = np.where(np.isnan(parent), -1, parent).astype(np.int64)
    degree = np.bincount(parent[parent >= 0], minlength=len(rows))
    leaves = list(np.flatnonzero(degree == 0))
    alive = np.ones(len(rows), bool)
    while leaves:
        x = leaves.pop()
        alive[x] = False
        p = parent[x]
        if p >= 0:
            degree[p] -= 1
            if degree[p] == 0:
                leaves.append(p)
    yield pd.DataFrame({"id": rows["id"], "looped": alive})


def peel(spark: SparkSession, links: DataFrame, scratch: Scratch, last: int = LAST) -> DataFrame:
    """(id, parent) with a parent that is an id: the ids that lie on a cycle."""
    now, rounds = links, 0
    while (left := now.count()) > last or left and rounds < ROUNDS:
        # One exchange by id brings each node its number of children and, if there is one only, the child.
        as_child = now.select("id", "parent", F.lit(None).cast("bigint").alias("child"), F.lit(0).alias("n"))
        as_parent = now.select(F.col("parent").alias("id"), F.lit(None).cast("bigint").alias("parent"), F.col("id").alias("child"), F.lit(1).alias("n"))
        node = as_child.unionByName(as_parent).groupBy("id").agg(F.max("parent").alias("parent"), F.min("child").alias("child"), F.sum("n").alias("n"))
        coin = lambda c: F.xxhash64(F.col(c), F.lit(rounds))
        chained = (F.col("n") == 1) & (F.col("child") != F.col("id")) & (coin("id") > coin("child")) & (coin("id") > coin("parent"))
        node = scratch.keep(node.withColumn("kind", F.when(F.col("parent") == F.col("id"), "ring").when(F.col("n") == 0, "leaf").when(F.col("parent").isNotNull() & chained, "chain").otherwise("stay")), f"peel{rounds}")
        # A chain's node isn't next to another one: its child and parent stay or are leaves.
        chain = node.filter("kind = 'chain'").select(F.col("child").alias("id"), F.col("parent").alias("new"))
        stay = node.filter("kind = 'stay' AND parent IS NOT NULL").select("id", "parent")
        following = stay.join(chain, "id", "left").select("id", F.coalesce("new", "parent").alias("parent"))
        now = scratch.keep(following, f"links{rounds}")
        if rounds:
            scratch.drop(f"links{rounds - 1}")
        rounds += 1
    looped = now.repartition(1).mapInPandas(_finish_peel, "id bigint, looped boolean").filter("looped").select("id")
    looped = scratch.keep(looped, "looped")
    for k in reversed(range(rounds)):
        node = spark.read.parquet(scratch.path(f"peel{k}"))
        chain, ring = node.filter("kind = 'chain'").select("id", "child"), node.filter("kind = 'ring'").select("id")
        back = chain.join(looped.select(F.col("id").alias("child")), "child", "left_semi").select("id")
        looped = scratch.keep(looped.unionByName(back).unionByName(ring), f"looped{k}")
        scratch.drop(f"peel{k}", f"looped{k + 1}")
    return looped


def tours(forest: DataFrame) -> DataFrame:
    """(id, parent or null): the arcs (arc, next, prev, weight) of all Euler tours.

    The arc into node v is 2v, the arc out of it 2v + 1.
    """
    # Siblings are ordered by (stripe, id) and linked within stripes first, then end to end, so
    # that a node with a third of all others as its children is sorted by many tasks.
    child = forest.filter("parent IS NOT NULL").withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    within = Window.partitionBy("parent", "stripe").orderBy("id")
    child = child.withColumns({"older": F.lag("id").over(within), "younger": F.lead("id").over(within)})
    stripe = child.groupBy("parent", "stripe").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    across = Window.partitionBy("parent").orderBy("stripe")
    stripe = stripe.select("parent", "stripe", F.lag("high").over(across).alias("before"), F.lead("low").over(across).alias("beyond"))
    child = child.join(stripe, ["parent", "stripe"]).select(
        "id", "parent", "stripe", F.coalesce("older", "before").alias("older"), F.coalesce("younger", "beyond").alias("younger")
    )
    ends = child.groupBy("parent").agg(F.min(F.struct("stripe", "id"))["id"].alias("first"), F.max(F.struct("stripe", "id"))["id"].alias("last"))
    child = child.drop("stripe")
    roots = forest.filter("parent IS NULL").select("id", F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("older"), F.lit(None).cast("bigint").alias("younger"))
    node = child.unionByName(roots).join(ends.withColumnRenamed("parent", "id"), "id", "left")
    into, out = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    arcs = F.array(
        F.struct(
            into("id").alias("arc"), F.coalesce(into("first"), out("id")).alias("next"),
            F.coalesce(out("older"), into("parent")).alias("prev"), F.lit(1).cast("bigint").alias("weight"),
        ),
        F.struct(
            out("id").alias("arc"), F.coalesce(into("younger"), out("parent")).alias("next"),
            F.coalesce(out("last"), into("id")).alias("prev"), F.lit(-1).cast("bigint").alias("weight"),
        ),
    )
    return node.select(F.inline(arcs))


def _finish_rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pointer jumping over what is left: steps and balance from each arc to the end of its list."""
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    rows = pd.concat(parts, ignore_index=True)
    n = len(rows)
    at = pd.Series(np.arange(n), index=rows["arc"])
    jump = at.reindex(rows["next"].astype("Int64")).to_numpy(float)
    jump = np.where(np.isnan(jump), np.arange(n), jump).astype(np.int64)
    ends = jump == np.arange(n)
    steps, balance = rows["steps"].to_numpy(np.int64).copy(), rows["weight"].to_numpy(np.int64).copy()
    steps_on, balance_on = np.where(ends, 0, steps), np.where(ends, 0, balance)
    while not ends[jump].all():
        steps_on, balance_on = steps_on + steps_on[jump], balance_on + balance_on[jump]
        jump = jump[jump]
    arc = rows["arc"].to_numpy(np.int64)
    yield pd.DataFrame({"arc": arc, "end": arc[jump], "steps": steps_on + steps[jump], "balance": balance_on + balance[jump]})


def _taken(k: int) -> Column:
    """Of the arcs of round k: those spliced out, no two of them next to each other."""
    coin = lambda c: F.xxhash64(F.col(c), F.lit(k))
    return F.col("next").isNotNull() & (coin("arc") > coin("next")) & (F.col("prev").isNull() | (coin("arc") > coin("prev")))


#: A list that is one arc long.
_SINGLE = "next IS NULL AND prev IS NULL"


def rank(spark: SparkSession, arcs: DataFrame, scratch: Scratch, last: int = LAST) -> DataFrame:
    """(arc, end, steps, balance): the last arc of each arc's list and what lies from it to there, both included."""
    scratch.keep(arcs.withColumn("steps", F.lit(1).cast("bigint")), "arcs0")
    of_round = lambda k: spark.read.parquet(scratch.path(f"arcs{k}"))
    now, rounds = of_round(0).filter(f"NOT ({_SINGLE})"), 0
    while (left := now.count()) > last or left and rounds < ROUNDS:
        marked = now.withColumn("taken", _taken(rounds))
        none = F.lit(None).cast("bigint")
        stay = marked.filter("NOT taken").select("arc", "next", "prev", "weight", "steps", none.alias("new_next"), none.alias("new_prev"))
        out = marked.filter("taken")
        # A list's first arc has none ahead; the one behind it becomes the first, for which new_prev is -1.
        ahead = out.filter("prev IS NOT NULL").select(F.col("prev").alias("arc"), none.alias("next"), none.alias("prev"), "weight", "steps", F.col("next").alias("new_next"), none.alias("new_prev"))
        behind = out.select(F.col("next").alias("arc"), none.alias("next"), none.alias("prev"), F.lit(0).cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("steps"), none.alias("new_next"), F.coalesce("prev", F.lit(-1)).alias("new_prev"))
        merged = stay.unionByName(ahead).unionByName(behind).groupBy("arc").agg(
            F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.nullif(F.coalesce(F.max("new_prev"), F.max("prev")), F.lit(-1)).alias("prev"),
            F.sum("weight").alias("weight"), F.sum("steps").alias("steps"),
        )
        scratch.keep(merged, f"arcs{rounds + 1}")
        rounds += 1
        now = of_round(rounds).filter(f"NOT ({_SINGLE})")
    single = lambda k: of_round(k).filter(_SINGLE).select("arc", F.col("arc").alias("end"), "steps", F.col("weight").alias("balance"))
    done = now.repartition(1).mapInPandas(_finish_rank, "arc bigint, end bigint, steps bigint, balance bigint").unionByName(single(rounds))
    for k in reversed(range(rounds)):
        done = scratch.keep(done, f"ranked{k}")
        scratch.drop(f"ranked{k + 1}", f"arcs{k + 1}")
        out = of_round(k).filter(_taken(k)).select("arc", "next", F.col("steps").alias("own_steps"), "weight")
        after = done.select(F.col("arc").alias("next"), "end", "steps", "balance")
        back = out.join(after, "next").select("arc", "end", (F.col("own_steps") + F.col("steps")).alias("steps"), (F.col("weight") + F.col("balance")).alias("balance"))
        done = done.unionByName(back).unionByName(single(k))
    return done


#: A key is hot if more than this fraction of all rows have it (and more than a task may finish).
SHARE = 1024


def looked_up(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows with the facts of their key, null where there are none; facts has one row per key.

    hot holds the facts of hot keys, of which there are at most SHARE, so that it may be broadcast:
    what a third of all rows refer to isn't exchanged by its key.
    """
    columns = [c for c in facts.columns if c != key]
    known = F.broadcast(hot.select(key, F.struct(*columns).alias("_hot")))
    first = rows.join(known, key, "left")
    # Rows that are done already are spread over salts that no facts have.
    rest = first.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SHARE))).cast("int"))
    both = rest.join(facts.select(key, F.lit(0).alias("_salt"), F.struct(*columns).alias("_facts")), [key, "_salt"], "left")
    return both.select(*rows.columns, *(F.coalesce(F.col("_hot")[c], F.col("_facts")[c]).alias(c) for c in columns))


def hierarchies(spark: SparkSession, links: DataFrame, node: str, parent: str, *, last: int = LAST) -> DataFrame:
    """One row per distinct non-null node: (node, root_id, depth, tree, entry, leave, looped).

    links must have one row per node. A null parent, or one that is no node, makes a root. A node
    on a cycle (also of itself alone), or below one, has depth -1, root_id null and looped true;
    its tree is then that of the cycle's node it hangs on. entry and leave are its first and last
    position in its tree's tour: x descends from y if both have the same tree and
    y.entry < x.entry <= y.leave, so the subtree of y has (leave - entry + 1) / 2 nodes. Only the
    two named columns are read; further columns, of whatever name, do no harm. An empty table
    gives an empty result. Of several rows of a node, the one with the smallest parent counts,
    a null parent coming first.
    """
    scratch = Scratch(spark, "hierarchy")
    raw = links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("up")).filter("node IS NOT NULL")
    raw = raw.groupBy("node").agg(F.min(F.struct(F.col("up").isNotNull(), F.col("up"))).alias("m")).select("node", "m.up")
    # Dense 64-bit numbers in place of texts from here on; the numbering is written, so it can't change.
    ids = scratch.keep(raw.withColumn("id", F.monotonically_increasing_id()), "ids")
    above = ids.select(F.col("node").alias("up"), F.col("id").alias("parent"))
    many = max(last, ids.count() // SHARE)
    broods = ids.groupBy("up").agg(F.count("*").alias("_n")).filter(F.col("up").isNotNull() & (F.col("_n") > many)).select("up")
    numbered = scratch.keep(looked_up(ids, above, above.join(broods, "up", "left_semi"), "up").select("id", "parent"), "numbered")
    looped = peel(spark, numbered.filter("parent IS NOT NULL"), scratch, last).withColumn("on_cycle", F.lit(True))
    opened = numbered.join(looped, "id", "left").select("id", F.when(F.col("on_cycle").isNull(), F.col("parent")).alias("parent"))
    ranked = rank(spark, tours(opened), scratch, last)
    # An arc's balance to the end, itself included, is minus the depth for the arc in, and one less for the arc out.
    spans = ranked.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.max(F.shiftright("end", 1)).alias("root"), F.max("steps").alias("to_end_in"), F.min("steps").alias("to_end_out"),
        F.max(F.when(F.col("arc") % 2 == 0, -F.col("balance"))).alias("depth"),
    )
    spans = scratch.keep(spans, "spans")
    trees = spans.filter("id = root").select("root", F.col("to_end_in").alias("length"))
    names = ids.select(F.col("id").alias("root"), F.col("node").alias("tree"))
    roots = trees.join(names, "root").join(looped.withColumnRenamed("id", "root"), "root", "left")
    placed = looked_up(spans, roots, roots.filter(F.col("length") > 2 * many), "root").filter("length IS NOT NULL")
    named = placed.join(ids.select("id", "node"), "id")
    is_looped = F.coalesce("on_cycle", F.lit(False))
    return named.select(
        F.col("node").alias(node), F.when(~is_looped, F.col("tree")).alias("root_id"), F.when(is_looped, F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        "tree", (F.col("length") - F.col("to_end_in")).alias("entry"), (F.col("length") - F.col("to_end_out")).alias("leave"), is_looped.alias("looped"),
    )


def lineages(spark: SparkSession, links: DataFrame, of: DataFrame, node: str, parent: str) -> DataFrame:
    """Every (node, ancestor, distance) of hierarchies(spark, links, node, parent) = of, distance 0 being the node itself.

    By doubling: what lies up to 2^k above, together with what lies up to 2^k above that which is
    exactly 2^k above, is all up to 2^(k+1), each pair once. So the rounds grow with the logarithm
    of the depth and every table is at most as large as the answer. A node on a cycle has no ancestor.
    """
    scratch = Scratch(spark, "lineages")
    up = links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("up"))
    up = up.groupBy("node").agg(F.min(F.struct(F.col("up").isNotNull(), F.col("up"))).alias("m")).select("node", F.col("m.up").alias("ancestor"))
    known = of.select(F.col(node).alias("node"), (F.col("looped") & (F.col(node) == F.col("tree"))).alias("on_cycle"))
    above = up.join(known.filter("NOT on_cycle"), "node", "left_semi").join(known.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    pairs, k = scratch.keep(above.select("node", "ancestor", F.lit(1).cast("bigint").alias("distance")), "pairs0"), 0
    while not (far := pairs.filter(F.col("distance") == 1 << k)).isEmpty():
        beyond = pairs.select(F.col("node").alias("middle"), F.col("ancestor").alias("over"), F.col("distance").alias("more"))
        longer = far.withColumnRenamed("ancestor", "middle").join(beyond, "middle").select("node", F.col("over").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = scratch.keep(pairs.unionByName(longer), f"pairs{k + 1}")
        scratch.drop(f"pairs{k}")
        k += 1
    own = known.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("distance"))
    return pairs.unionByName(own).withColumnRenamed("node", node)


def paths(steps: DataFrame, node: str) -> DataFrame:
    """Of lineages(): (node, path), the nodes from the root, or from the cycle's node that it hangs on, down to itself."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "ancestor")))
    return steps.groupBy(node).agg(F.transform(ordered, lambda s: s["ancestor"]).alias("path"))


def descendants(steps: DataFrame, node: str) -> DataFrame:
    """Of lineages(): (node, descendant, distance), a row for everything below a node."""
    return steps.filter("distance > 0").select(F.col("ancestor").alias(node), F.col(node).alias("descendant"), "distance")
