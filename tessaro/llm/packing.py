"""Filling containers of a fixed capacity with whole documents by bin completion.

What fits with what depends on sizes only, and there are no more sizes than the capacity. So the
corpus is reduced to how many items each size has; on these numbers a branch-and-bound search
enumerates undominated fillings around the largest item, prunes by waste bounds and keeps a
best-fit solution as its incumbent. A filling is used as often as the numbers allow, so the
search is as long for 100 TB as for a page. Documents then take their places by their rank among
those of their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .encode import spread, transducer

#: A filling: how many items of each size, and how many containers are filled like that.
Filling = tuple[dict[int, int], int]


def lower_bound(counts: np.ndarray) -> int:
    """Containers that are needed whatever one does: counts[s] items of size s, capacity len(counts) - 1.

    For every threshold, items too large to share with those above it force waste.
    """
    cap = len(counts) - 1
    sizes = np.arange(cap + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    a = np.arange(0, cap // 2 + 1)
    below = np.maximum(a - 1, 0)
    alone = number[cap] - number[cap - a]
    large = number[cap - a] - number[cap // 2]
    room = large * cap - (weight[cap - a] - weight[cap // 2])
    small = weight[cap // 2] - np.where(a > 0, weight[below], 0)
    return int((alone + large + np.maximum(0, -((room - small) // cap))).max())


def best_fit(counts: np.ndarray) -> list[Filling]:
    """Best-fit decreasing on numbers of items: the largest size that still fits, again and again."""
    left, cap, out = counts.copy(), len(counts) - 1, []
    while (at := np.flatnonzero(left)).size:
        room, filling = cap, {}
        while at.size:
            s = int(at[-1])
            n = min(int(left[s]), room // s)
            filling[s] = n
            room -= n * s
            at = at[: np.searchsorted(at, min(s - 1, room), side="right")]
        times = min(int(left[s]) // n for s, n in filling.items())
        for s, n in filling.items():
            left[s] -= n * times
        out.append((filling, times))
    return out


class Limits(NamedTuple):
    """What a search may spend; null is no limit.

    nodes: states of the branch and bound. width: fillings kept around an item. tries: steps to
    enumerate them. breadth: sizes tried next within a filling. bulk: a filling is used as often
    as the numbers allow, and not once at a time.
    """

    nodes: int | None = 4_000
    width: int | None = 4
    tries: int | None = 600
    breadth: int | None = 12
    bulk: bool = True


#: Every undominated filling, one container at a time, to the end: the optimum, whatever it takes.
EXACT = Limits(None, None, None, None, False)


def fillings(left: np.ndarray, limits: Limits = Limits()) -> tuple[list[dict[int, int]], bool]:
    """Undominated fillings around the largest item, the least waste first, and whether they are all.

    A filling to which a further item could be added, or one of whose items could be replaced by
    a larger one, is dominated. The search goes from large items to small; with a width it ends
    early at so many fillings without waste.
    """
    at = np.flatnonzero(left)
    first, cap = int(at[-1]), len(left) - 1
    number = {int(s): int(left[s]) for s in at}
    number[first] -= 1
    sizes = at.tolist()
    found: list[tuple[int, tuple[int, ...]]] = []
    tries, whole, full = 0, True, 0

    def search(room: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal tries, whole, full
        if limits.tries is not None and tries >= limits.tries:
            whole = False
            return
        tries += 1
        if not room or number.get(room, 0) > 0 and room <= top:
            # What fills the room with one item dominates all that fill it with several.
            found.append((0, chosen + ((room,) if room else ())))
            full += 1
            return
        i = int(np.searchsorted(at, min(room, top), side="right"))
        any_fits, looked = False, 0
        while i > 0:
            i -= 1
            s = sizes[i]
            if number[s] > 0:
                if looked == limits.breadth:
                    whole = False
                    return
                any_fits, looked = True, looked + 1
                number[s] -= 1
                search(room - s, s, (*chosen, s))
                number[s] += 1
                if limits.width is not None and full >= limits.width:
                    whole = False
                    return
        if not any_fits:
            found.append((room, chosen))

    search(cap - first, first, ())
    out: dict[tuple[int, ...], int] = {}
    for waste, chosen in sorted(found, key=lambda f: (f[0], len(f[1]))):
        out.setdefault(chosen, waste)
    kept: list[tuple[int, ...]] = []
    for chosen in out:
        # One filling dominates another if each item of the other has its own, no smaller, item in it.
        if not any(len(chosen) <= len(k) and all(x >= y for x, y in zip(k, chosen)) for k in kept):
            kept.append(chosen)
    result = []
    for chosen in kept[: limits.width]:
        filling = {first: 1}
        for s in chosen:
            filling[s] = filling.get(s, 0) + 1
        result.append(filling)
    return result, whole and len(result) == len(kept)


def bin_completion(counts: np.ndarray, limits: Limits = Limits()) -> tuple[list[Filling], int, bool]:
    """(fillings, lower bound, proven): proven if no packing has fewer containers.

    counts[s] items of size s, the capacity being len(counts) - 1. Never worse than best fit; with
    EXACT always proven, since the search then ends only at the bound or with nothing left to try.
    """
    counts = np.asarray(counts, np.int64)
    need = lower_bound(counts)
    best = best_fit(counts)
    best_n = sum(t for _, t in best)
    left, used, path, visited, complete = counts.copy(), 0, [], 0, not limits.bulk

    def branch() -> Iterator[dict[int, int]]:
        nonlocal complete
        options, whole = fillings(left, limits)
        complete = complete and whole
        return iter(options)

    stack: list[Iterator[dict[int, int]]] = [branch()] if left.any() and best_n > need else []
    while stack:
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if path:
                undone, times = path.pop()
                used -= times
                for s, n in undone.items():
                    left[s] += n * times
            continue
        if visited == limits.nodes:
            complete = False
            break
        visited += 1
        times = min(int(left[s]) // n for s, n in filling.items()) if limits.bulk else 1
        for s, n in filling.items():
            left[s] -= n * times
        used += times
        path.append((filling, times))
        if not left.any():
            if used < best_n:
                best, best_n = list(path), used
                if best_n == need:
                    break
            stack.append(iter(()))
        elif used + lower_bound(left) >= best_n:
            stack.append(iter(()))
        else:
            stack.append(branch())
    return best, need, best_n == need or complete


def places(packing: list[Filling]) -> list[tuple[int, int, int, int, int]]:
    """(size, first, end, container, per container): items of a size ranked first..end-1 lie from that container on.

    Bounded by the fillings times their sizes, which the capacity bounds.
    """
    out, given, container = [], {}, 0
    for filling, times in packing:
        for s, n in filling.items():
            first = given.get(s, 0)
            out.append((s, first, first + n * times, container, n))
            given[s] = first + n * times
        container += times
    return out


def token_sizes(documents: DataFrame, vocabulary: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    docs = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(machine.text(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["key", "n_tokens"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)


def pack(spark: SparkSession, sizes: DataFrame, capacity: int, *, key: str = "doc_id", size: str = "n_tokens", salts: int = 64, limits: Limits = Limits()) -> tuple[DataFrame, dict[str, int]]:
    """(key, piece, start, size, container_id) and what the packing comes to.

    Items of no size, of null size or without key are left out. An item larger than the capacity,
    and no other, is split, into full containers and a rest that is packed like any item; start
    is where a piece begins. Repeated rows are packed as items of their own. An empty table
    gives an empty result. Containers are numbered from 0. The summary tells the lower bound of
    containers and whether the packing is proven to have the fewest; EXACT proves it at any cost.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    scratch = Scratch(spark, "packing")
    items = sizes.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("total")).filter("key IS NOT NULL AND total > 0")
    pieces = items.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / capacity))).alias("piece"), "total")
    pieces = pieces.select("key", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("size"))
    pieces = scratch.keep(pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).cast("int")), "pieces")
    each = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))  # at most capacity x salts rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in each.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["size"]] = row["n"]
    packing, need, proven = bin_completion(counts, limits)
    taken = sum(t for _, t in packing)
    summary = {"containers": taken, "lower_bound": need, "proven": int(proven), "used": int((counts * np.arange(capacity + 1)).sum()), "capacity": capacity}
    where = spark.createDataFrame(places(packing), "size int, first bigint, end bigint, base bigint, per bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = each.select("size", "salt", before.alias("before"))
    # A size that a third of all items have is ranked in as many parts as there are salts.
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece")) - 1)
    ranked = ranked.join(offsets, ["size", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(where, "size").filter("rank >= first AND rank < end")
    out = placed.select(F.col("key").alias(key), "piece", "start", F.col("size").cast("bigint").alias("size"), (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("container_id"))
    return out, summary
