"""Windows along the bars that no single task has to hold a whole product for.

A product's bars are cut into stretches by their number. Whatever looks back (or ahead) by a
bounded number of bars is computed per (product, stretch), each stretch being given so many bars
of its neighbours as well; those are dropped afterwards. So a product with a third of all bars is
spread like any other, and all windows of a plan share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER, STRETCH, OWN = "product_id", "bar_idx", "_stretch", "_own"
#: Bars of a stretch, at least; at most an eighth of a stretch is its neighbours' bars.
SPAN = 8192


def along() -> Window:
    return Window.partitionBy(KEY, STRETCH).orderBy(ORDER)


def frame(w: int) -> Window:
    return along().rowsBetween(-(w - 1), 0)


def stretched(bars: DataFrame, back: int, ahead: int = 0, span: int | None = None) -> DataFrame:
    """The bars with the stretch they are needed in, and whether it is their own."""
    span = span or max(SPAN, 8 * (back + ahead))
    if back + ahead >= span:
        raise ValueError("a stretch must be longer than what its windows reach")
    place, home = F.pmod(F.col(ORDER), F.lit(span)), F.floor(F.col(ORDER) / span)
    needed = [home]
    if back:
        needed.append(F.when(place >= span - back, home + 1))
    if ahead:
        needed.append(F.when((place < ahead) & (home > 0), home - 1))
    rows = bars.withColumn(STRETCH, F.explode(F.array_compact(F.array(*needed)))) if len(needed) > 1 else bars.withColumn(STRETCH, home)
    return rows.withColumn(OWN, F.col(STRETCH) == home)


def owned(rows: DataFrame) -> DataFrame:
    return rows.filter(OWN).drop(STRETCH, OWN)


def in_stretches(bars: DataFrame, back: int, make: Callable[[DataFrame], DataFrame], ahead: int = 0, span: int | None = None) -> DataFrame:
    """make(bars) where its windows, along() and frame(), reach so many bars back and ahead."""
    return owned(make(stretched(bars, back, ahead, span)))
