"""Walking over a partition that is sorted by cells, without a call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_cells(batches: Iterator[pd.DataFrame], column: str = "cell") -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Tables that hold whole cells only, with the places where cells begin and, last, the length.

    The rows of a cell must follow each other; besides a batch, one unfinished cell is held.
    """
    held: list[pd.DataFrame] = []

    def cut(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        cell = rows[column].to_numpy()
        return rows, [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]

    for batch in batches:
        if not len(batch):
            continue
        cell = batch[column].to_numpy()
        last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
        if not last and held and held[-1][column].iloc[-1] == cell[-1]:
            held.append(batch)
            continue
        if last:
            yield cut(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
        elif held:
            yield cut(pd.concat(held, ignore_index=True))
        held = [batch.iloc[last:]]
    if held:
        yield cut(pd.concat(held, ignore_index=True))
