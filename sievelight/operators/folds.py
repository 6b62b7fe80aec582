"""Folds over the ordered items of one page as array expressions, and components of one tile.

The arrays hold the items of one page or tile, whose number the page bounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse_adjacent(items: Column, near: Callable[[Column, Column], Column], better: Callable[[Column, Column], Column]) -> Column:
    """Ordered items without duplicates of the last survivor: near(survivor, item) says duplicate, better(item, survivor) which one stays."""

    def step(kept: Column, item: Column) -> Column:
        last = F.element_at(kept, -1)
        rest = F.slice(kept, 1, F.size(kept) - 1)
        one = F.array(item)
        return F.when(F.size(kept) == 0, one).when(~near(last, item), F.concat(kept, one)).when(better(item, last), F.concat(rest, one)).otherwise(kept)

    return F.aggregate(items, F.slice(items, 1, 0), step)


def diverse_top(ranked: Column, k: int, covers: Callable[[Column, Column], Column]) -> Column:
    """The first k of the ranked items that no kept item covers."""

    def step(kept: Column, item: Column) -> Column:
        take = (F.size(kept) < k) & ~F.exists(kept, lambda other: covers(other, item))
        return F.when(take, F.concat(kept, F.array(item))).otherwise(kept)

    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)


def component_sizes(mask: np.ndarray) -> np.ndarray:
    """Sizes of the 4-connected components of a boolean tile: labels fall to the least of their neighbours until none moves."""
    none = mask.size
    label = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        wide = np.pad(label, 1, constant_values=none)
        low = np.minimum.reduce([label, wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        low = np.where(mask, low, none)
        flat = np.append(low.ravel(), none)
        low = flat[low]
        if (low == label).all():
            return np.unique(label[mask], return_counts=True)[1]
        label = low


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("components", "largest", "total")]))
def grid_components(cells: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Of a tile given as an array of 0 and 1 by rows: components, cells of the largest, cells in all."""
    out = []
    for c, w in zip(cells, width, strict=True):
        sizes = component_sizes(np.asarray(c, bool).reshape(-1, int(w)))
        out.append((len(sizes), int(sizes.max(initial=0)), int(sizes.sum())))
    return pd.DataFrame(out, columns=["components", "largest", "total"])
