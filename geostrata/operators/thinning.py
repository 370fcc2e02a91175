"""Thinning of sets of cells to lines one cell wide, after Zhang and Suen (1984), by tiles.

A cell's fate in a pass depends on its eight neighbours. A tile with a margin of as many cells as passes are
run on it gives the right cells within the tile, so tiles are worked on alone for that many passes and then
meet again, until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators.scale import checkpointed

TILE = 256
#: Passes between meetings, each of two half passes.
PASSES = 16


def half_pass(grid: np.ndarray, second: bool) -> np.ndarray:
    """The grid without the cells that one half pass takes."""
    wide = np.pad(grid, 1)
    n = [wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
    filled = sum(c.astype(np.int8) for c in n)
    turns = sum((~a & b).astype(np.int8) for a, b in zip(n, [*n[1:], n[0]], strict=True))
    north, east, south, west = n[0], n[2], n[4], n[6]
    free = ~(north & east & west) & ~(north & south & west) if second else ~(north & east & south) & ~(east & south & west)
    return grid & ~((filled >= 2) & (filled <= 6) & (turns == 1) & free)


def thinned_grid(grid: np.ndarray, passes: int | None = None) -> np.ndarray:
    """The grid after this many passes, or when nothing changes."""
    while passes is None or passes > 0:
        after = half_pass(half_pass(grid, False), True)
        if (after == grid).all():
            break
        grid, passes = after, None if passes is None else passes - 1
    return grid


def thin(cells: DataFrame, x: str = "x", y: str = "y", keys: list[str] = (), tile: int = TILE, passes: int = PASSES) -> DataFrame:
    """(keys..., x, y): the cells that thinning leaves, apart for each key; y grows to the south. Repeated cells count once, those with a null place are left out."""
    keys, margin = list(keys), 2 * passes
    if 2 * margin > tile:
        raise ValueError("the margins of a tile must fit into it")
    now = checkpointed(cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("long").alias(x), F.col(y).cast("long").alias(y)).distinct())
    left = now.count()

    def span(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - margin) / tile).cast("long"), F.floor((F.col(c) + margin) / tile).cast("long")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf.tx_.iloc[0]), int(pdf.ty_.iloc[0])
        grid = np.zeros((tile + 2 * margin,) * 2, bool)
        at = pdf[y].to_numpy() - ty * tile + margin, pdf[x].to_numpy() - tx * tile + margin
        grid[at] = True
        inside = (at[0] >= margin) & (at[0] < margin + tile) & (at[1] >= margin) & (at[1] < margin + tile)
        return pdf[thinned_grid(grid, passes)[at] & inside][[*keys, x, y]]

    while True:
        dealt = now.withColumn("tx_", span(x)).withColumn("ty_", span(y))
        then = checkpointed(dealt.groupBy(*keys, "tx_", "ty_").applyInPandas(work, now.schema))
        n = then.count()
        if n == left:
            return then
        now, left = then, n
