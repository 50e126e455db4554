"""Pairs within groups, tile by tile, as sums for each member and a spanning forest.

A group of many members is cut into chunks; each pair of chunks is a tile of bounded size that
any task can take. A tile compares all its pairs in memory and passes on, for each member, the
weight of its linked partners, and edges that connect what is linked: both linear in the tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks_of(n: Column, size: Column, members: int, most: int) -> Column:
    """Chunks for ``n`` members of total ``size``: about ``members`` or ``most`` in each."""
    return F.greatest(F.ceil(n / members), F.ceil(size / most), F.lit(1)).cast("int")


def in_tiles(rows: DataFrame, chunk: Column, chunks: Column) -> DataFrame:
    """A copy of each row for every tile of its chunk: adds ``chunk``, ``tile_i`` and ``tile_j``."""
    rows = rows.withColumn("chunk", chunk.cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumns({
        "tile_i": F.least("chunk", "other").cast("int"), "tile_j": F.greatest("chunk", "other").cast("int")}).drop("other")


def pair_mask(chunk: np.ndarray, i: int, j: int) -> np.ndarray:
    """Upper triangle of the pairs that belong to tile (i, j)."""
    n = len(chunk)
    mask = np.triu(np.ones((n, n), bool), 1)
    return mask if i == j else mask & (chunk[:, None] != chunk[None, :])


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, least member) of the components of a boolean upper triangle."""
    n = len(linked)
    a, b = np.nonzero(linked)
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(i, int(root[i])) for i in np.flatnonzero(root != np.arange(n)).tolist()]
