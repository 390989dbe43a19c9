"""Buckets of any size as pairs of bounded blocks, for comparisons inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, parts: Column, who: str) -> DataFrame:
    """Cut each bucket into ``parts`` blocks by a hash of ``who`` and repeat its rows for each pair of blocks.

    Adds (i, j, side): a row of block p goes to all pairs i <= j with i or j equal to p; side is 0 in block i, 1 in
    block j, 0 where both are the same.  A pair holds two blocks, however large the bucket is.
    """
    own = F.pmod(F.xxhash64(F.lit(29), F.col(who)), F.col("_parts")).cast("int")
    pair = lambda o: F.struct(F.least(F.col("_own"), o).alias("i"), F.greatest(F.col("_own"), o).alias("j"))
    return (
        members.withColumn("_parts", parts.cast("int")).withColumn("_own", own)
        .withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), pair)))
        .withColumn("i", F.col("_pair.i")).withColumn("j", F.col("_pair.j"))
        .withColumn("side", (F.col("_own") != F.col("i")).cast("int"))
        .drop("_parts", "_own", "_pair")
    )


class Forest:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spread_minimum(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and the columns of a matrix of links between two sets."""
    rows, cols = np.arange(near.shape[0]), np.arange(near.shape[0], sum(near.shape))
    while True:
        new_cols = np.minimum(cols, np.where(near, rows[:, None], len(rows) + len(cols)).min(axis=0, initial=len(rows) + len(cols)))
        new_rows = np.minimum(rows, np.where(near, new_cols[None, :], len(rows) + len(cols)).min(axis=1, initial=len(rows) + len(cols)))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return rows, cols
        rows, cols = new_rows, new_cols
