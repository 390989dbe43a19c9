"""Vectors per time, and their covariance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.moments import covariances, moments


def to_vectors(grid: DataFrame, keys: Sequence[str] = ("slice_id",), value: str = "value") -> DataFrame:
    """One vector per time of a dense grid, ordered by series.

    Grouped within the chunk the row is already placed by, so a grid laid out by
    (slice, chunk) is not shuffled again.
    """
    carried = [c for c in ("split", "pos") if c in grid.columns and c not in keys]
    cells = F.array_sort(F.collect_list(F.struct("series_id", value)))
    return (
        grid.groupBy(*keys, "chunk", *carried, "ts")
        .agg(cells.alias("_cells"))
        .select(*keys, "chunk", *carried, "ts", F.col(f"_cells.{value}").alias("x"))
    )


def covariance(vectors: DataFrame, keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """Population covariance of each pair of positions i <= j (from 0)."""
    return covariances(moments(vectors, keys), keys)
