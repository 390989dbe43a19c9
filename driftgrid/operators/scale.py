"""Scaler models per series and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.spread import lookup

SERIES = ("slice_id", "series_id")


def _nonzero(col: Column) -> Column:
    return F.when(col == 0, F.lit(1.0)).otherwise(col)


def fit_standard(grid: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Mean and population deviation per series; a deviation of 0 counts as 1."""
    spread = F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(F.stddev_pop(value))
    return grid.groupBy(*keys).agg(F.avg(value).alias("center"), _nonzero(spread).alias("scale"))


def fit_minmax(grid: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Minimum and range per series; a range of 0 counts as 1."""
    return grid.groupBy(*keys).agg(
        F.min(value).alias("center"), _nonzero(F.max(value) - F.min(value)).alias("scale")
    )


def apply_scaler(grid: DataFrame, model: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """(value - center) / scale; series the model does not know are left out."""
    joined = lookup(grid, model.select(*keys, "center", "scale"), keys)
    return joined.withColumn(value, (F.col(value) - F.col("center")) / F.col("scale")).select(*grid.columns)


def fit_vectors(vectors: DataFrame, keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """Standard scaler of every position of the vectors, as two arrays per key."""
    tall = vectors.select(*keys, F.posexplode("x").alias("series_id", "value"))
    stats = fit_standard(tall, [*keys, "series_id"])
    cells = F.array_sort(F.collect_list(F.struct("series_id", "center", "scale")))
    return stats.groupBy(*keys).agg(cells.alias("_cells")).select(
        *keys, F.col("_cells.center").alias("center"), F.col("_cells.scale").alias("scale")
    )


def scale_vectors(vectors: DataFrame, model: DataFrame, keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """Standardise vectors in place: no row is taken apart or moved."""
    joined = lookup(vectors, model, list(keys))
    centred = F.zip_with("x", "center", lambda x, c: x - c)
    return joined.withColumn("x", F.zip_with(centred, "scale", lambda x, s: x / s)).select(*vectors.columns)


def fit_features(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the feature columns of a flat table: one row of numbers."""
    row = df.agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)],
        *[F.when(F.min(c) == F.max(c), 1.0).otherwise(_nonzero(F.stddev_pop(c))).alias(f"_s{i}") for i, c in enumerate(features)],
    ).first()
    return {c: (row[f"_m{i}"], row[f"_s{i}"]) for i, c in enumerate(features)}


def scale_features(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise feature columns with statistics fitted elsewhere."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(center)) / F.lit(scale) for c, (center, scale) in stats.items()}
    )
