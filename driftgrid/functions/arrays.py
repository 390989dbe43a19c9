"""Bucket arrays and flag lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.spread import lookup


def parse_array(text: Column) -> Column:
    """List-literal text to an array of doubles; null where the text does not parse."""
    return F.from_json(text, "array<double>")


def pad_array(arr: Column, length: Column | int) -> Column:
    """Zero-pad an array at its end; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(arr, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(arr), F.lit(0))))


def explode_positions(df: DataFrame, arr: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per array element, with its position from 0."""
    kept = [c for c in df.columns if c != arr]
    return df.select(*kept, F.posexplode(arr).alias(pos, value))


def collect_positions(
    df: DataFrame, keys: Sequence[str], pos: str = "pos", value: str = "value", arr: str = "arr"
) -> DataFrame:
    """Arrays back from their elements; a group is no longer than one array."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value))))
    return df.groupBy(*keys).agg(F.transform(cells, lambda c: c[value]).alias(arr))


def flatten_cells(df: DataFrame, keys: Sequence[str], order: str, arr: str, out: str = "flat") -> DataFrame:
    """All arrays of one key (one time of one slice) as a single vector, ordered by ``order``."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(arr))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(cells, lambda c: c[arr])).alias(out))


def scale_arrays(
    df: DataFrame, arr: str, keys: Sequence[str] = ("slice_id",), row: Sequence[str] = ("ts", "series_id")
) -> DataFrame:
    """Standardise arrays position by position within a key; empty arrays are left out.

    The statistics hold one row per key and position; the arrays themselves are
    rescaled in place, without being taken apart and shuffled.
    """
    keys = list(keys)
    full = df.filter(F.size(arr) > 0)
    stats = (
        explode_positions(full.select(*keys, arr), arr, "_pos", "_value")
        .groupBy(*keys, "_pos")
        .agg(F.avg("_value").alias("_center"), F.stddev_pop("_value").alias("_scale"))
    )
    profile = collect_positions(
        stats.withColumn("_pair", F.struct("_center", F.when(F.col("_scale") == 0, 1.0).otherwise(F.col("_scale")).alias("_scale"))),
        keys, "_pos", "_pair", "_stats",
    )
    joined = lookup(full, profile, keys)
    scaled = F.zip_with(
        F.col(arr), F.slice(F.col("_stats"), 1, F.size(arr)), lambda x, s: (x - s["_center"]) / s["_scale"]
    )
    return joined.select(*keys, *row, scaled.alias(arr))


def split_flags(text: Column) -> Column:
    """Comma-joined flags to a list."""
    return F.transform(F.split(text, ","), lambda f: F.trim(f))


def join_flags(flags: Column) -> Column:
    return F.array_join(flags, ",")
