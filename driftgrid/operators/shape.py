"""Slices, series numbers, and the time-by-series grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid import spread
from driftgrid.axis import CHUNK_ROWS, time_axis
from driftgrid.functions.attrs import join_key, slice_key
from driftgrid.session import store
from driftgrid.spread import lookup, store_measured


def with_slice(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Add ``slice_id`` from one or more columns; rows with a null in them belong to no slice."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [
        slice_key(F.col(c)) if isinstance(types[c], T.MapType) else F.col(c).cast("string") for c in cols
    ]
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    # Exploding a list of at most one key drops the rows without one, and lets the key,
    # which may take a parse of the attribute text, be computed once for both purposes.
    key = parts[0] if len(parts) == 1 else F.when(known, join_key(*parts))
    return df.withColumn("slice_id", F.explode(F.array_compact(F.array(key))))


def distinct_on(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def first_rows(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first full row of each combination of ``cols``, by ``order``; pre-aggregated, not sorted."""
    rest = [c for c in df.columns if c not in cols]
    return (
        df.groupBy(*cols)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*cols, "_row.*")
        .select(*df.columns)
    )


def series_dictionary(
    df: DataFrame, cols: Sequence[str], order: str = "sorted", seen: Sequence[str] = ("ts",)
) -> DataFrame:
    """Number the distinct identity tuples of each slice from 0.

    ``sorted`` numbers them by value, ``first_seen`` by the smallest ``seen`` columns among
    their rows.  Only the distinct tuples are ranked, never the samples.
    """
    cols = list(cols)
    if order == "sorted":
        tuples = df.select("slice_id", *cols).distinct()
        rank = [F.col(c).asc_nulls_first() for c in cols]
    elif order == "first_seen":
        tuples = df.groupBy("slice_id", *cols).agg(F.min(F.struct(*seen)).alias("_seen"))
        rank = [F.col("_seen").asc(), *[F.col(c).asc_nulls_first() for c in cols]]
    else:
        raise ValueError(f"unknown order {order!r}")
    tuples, size = store_measured(tuples)
    if size <= spread.BROADCAST_BYTES:
        number = F.row_number().over(Window.partitionBy("slice_id").orderBy(*rank)) - 1
        return tuples.withColumn("series_id", number).select("slice_id", "series_id", *cols)
    return numbered(tuples, rank).select("slice_id", "series_id", *cols)


def numbered(tuples: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """``tuples`` with ``series_id``, their place from 0 in their slice by ``rank``, however many a slice has.

    The rows are sorted over all tasks by ranges; a row's place is its place in its range and slice plus the rows of the slice in
    the ranges before.  Only these counts, one per range and slice, pass through a window.
    """
    placed = tuples.repartitionByRange(F.col("slice_id").asc(), *rank).sortWithinPartitions(F.col("slice_id").asc(), *rank)
    placed = store(placed.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    counts = placed.groupBy("slice_id", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_start"))
    before = Window.partitionBy("slice_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("slice_id", "_range", "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = lookup(placed, offsets, ["slice_id", "_range"])
    number = (F.col("_before") + F.col("_at") - F.col("_start")).cast("int")
    return joined.withColumn("series_id", number).drop("_range", "_at", "_start", "_before")


def assign_series(
    df: DataFrame, cols: Sequence[str], order: str = "sorted", seen: Sequence[str] = ("ts",)
) -> DataFrame:
    """Add ``series_id`` to every sample; nulls in identity columns match each other."""
    cols = list(cols)
    names = {c: f"_key{i}" for i, c in enumerate(cols)}
    # A null-free key lets one equi-join serve columns that may be null.
    key = F.to_json(F.struct(*[F.col(c).alias(names[c]) for c in cols]))
    numbered = series_dictionary(df, cols, order, seen).select("slice_id", key.alias("_identity"), "series_id")
    return lookup(df.withColumn("_identity", key), numbered, ["slice_id", "_identity"]).drop("_identity")


def dictionary_values(dictionary: DataFrame) -> DataFrame:
    """The series dictionary with its identity columns named ``<column>_value``."""
    fixed = ("slice_id", "series_id")
    return dictionary.select(
        *fixed, *[F.col(c).alias(f"{c}_value") for c in dictionary.columns if c not in fixed]
    )


def to_grid(df: DataFrame, value: str = "value", weight: str | None = None) -> DataFrame:
    """Mean of the non-null values of each (slice, time, series).

    ``weight`` names a column of row multiplicities, as left by ``merge_all``.
    """
    known = df.filter(F.col(value).isNotNull() & F.col("ts").isNotNull())
    if weight is None:
        mean = F.avg(value)
    else:
        mean = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return known.groupBy("slice_id", "ts", "series_id").agg(mean.alias("value"))


def widen(grid: DataFrame, series: Sequence[int]) -> DataFrame:
    """One column per series, for a known list of series numbers."""
    return grid.groupBy("slice_id", "ts").pivot("series_id", list(series)).agg(F.first("value"))


def to_bucket_grid(df: DataFrame, arr: str = "bucket_counts") -> DataFrame:
    """One bucket text per (slice, time, series); of several, the smallest."""
    return (
        df.filter(F.col(arr).isNotNull())
        .groupBy("slice_id", "ts", "series_id")
        .agg(F.min(arr).alias(arr))
    )


def series_lists(grid: DataFrame) -> DataFrame:
    """The series of each slice as one sorted array."""
    return grid.groupBy("slice_id").agg(F.array_sort(F.collect_set("series_id")).alias("_series"))


def grid_cells(
    grid: DataFrame, value: str = "value", chunk_rows: int = CHUNK_ROWS, only: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, tuple[DataFrame, int]]:
    """The known cells of a grid, its time axis, and the series of each slice.

    The last two are small beside the grid, serve several steps, and are written out.
    ``only`` (slice_id, series_id) limits the series; the axis still has the times of all.
    """
    known = grid.filter(F.col(value).isNotNull()).select("slice_id", "ts", "series_id", value)
    axis = store(time_axis(known, chunk_rows=chunk_rows))
    if only is not None:
        known = lookup(known, only.select("slice_id", "series_id").distinct(), ["slice_id", "series_id"], "left_semi")
    return known, axis, store_measured(series_lists(known))


def frame_of(axis: DataFrame, lists: tuple[DataFrame, int]) -> DataFrame:
    """Every place of the axis times every series of its slice.

    The series of a slice travel as one array per slice, so the rows of the dense grid are
    produced in place; no table of pairs is shuffled.
    """
    placed = lookup(axis.repartition("slice_id", "chunk"), lists, "slice_id")
    return placed.withColumn("series_id", F.explode("_series")).drop("_series")


def densify(grid: DataFrame, value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every time of a slice crossed with every series of it; cells without a value are null.

    Times and series without any value do not take part.  ``pos`` and ``chunk`` are the
    place of the row on the time axis of its slice.
    """
    known, axis, lists = grid_cells(grid, value, chunk_rows)
    cells = known.join(axis, ["slice_id", "ts"])
    cells = cells.select("slice_id", "chunk", "series_id", "pos", value).repartition("slice_id", "chunk")
    return frame_of(axis, lists).join(cells, ["slice_id", "chunk", "series_id", "pos"], "left").select(
        "slice_id", "ts", "series_id", value, "pos", "chunk"
    )


def min_length(grid: DataFrame, rows: int = 50) -> DataFrame:
    """Keep the slices with at least ``rows`` distinct times."""
    long_enough = (
        grid.select("slice_id", "ts").distinct()
        .groupBy("slice_id").agg(F.count("ts").alias("_rows"))
        .filter(F.col("_rows") >= rows).select("slice_id")
    )
    return lookup(grid, long_enough, "slice_id", "left_semi")


def lowest_series(grid: DataFrame) -> DataFrame:
    """The lowest series number of each slice."""
    return grid.groupBy("slice_id").agg(F.min("series_id").alias("series_id"))


def first_series(grid: DataFrame) -> DataFrame:
    """The rows of the lowest series number of each slice."""
    return lookup(grid, lowest_series(grid), ["slice_id", "series_id"], "left_semi")


def with_position(df: DataFrame, keys: Sequence[str] = ("slice_id",), ts: str = "ts") -> DataFrame:
    """Add ``pos``, the rank from 0 of the row's time within its keys (times are distinct there)."""
    axis = time_axis(df, keys, ts).select(*keys, ts, "pos")
    return df.join(axis, [*keys, ts])


def split_by_bounds(df: DataFrame, bounds: str = "explicit_bounds") -> DataFrame:
    """Give the bounds of a histogram slices of their own.

    A slice with more than one bounds text becomes ``<slice>_<bounds>`` per text, and its
    rows without bounds are dropped; other slices stay.
    """
    counts = df.groupBy("slice_id").agg(F.count_distinct(bounds).alias("_bounds"))
    split = lookup(df, counts, "slice_id")
    several = F.col("_bounds") > 1
    return (
        split.filter(~several | F.col(bounds).isNotNull())
        .withColumn(
            "slice_id",
            F.when(several, join_key(F.col("slice_id"), F.col(bounds))).otherwise(F.col("slice_id")),
        )
        .drop("_bounds")
    )


def max_len(df: DataFrame, arr: str) -> DataFrame:
    """Length of the longest array of each slice."""
    return df.groupBy("slice_id").agg(F.max(F.size(arr)).alias("max_len"))
