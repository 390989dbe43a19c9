"""Gap filling along the time axis.

Every step works on chunks of the axis, so a series of any length is spread over tasks.
What crosses a chunk border is either the last rows of the chunk before (a halo) or one
carried value per series and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.axis import CHUNK_ROWS, with_halo
from driftgrid.operators.shape import frame_of, grid_cells

IN_CHUNK = ("slice_id", "chunk", "series_id")


def _rolling(rows: int, value: str):
    frame = Window.partitionBy(*IN_CHUNK).orderBy("pos").rowsBetween(-(rows - 1), 0)
    return F.avg(value).over(frame)


def impute_sma(grid: DataFrame, rows: int = 3, value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Put the mean of the last ``rows`` original values, of which one must exist, into nulls.

    Expects a dense grid with ``pos`` and ``chunk``.
    """
    placed = with_halo(grid, rows - 1, chunk_rows)
    filled = F.coalesce(F.col(value), _rolling(rows, value))
    return placed.withColumn(value, filled).filter(~F.col("halo")).drop("halo").select(*grid.columns)


def _carried(grid: DataFrame, value: str) -> DataFrame:
    """Per series and chunk: the last value of the chunks before it, the first value of the series.

    One row per chunk takes part, a few thousand times fewer than the grid has rows.
    """
    known = F.col(value).isNotNull()
    ends = grid.groupBy(*IN_CHUNK).agg(
        F.max_by(value, F.when(known, F.col("pos"))).alias("_last"),
        F.min_by(F.struct("pos", value), F.when(known, F.col("pos"))).alias("_head"),
    )
    series = Window.partitionBy("slice_id", "series_id")
    before = series.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *IN_CHUNK,
        F.last("_last", ignorenulls=True).over(before).alias("_carry"),
        F.min("_head").over(series)[value].alias("_first"),
    )


def ffill(grid: DataFrame, value: str = "value") -> DataFrame:
    """Forward fill of a dense grid."""
    carried = _carried(grid, value).drop("_first")
    upto = Window.partitionBy(*IN_CHUNK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(value, ignorenulls=True).over(upto)
    return (
        grid.join(carried, list(IN_CHUNK))
        .withColumn(value, F.coalesce(own, F.col("_carry")))
        .select(*grid.columns)
    )


def bfill(grid: DataFrame, value: str = "value") -> DataFrame:
    """Backward fill after a forward fill, when only the head of a series can still be null."""
    carried = _carried(grid, value).drop("_carry")
    return (
        grid.join(carried, list(IN_CHUNK))
        .withColumn(value, F.coalesce(F.col(value), F.col("_first")))
        .select(*grid.columns)
    )


def impute(
    grid: DataFrame,
    rows: int = 3,
    value: str = "value",
    chunk_rows: int = CHUNK_ROWS,
    only: DataFrame | None = None,
) -> DataFrame:
    """Dense, gap-free grid from a sparse one: rolling mean, then forward, then backward fill.

    ``rows=1`` leaves the rolling mean out, which suits values that are not numbers.
    ``only`` (slice_id, series_id) names the series to produce, on the axis of all of them.
    The fills share one layout by (slice, chunk).  The known cells are moved there once;
    the dense rows are made there, sorted once and filled, and are never shuffled.  The
    carried value of a chunk is its last known cell: the rolling mean of a gap ends at it.
    """
    known, axis, lists = grid_cells(grid, value, chunk_rows, only)
    chunks = axis.select("slice_id", "chunk").distinct()
    axis = with_halo(axis, rows - 1, chunk_rows) if rows > 1 else axis.withColumn("halo", F.lit(False))
    cells = (
        known.join(axis, ["slice_id", "ts"])
        .select(*IN_CHUNK, "pos", value, "halo")
        .repartition("slice_id", "chunk")
    )
    dense = frame_of(axis, lists).join(cells.drop("halo"), [*IN_CHUNK, "pos"], "left")

    ends = (
        cells.filter(~F.col("halo"))
        .groupBy(*IN_CHUNK)
        .agg(F.max_by(value, "pos").alias("_last"), F.min(F.struct("pos", value)).alias("_head"))
    )
    series = Window.partitionBy("slice_id", "series_id")
    before = series.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        frame_of(chunks, lists)
        .join(ends, list(IN_CHUNK), "left")
        .select(
            *IN_CHUNK,
            F.last("_last", ignorenulls=True).over(before).alias("_carry"),
            F.min("_head").over(series)[value].alias("_first"),
        )
        .repartition("slice_id", "chunk")
    )
    upto = Window.partitionBy(*IN_CHUNK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Halo rows lie before the chunk: they feed the rolling mean, and the forward fill
    # may see them too, since they hold nothing older than the carried value.
    return (
        dense.withColumn("_sma", F.coalesce(F.col(value), _rolling(rows, value)) if rows > 1 else F.col(value))
        .withColumn("_ffill", F.last("_sma", ignorenulls=True).over(upto))
        .filter(~F.col("halo"))
        .join(carried, list(IN_CHUNK), "left")
        .withColumn(value, F.coalesce("_ffill", "_carry", "_first"))
        .select("slice_id", "ts", "series_id", value, "pos", "chunk")
    )
