"""Row positions on the time axis of each slice.

A slice may be longer than one task can sort, so positions come from two steps of bounded
size: the rows of one minute (at most 60 million distinct microseconds) are numbered
among themselves, and the minutes of a slice (about half a million per year) are summed up.
Rows are then grouped into chunks of equal length, the unit of all later ordered work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


def minute_of(ts: str = "ts") -> Column:
    return F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz")


def time_axis(
    df: DataFrame,
    keys: Sequence[str] = ("slice_id",),
    ts: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Distinct times per key with their position from 0 and the chunk that position is in."""
    keys = list(keys)
    times = df.select(*keys, ts).filter(F.col(ts).isNotNull()).distinct().withColumn("_minute", minute_of(ts))
    minutes = (
        times.groupBy(*keys, "_minute")
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_minute")) - F.col("_rows"),
        )
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_minute").orderBy(ts)
    return (
        times.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(minutes, [*keys, "_minute"])
        .withColumn("pos", (F.col("_before") + F.col("_inside")).cast("bigint"))
        .withColumn("chunk", F.floor(F.col("pos") / chunk_rows).cast("bigint"))
        .select(*keys, ts, "pos", "chunk")
    )


def with_halo(df: DataFrame, rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Repeat each row in the later chunks that reach back to it by ``rows`` positions.

    The repeated rows carry ``halo = true`` and the number of the chunk they were added to.  A frame longer
    than a chunk repeats a row in several of them.
    """
    last = F.floor((F.col("pos") + rows) / chunk_rows).cast("bigint")
    return (
        df.withColumn("_own", F.col("chunk"))
        .withColumn("chunk", F.explode(F.sequence(F.col("_own"), F.greatest(last, F.col("_own")))))
        .withColumn("halo", F.col("chunk") != F.col("_own"))
        .drop("_own")
    )
