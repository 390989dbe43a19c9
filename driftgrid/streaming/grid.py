"""A stream of samples as means of tumbling windows, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "slice_id string, ts timestamp_ntz, series_id int, value double"


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES, files: int = 1) -> DataFrame:
    """A stream of the sample files of a folder, ``files`` of them in a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_means(samples: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Grid cells (slice_id, ts, series_id, value, n) of samples, ``ts`` being the start of the window.

    On a stream a window is given out once, when the watermark (the latest time seen, less ``delay``) has passed its end: samples
    up to then change its mean, later ones are left out (``late_counts`` counts them).  All series of a window come
    in the same micro-batch.  State is one sum and count per open window and series.  Samples without slice, series, time or
    value are left out.  The same call on a table gives the grid without a watermark.
    """
    known = samples.na.drop(subset=["slice_id", "series_id", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    known = known.withWatermark("ts", delay) if samples.isStreaming else known
    cells = known.groupBy("slice_id", F.window("ts", width).alias("_window"), "series_id").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return cells.select("slice_id", F.col("_window.start").cast("timestamp_ntz").alias("ts"), "series_id", "value", "n")


def late_counts(samples: DataFrame, cells: DataFrame, width: str = "1 hour") -> DataFrame:
    """(slice_id, ts, series_id, n, late): samples of each closed window that its mean holds, and those that came too late.

    ``samples`` is the table of all samples that arrived, ``cells`` the grid that the stream gave out.  Windows up to the
    latest one given out are closed; one of them that is not in the grid was late as a whole.
    """
    last = cells.agg(F.max("ts").alias("_last"))
    arrived = tumbling_means(samples, width).select("slice_id", "ts", "series_id", F.col("n").alias("_all"))
    closed = arrived.join(F.broadcast(last), F.col("ts") <= F.col("_last")).drop("_last")  # one row
    held = cells.select("slice_id", "ts", "series_id", "n")
    both = closed.join(held, ["slice_id", "ts", "series_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("slice_id", "ts", "series_id", "n", (F.col("_all") - F.col("n")).alias("late"))
