"""Result tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.arrays import join_flags, split_flags
from driftgrid.functions.times import iso_text, parse_ts
from driftgrid.session import store
from driftgrid.spread import byte_size

#: About how many bytes of rows a task that writes losses sorts.
TASK_BYTES = 64_000_000

MANIFEST = "run string, attempt string, written timestamp"


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Write the rows of one run to a table made of runs; a run that is written again takes the place of its earlier rows.

    Every attempt has a folder of its own, and counts from the moment its line is in the manifest.  An attempt that
    failed, or is still being written, is never read; neither is one that a later attempt of its run replaced.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{attempt}")
    line = spark.range(1).select(F.lit(str(run)).alias("run"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("written"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt, written): the attempt of each run that counts."""
    lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return lines.groupBy("run").agg(F.max(F.struct("written", "attempt")).alias("_last")).select("run", "_last.attempt", "_last.written")


def read_runs(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """The rows of all runs, or of the named ones, each run once; the column ``run`` says which."""
    found = runs(spark, path).collect()  # one line per run
    known = {r["attempt"]: r["run"] for r in found if names is None or r["run"] in set(names)}
    if not known:
        return spark.read.parquet(*(f"{path}/data/{r['attempt']}" for r in found)).limit(0).withColumn("run", F.lit(None).cast("string"))
    rows = spark.read.parquet(*(f"{path}/data/{a}" for a in sorted(known)))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    names_of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return rows.withColumn("run", names_of[folder])


def write_anomaly_log(log: DataFrame, path: str, run: str | None = None) -> None:
    """Append logged intervals with their four columns: ISO times, type, comma-joined flags.

    With the name of a ``run`` they go to a table of runs (``read_runs``), where a repeated write does not double them.
    """
    if run is not None:
        write_run(log.select("start_ts", "end_ts", "anomaly_type", "flags"), path, run)
        return
    log.select(
        iso_text(F.col("start_ts")).alias("Start Time (UTC)"),
        iso_text(F.col("end_ts")).alias("End Time (UTC)"),
        F.col("anomaly_type").alias("Anomaly Type"),
        join_flags(F.col("flags")).alias("Flag(s)"),
    ).write.mode("append").option("header", True).csv(path)


def read_anomaly_log(spark, path: str) -> DataFrame:
    """The interval log back in canonical form."""
    from driftgrid.sources.schemas import ANOMALY_LOG

    rows = spark.read.schema(ANOMALY_LOG).option("header", True).csv(path)
    moment = lambda c: parse_ts(F.regexp_replace(F.col(f"`{c}`"), r"(Z|[+-]00:00)$", ""))
    return rows.select(
        moment("Start Time (UTC)").alias("start_ts"),
        moment("End Time (UTC)").alias("end_ts"),
        F.col("`Anomaly Type`").alias("anomaly_type"),
        split_flags(F.col("`Flag(s)`")).alias("flags"),
    )


def write_loss(loss: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """Losses by a bucket of the slice, with the slice as a column.

    Slice texts may be long and many, so a folder stands for a bucket of their hash: 256 at most.  Buckets are laid
    end to end by the size of their rows in memory (the same text over and over is small in a shuffle, but not in a
    sort), and every task writes an equal length of it: a busy slice is written by many tasks.  With the name of a
    ``run`` they go to a table of runs (``read_runs``), where a repeated write does not double them.
    """
    if run is not None:
        write_run(loss, path, run)
        return
    spark = loss.sparkSession
    bucket = F.concat(F.lit("b"), F.substring(F.md5(F.col("slice_id").cast("string")), 1, 2))
    rows = store(loss.withColumn("_bucket", bucket))
    width = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) + 8 for f in rows.schema.fields), F.lit(32))
    sizes = rows.groupBy("_bucket").agg(F.sum(width).alias("bytes")).collect()  # one line per bucket, 257 at most
    places, end = [], 0
    for line in sizes:
        places.append((line["_bucket"], end, line["bytes"]))
        end += line["bytes"]
    tasks = max(math.ceil(end / TASK_BYTES), 1)
    places = spark.createDataFrame(places, "_key string, _start long, _bytes long")
    # The stored rows keep their places, so a repeated task sends each row where it went before.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    task = F.floor((F.col("_start") + F.col("_part") * F.col("_bytes")) / F.lit(max(end, 1)) * tasks).cast("int")
    placed = rows.withColumn("_part", part).join(F.broadcast(places), F.col("_bucket").eqNullSafe(F.col("_key")))
    placed = placed.withColumn("_task", F.least(task, F.lit(tasks - 1))).repartitionById(tasks, "_task")
    placed.select(*rows.columns).write.mode(mode).partitionBy("_bucket").parquet(path)


def write_model(model: DataFrame, path: str) -> None:
    """Fitted models, one row per slice, under a name of their own; an earlier fit of that name is replaced."""
    model.write.mode("overwrite").parquet(path)


def read_model(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_loss(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")
