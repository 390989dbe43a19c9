"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on.  All of them can be changed on a running session.
RUNTIME_CONF = {
    # Slice and bucket keys are compared with date_trunc results: one fixed zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Grids are laid out by (slice_id, chunk); joins on those columns plus more may keep that layout.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A repeated key in an attribute text keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder is known.

    The Python helpers travel with the tasks, so executors need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules["driftgrid"])
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    shared_folder(spark)
    return spark


def local_session(cores: str = "8", name: str = "driftgrid", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A temporary folder serves a session on one machine that names none; on a cluster executors would not see it, so
    there a folder must be named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftgrid-"))
        current = sc.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and keeps the columnar
    layout so that later reads are pruned to the columns they use.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
