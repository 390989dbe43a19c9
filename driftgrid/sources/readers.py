"""Headerless metric exports and canonical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.operators.merge import merge_all
from driftgrid.session import store
from driftgrid.spread import lookup

# Encodings by name, with the byte order that files are split in.
WIDE = {"UTF-16": "UTF-16LE", "UTF-16LE": "UTF-16LE", "UTF-16BE": "UTF-16BE"}
_PLACE = ("_file", "_start", "_row")


def read_metrics_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    drop_last_line: bool = False,
) -> DataFrame:
    """Scan headerless CSV exports with the given column names.

    Files are split over tasks unless ``multi_line`` is set, which records with quoted line
    breaks need.  ``UTF-16`` is read as little-endian text unless ``UTF-16BE`` names the other order; the byte order
    mark is removed, and a file whose mark shows the order not asked for ends the scan with an error.
    ``drop_last_line`` removes the last record of every file, the cut end of an export.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    declared = T.StructType.fromDDL(schema)
    reader = spark.read.schema(declared).option("quote", '"').option("escape", '"').option("header", False)
    wide = WIDE.get(encoding.upper().replace("_", "-").replace("UTF16", "UTF-16"))
    if multi_line:
        reader = reader.option("multiLine", True).option("encoding", encoding)
    elif wide:
        reader = reader.option("encoding", wide).option("lineSep", "\n")
    else:
        reader = reader.option("encoding", encoding)
    rows = reader.csv(paths)
    if drop_last_line:
        rows = drop_last_rows(rows)
    head, tail = declared[0], declared[-1]
    if wide and not multi_line:
        if isinstance(head.dataType, T.StringType):
            first = F.col(head.name)
            swapped = F.raise_error(F.lit(f"the byte order of a file is not {wide}")).cast("string")
            rows = rows.withColumn(head.name, F.when(first.startswith("\ufffe"), swapped).otherwise(F.ltrim(first, F.lit("\ufeff"))))
        if isinstance(tail.dataType, T.StringType):
            rows = rows.withColumn(tail.name, F.rtrim(F.col(tail.name), F.lit("\r")))
    return rows


def drop_last_rows(rows: DataFrame) -> DataFrame:
    """Without the last row of each file.

    Rows are placed by the block of the file they come from and their order in it, so the
    last row of a file is found by one small aggregate.  The placed rows are stored, since another
    scan may cut the files differently.
    """
    cols = rows.columns
    placed = store(rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    last = placed.groupBy("_file").agg(F.max(F.struct("_start", "_row")).alias("_last"))
    last = last.select("_file", "_last._start", "_last._row")
    return lookup(placed, last, _PLACE, "left_anti").select(*cols)


def merge_files(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Several exports as one table, merged on all columns in turn, with their ``copies``."""
    merged = merge_all(first, others[0]) if others else first.withColumn("copies", F.lit(1))
    for other in others[1:]:
        # A further merge multiplies the copies found so far by those of the next file.
        cols = first.columns
        sides = merged.withColumn("_b", F.lit(0)).unionByName(
            other.withColumn("copies", F.lit(0).cast("bigint")).withColumn("_b", F.lit(1))
        )
        counts = sides.groupBy(*cols).agg(F.sum("copies").alias("_a"), F.sum("_b").alias("_b"))
        copies = F.greatest("_a", F.lit(1)) * F.greatest("_b", F.lit(1))
        merged = counts.select(*cols, copies.cast("bigint").alias("copies"))
    return merged


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric table kept as Parquet."""
    return spark.read.parquet(path)


def load_spans(spark: SparkSession, path: str) -> DataFrame:
    """A span table kept as Parquet, in the canonical layout where it has one."""
    return spark.read.parquet(path)


def spans_from_flat(df: DataFrame) -> DataFrame:
    """The canonical span layout from a flat table whose event and link columns have dotted names."""
    field = lambda name: F.col(f"`{name}`")
    return df.select(
        field("Timestamp").alias("ts"), field("TraceId").alias("trace_id"), field("SpanId").alias("span_id"),
        field("ParentSpanId").alias("parent_span_id"), field("TraceState").alias("trace_state"),
        field("SpanName").alias("span_name"), field("SpanKind").alias("span_kind"),
        field("ServiceName").alias("service"), field("ResourceAttributes").alias("resource_attributes"),
        field("ScopeName").alias("scope_name"), field("ScopeVersion").alias("scope_version"),
        field("SpanAttributes").alias("span_attributes"), field("Duration").cast("double").alias("duration"),
        field("StatusCode").alias("status_code"), field("StatusMessage").alias("status_message"),
        F.struct(
            field("Events.Timestamp").alias("ts"), field("Events.Name").alias("name"),
            field("Events.Attributes").alias("attributes"),
        ).alias("events"),
        F.struct(
            field("Links.TraceId").alias("trace_id"), field("Links.SpanId").alias("span_id"),
            field("Links.TraceState").alias("trace_state"), field("Links.Attributes").alias("attributes"),
        ).alias("links"),
    )
