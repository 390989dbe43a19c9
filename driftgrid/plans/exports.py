"""From raw metric exports to the samples that the analyses take."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions import attrs, times
from driftgrid.operators import clean, shape
from driftgrid.session import store
from driftgrid.sources import readers, schemas


def metric_samples(
    exports: Sequence[DataFrame],
    identity: Sequence[str] = schemas.GAUGE_SERIES,
    value: str = "Value",
    time: str = "TimeUnix",
    resource: str = "ResourceAttributes",
) -> DataFrame:
    """Samples (slice_id, ts, series_id, value, copies) of the merged exports, written out.

    Exports are merged on all their columns; ``copies`` says how often the merge repeats a row and weighs it in
    means.  Rows without a value or time are dropped; rows belong to the slice of their resource attributes, and
    to the series of their identity columns, attribute texts in key order.
    """
    merged = readers.merge_files(*exports)
    rows = clean.coerce_value(clean.null_literal(merged, [value]).withColumn("value", F.col(value)), "value")
    # Read twice below: for the series of each slice, and to number them.
    rows = store(sliced(rows, identity, time, resource, "value"))
    return store(shape.assign_series(rows, list(identity)).select("slice_id", "ts", "series_id", "value", "copies"))


def sliced(rows: DataFrame, identity: Sequence[str], time: str, resource: str, *carried: str) -> DataFrame:
    """Export rows with the slice of their resource, their parsed time and their identity columns."""
    rows = rows.withColumn("ts", times.parse_ts(F.col(time))).filter("ts is not null")
    keys = {c: attrs.canonical_attrs(F.col(c)) if c == "Attributes" else F.col(c) for c in identity}
    rows = rows.select(attrs.resource_key(F.col(resource)).alias("_resource"), *[k.alias(c) for c, k in keys.items()], "ts", *carried, "copies")
    return shape.with_slice(rows, "_resource").drop("_resource")


def histogram_samples(
    exports: Sequence[DataFrame],
    identity: Sequence[str] = schemas.HISTOGRAM_SERIES,
    counts: str = "BucketCounts",
    bounds: str = "ExplicitBounds",
    time: str = "TimeUnix",
    resource: str = "ResourceAttributes",
) -> DataFrame:
    """Samples (slice_id, ts, series_id, bucket_counts) of merged histogram exports, written out.

    A resource with several bounds gives a slice for each of them, before its series are numbered; its rows without bounds go.
    A null literal among the counts is no sample.
    """
    merged = clean.null_literal(readers.merge_files(*exports), [counts, bounds])
    rows = merged.withColumn("bucket_counts", F.col(counts)).withColumn("explicit_bounds", F.col(bounds))
    rows = store(sliced(rows, identity, time, resource, "bucket_counts", "explicit_bounds"))
    rows = store(shape.split_by_bounds(rows))
    return store(shape.assign_series(rows, list(identity)).select("slice_id", "ts", "series_id", "bucket_counts"))


def spans(exports: Sequence[DataFrame]) -> DataFrame:
    """Spans of flat trace exports in the canonical layout, written out; a span that several exports hold comes once."""
    merged = reduce(DataFrame.unionByName, exports).dropDuplicates()
    plain = [c for c, kind in merged.dtypes if kind == "string" and "." not in c]
    flat = readers.spans_from_flat(clean.null_literal(merged, plain).withColumn("Duration", F.col("Duration").try_cast("double")))
    ids = ("trace_id", "span_id", "parent_span_id")
    typed = flat.withColumns({"ts": times.parse_ts(F.col("ts")), **{c: F.col(c).try_cast("bigint") for c in ids}})
    return store(typed.filter("ts is not null and span_id is not null"))
