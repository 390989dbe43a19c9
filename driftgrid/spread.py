"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.session import store

# A table of at most this many bytes is broadcast.
BROADCAST_BYTES = 32_000_000
# A key with more rows than this is split over several tasks.
ROWS_PER_TASK = 2_000_000


def byte_size(col: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: the length of text, eight per number, through arrays, maps and structs."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col) + 8
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            size = F.size(col) * 8
        else:
            size = F.aggregate(col, F.lit(0).cast("bigint"), lambda a, x: a + byte_size(x, kind.elementType))
        size = size + 8
    elif isinstance(kind, T.MapType):
        size = byte_size(F.map_keys(col), T.ArrayType(kind.keyType)) + byte_size(F.map_values(col), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((byte_size(col[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("bigint"), F.lit(8).cast("bigint"))


def store_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Write a table out; return it with its size in bytes, observed by the writing job itself."""
    width = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    seen = Observation()
    stored = store(df.observe(seen, F.sum(width).cast("bigint").alias("bytes")))
    return stored, seen.get["bytes"] or 0


def hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed into a salt: no maps, and no fractions, which a repeated task may round differently."""
    loose = (T.MapType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, loose)]


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows_per_task: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Join on ``on``, splitting each key of ``fact`` with many rows over several tasks.

    Only the rows of ``dim`` under such keys are repeated, once per split.  The list of
    hot keys has at most ``count(fact) / rows_per_task`` rows; it is broadcast if its measured size allows.
    The split of a row follows from its own columns, so a repeated task gives the same one; a
    key whose rows are all equal is not split.  Rows with a null key meet nothing and stay out of the join.
    A caller that knows ``fact`` to have ``at_most`` so many rows saves the search for hot keys.
    """
    on = list(on)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    if at_most is not None and at_most <= rows_per_task:
        return fact.join(dim, on, how)
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in on))
    loose, fact = fact.filter(~whole), fact.filter(whole)
    hot, hot_bytes = store_measured(
        fact.groupBy(*on)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts"))
    )
    hot = F.broadcast(hot) if hot_bytes <= BROADCAST_BYTES else hot
    left = (
        fact.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.coalesce(F.pmod(F.xxhash64(*hashable(fact)), F.col("_salts")), F.lit(0)).cast("int"),
        )
        .drop("_salts")
    )
    right = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    joined = left.join(right, [*on, "_salt"], how).drop("_salt")
    return joined.unionByName(loose, allowMissingColumns=True) if how in ("left", "left_anti") else joined


def lookup(
    fact: DataFrame,
    dim: DataFrame | tuple[DataFrame, int],
    on: Sequence[str] | str,
    how: str = "inner",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join a large table to a table with one row per key.

    The small side is written out and measured, unless it comes from ``store_measured``
    already.  Up to ``broadcast_bytes`` it is broadcast, which leaves the large side where it
    is; beyond that the join is shuffled and salted.
    """
    on = [on] if isinstance(on, str) else list(on)
    dim, size = dim if isinstance(dim, tuple) else store_measured(dim)
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return fact.join(F.broadcast(dim), on, how)
    return salted_join(fact, dim, on, how)
