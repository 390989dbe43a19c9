"""Putting exports together: merges on all columns, slice mappings, concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.attrs import join_key
from driftgrid.spread import lookup

_BLOCK = 10_000


def merge_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of two tables on all their columns, nulls matching nulls.

    Returns the distinct rows with ``copies``, how often the merge repeats each of them
    (m copies on one side and n on the other give m * n).  Copies are counted before the
    shuffle, and a row copied a billion times stays one row.
    """
    if a.columns != b.columns:
        raise ValueError("both tables need the same columns")
    cols = a.columns
    sides = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    counts = sides.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    copies = F.greatest(F.col("_a"), F.lit(1)) * F.greatest(F.col("_b"), F.lit(1))
    return counts.select(*[F.col(f"`{c}`") for c in cols], copies.cast("bigint").alias("copies"))


def expand_copies(df: DataFrame, copies: str = "copies") -> DataFrame:
    """One row per copy.  The grid does not need this: ``to_grid`` takes the weights as they are."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / _BLOCK))
    wide = df.withColumn("_block", F.explode(blocks))
    rest = F.least(F.col(copies) - F.col("_block") * _BLOCK, F.lit(_BLOCK)).cast("int")
    return wide.withColumn("_copy", F.explode(F.sequence(F.lit(1), rest))).drop("_block", "_copy", copies)


def dedup(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row duplicate removal, or by a list of columns."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row concatenation; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def mapping_table(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Train slice to test slice, of repeated train slices the last one."""
    last = dict(pairs)
    return df.sparkSession.createDataFrame(list(last.items()), "train_slice string, test_slice string")


def map_slices(train: DataFrame, test: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of each mapped train slice and of its test slice, under one merged slice key.

    Pairs of which one side has no rows are left out.
    """
    merged = mapping.join(
        train.select(F.col("slice_id").alias("train_slice")).distinct(), "train_slice", "left_semi"
    ).join(test.select(F.col("slice_id").alias("test_slice")).distinct(), "test_slice", "left_semi")
    merged = merged.withColumn("_merged", join_key(F.col("train_slice"), F.col("test_slice")))

    def side(df: DataFrame, key: str) -> DataFrame:
        dim = merged.select(F.col(key).alias("slice_id"), "_merged")
        return lookup(df, dim, "slice_id").withColumn("slice_id", F.col("_merged")).drop("_merged")

    return concat(side(train, "train_slice"), side(test, "test_slice"))
