"""Column pruning, null literals, coercion, schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.spread import lookup

# Fixed value: how the source database writes a null in a text export.
NULL_TEXT = "\\N"


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value.

    Tells ``min`` from ``max`` in one aggregate of two values per column, where counting
    distinct values would repeat every row once per column.
    """
    unordered = (T.MapType, T.VariantType)
    tested = [
        f.name for f in df.schema.fields
        if (cols is None or f.name in cols) and not isinstance(f.dataType, unordered)
    ]
    if not tested:
        return []
    varies = [
        F.coalesce(F.min(F.col(f"`{c}`")) != F.max(F.col(f"`{c}`")), F.lit(False)).alias(f"_{i}")
        for i, c in enumerate(tested)
    ]
    row = df.agg(*varies).first()
    return [c for i, c in enumerate(tested) if not row[f"_{i}"]]


def prune_constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that hold at most one distinct non-null value."""
    gone = set(constant_columns(df, cols))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])


def null_text(col: Column) -> Column:
    """Null where the text contains the null literal."""
    return F.when(col.contains(NULL_TEXT), F.lit(None)).otherwise(col)


def null_literal(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace every text cell containing the null literal by null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in text if cols is None or c in cols]
    return df.withColumns({c: null_text(F.col(c)) for c in chosen})


def coerce_value(df: DataFrame, col: str = "value") -> DataFrame:
    """Text to double, bad text to null, null values dropped."""
    number = F.col(col).try_cast("double")
    number = F.when(~F.isnan(number), number)
    return df.withColumn(col, number).na.drop(subset=[col])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The numeric columns, after the key columns named in ``keep``."""
    return df.select(*keep, *[c for c in numeric_columns(df) if c not in keep])


def missing_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c not in df.columns]


def require_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """Keep the slices in which every needed column holds a value.

    A column that is missing from the table raises an error naming it; a column that is
    null throughout a slice takes that slice out.
    """
    gone = missing_columns(df, cols)
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    whole = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        whole = whole.filter(F.col(f"_n{i}") > 0)
    return lookup(df, whole.select(*keys), keys, "left_semi")
