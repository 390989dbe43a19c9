"""Table and grid profiles: distinct counts, quantiles, null counts, one-sided series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.operators.clean import numeric_columns
from driftgrid.session import store
from driftgrid.spread import lookup, store_measured

# Groups up to this size are ranked in one task.
SMALL_GROUP = 2_000_000
# Cells that the range of a larger group is cut into at once.
CELLS = 1024


def profile_distinct(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values of every column, as rows (column_name, n_distinct)."""
    cols = list(cols or df.columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    if approximate:
        wide = df.agg(*[count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(cols)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_distinct")) for i, c in enumerate(cols)])
        return wide.select(F.inline(pairs))
    # One row per (column, value): two rounds of plain grouping with partial aggregation,
    # so no single task ever holds the values of a column.
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("_value")) for c in cols]
    )
    values = df.select(F.inline(pairs)).distinct()
    return values.groupBy("column_name").agg(count_known("_value").alias("n_distinct"))


def count_known(col: str) -> Column:
    return F.count(F.col(col))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    small_group: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, as rows (keys, prob, quantile).

    A group up to ``small_group`` rows is ranked whole.  In a larger one the rank is looked for by counting: its range of
    values is cut into equal cells, the cell that holds the rank is cut again, until it holds a single value.  What is shuffled
    are counts of cells, and no task sorts or holds the values of a large group.
    """
    small_group = SMALL_GROUP if small_group is None else small_group
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    inner = keys or ["_one"]
    known = known if keys else known.withColumn("_one", F.lit(1))
    sizes = store_measured(known.groupBy(*inner).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    large = sizes[0].filter(F.col("_n") > small_group)
    some = bool(large.limit(1).count())
    sized = lookup(known, sizes, inner)
    found = _ranked(sized.filter(F.col("_n") <= small_group), probs, inner)
    if some:
        found = found.unionByName(_counted(store(sized.filter(F.col("_n") > small_group)).select(*inner, "_v"), large, probs, inner))
    share = (F.col("_n") - 1) * F.col("prob") - F.floor((F.col("_n") - 1) * F.col("prob"))
    return found.select(*keys, "prob", (F.col("_low") + share * (F.col("_high") - F.col("_low"))).alias("quantile"))


def _places(probs: Sequence[float]) -> Column:
    """Per quantile the ranks (from 0) that it lies between."""
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    return F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.floor(place(p)).alias("_first"), F.ceil(place(p)).alias("_second")) for p in probs])


def _ranked(rows: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, prob, _n, _low, _high) of groups small enough for one task; equal values are counted first."""
    counts = rows.groupBy(*keys, "_n", "_v").agg(F.count("*").alias("_count"))
    upto = Window.partitionBy(*keys).orderBy("_v")
    placed = counts.withColumn("_last", F.sum("_count").over(upto)).withColumn("_from", F.col("_last") - F.col("_count"))
    picked = placed.select("*", F.inline(_places(probs))).filter((F.col("_from") <= F.col("_second")) & (F.col("_last") > F.col("_first")))
    return picked.groupBy(*keys, "prob", "_n").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def scale_of(v: Column, logarithmic: bool) -> Column:
    """A scale that keeps the order of values: half the value, which does not overflow, or its logarithm with its sign.

    Taken in turn, cells of equal width part both values of one magnitude and values of very unequal ones in a few steps.
    """
    if not logarithmic:
        return v / 2
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 800))


def _counted(rows: DataFrame, sizes: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The same for stored rows (keys, _v) of large groups, by counting the rows of cells."""
    ranks = F.array_distinct(F.flatten(F.transform(_places(probs), lambda p: F.array(p["_first"], p["_second"]))))
    target = ["_rank"]
    wanted = store(sizes.select(*keys, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.explode(ranks).alias("_rank")))
    logarithmic = False
    while wanted.filter("_lo < _hi").limit(1).count():
        open_ = wanted.filter("_lo < _hi").groupBy(*keys).agg(F.collect_list(F.struct("_rank", "_lo", "_hi", "_below")).alias("_open"))
        low, high, at = (scale_of(F.col(c), logarithmic) for c in ("_lo", "_hi", "_v"))
        cell = F.floor((at - low) / (high - low) * CELLS)
        # The ends have cells of their own, so that every step takes something off, infinite values and not-a-numbers too.
        cell = F.greatest(F.least(F.coalesce(cell, F.lit(1)), F.lit(CELLS - 2)), F.lit(1))
        cell = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), CELLS - 1).otherwise(cell)
        inside = lookup(rows, open_, list(keys)).select(*keys, "_v", F.inline("_open")).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        cells = inside.groupBy(*keys, *target, "_below", cell.alias("_cell")).agg(F.count("*").alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*keys, *target).orderBy("_cell")  # at most CELLS rows
        last = F.col("_below") + F.sum("_count").over(upto)
        held = cells.withColumn("_last", last).withColumn("_below", F.col("_last") - F.col("_count"))
        held = held.filter((F.col("_below") <= F.col("_rank")) & (F.col("_last") > F.col("_rank"))).select(wanted.columns)
        wanted, logarithmic = store(held.union(wanted.filter("_lo = _hi"))), not logarithmic
    at = sizes.select(*keys, "_n", F.inline(_places(probs)))
    one = wanted.select(*keys, F.col("_rank").alias("_first"), F.col("_lo").alias("_low"))
    two = wanted.select(*keys, F.col("_rank").alias("_second"), F.col("_lo").alias("_high"))
    return at.join(one, [*keys, "_first"]).join(two, [*keys, "_second"]).select(*keys, "prob", "_n", "_low", "_high")


def profile(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of the numeric columns.

    One row per column.  The quartiles are exact unless ``approximate`` is set.
    """
    cols = list(cols or numeric_columns(df))
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]
    )
    tall = df.select(F.inline(cells))
    stats = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    if approximate:
        quartiles = [F.percentile_approx("value", p).alias(name) for p, name in names.items()]
        return tall.groupBy("column_name").agg(*stats, *quartiles)
    quantiles = (
        exact_quantiles(tall, "value", list(names), ["column_name"])
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in names.items()])
    )
    return tall.groupBy("column_name").agg(*stats).join(quantiles, "column_name", "left")


def schema_table(df: DataFrame) -> list[tuple[str, str]]:
    """Column names with their types."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def column_types(df: DataFrame) -> DataFrame:
    """(position, column_name, column_type) of a table, as a table."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(schema_table(df))]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by some columns, which a table without an order of its own needs for it."""
    return df.orderBy(*order).limit(n)


def null_counts(grid: DataFrame, value: str = "value") -> DataFrame:
    """Null cells of every series of a dense grid."""
    return grid.groupBy("slice_id", "series_id").agg(F.count_if(F.col(value).isNull()).alias("null_cells"))


def null_pct(df: DataFrame, col: str) -> DataFrame:
    """Share of null values of a column in each slice, in percent."""
    return df.groupBy("slice_id").agg((F.avg(F.col(col).isNull().cast("int")) * 100).alias("null_pct"))


def bounds_count(df: DataFrame, bounds: str = "explicit_bounds") -> DataFrame:
    """Distinct non-null bounds texts of each slice."""
    return df.groupBy("slice_id").agg(F.count_distinct(bounds).alias("n_bounds"))


def slice_summary(df: DataFrame) -> DataFrame:
    """Rows of each slice."""
    return df.groupBy("slice_id").agg(F.count("*").alias("n_rows"))


def two_sided_series(grid: DataFrame, cutoff: Column, value: str = "value") -> DataFrame:
    """Series with a value before the cut-off and one at or after it."""
    known = F.col(value).isNotNull()
    return (
        grid.groupBy("slice_id", "series_id")
        .agg(
            F.count_if(known & (F.col("ts") < cutoff)).alias("_before"),
            F.count_if(known & (F.col("ts") >= cutoff)).alias("_after"),
        )
        .filter((F.col("_before") > 0) & (F.col("_after") > 0))
        .select("slice_id", "series_id")
    )


def prune_one_sided(grid: DataFrame, cutoff: Column, value: str = "value") -> DataFrame:
    """Drop the series that are null everywhere before the cut-off, or everywhere from it on."""
    return lookup(grid, two_sided_series(grid, cutoff, value), ["slice_id", "series_id"], "left_semi")
