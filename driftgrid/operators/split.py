"""Train and test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.axis import CHUNK_ROWS
from driftgrid.operators.shape import with_position
from driftgrid.spread import lookup


def in_range(lo: Column, hi: Column, closed: str = "right", ts: str = "ts") -> Column:
    if closed == "right":
        return (F.col(ts) > lo) & (F.col(ts) <= hi)
    if closed == "both":
        return F.col(ts).between(lo, hi)
    raise ValueError(f"closed must be 'right' or 'both', not {closed!r}")


def split_range(df: DataFrame, lo: Column, hi: Column, closed: str = "right") -> DataFrame:
    """Rows of one time range, open or closed at its start, closed at its end."""
    return df.filter(in_range(lo, hi, closed))


def tag_ranges(
    df: DataFrame, train: tuple[Column, Column], test: tuple[Column, Column], closed: str = "right"
) -> DataFrame:
    """Rows of the train and test ranges with a ``split`` column; a row in both appears twice."""
    tags = F.filter(
        F.array(
            F.when(in_range(*train, closed), F.lit("train")), F.when(in_range(*test, closed), F.lit("test"))
        ),
        lambda t: t.isNotNull(),
    )
    return df.withColumn("split", F.explode(tags))


def split_ratio(df: DataFrame, ratio: float = 0.8, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ordered split: the first ``floor(n * ratio)`` times of a slice are train, the rest test.

    ``pos`` restarts in each split, and ``chunk`` follows it.
    """
    placed = df if "pos" in df.columns else with_position(df)
    sizes = placed.groupBy("slice_id").agg(
        F.floor((F.max("pos") + 1).cast("double") * F.lit(ratio)).alias("_train_rows")
    )
    joined = lookup(placed, sizes, "slice_id")
    train = F.col("pos") < F.col("_train_rows")
    place = F.when(train, F.col("pos")).otherwise(F.col("pos") - F.col("_train_rows"))
    return (
        joined.withColumn("split", F.when(train, "train").otherwise("test"))
        .withColumn("pos", place)
        .withColumn("chunk", F.floor(F.col("pos") / chunk_rows))
        .drop("_train_rows")
    )


def split_random(df: DataFrame, weights: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> list[DataFrame]:
    """Random split by Spark's own sampler."""
    return df.randomSplit(list(weights), seed)


# Fixed values of the arithmetic split: any two primes do.
_SPLIT_FACTOR = 7919
_SPLIT_MODULUS = 10007


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a 64-bit integer; a text gives the first 15 hexadecimal digits of its MD5."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("bigint")
    return F.col(key).cast("bigint")


def split_hashed(
    df: DataFrame,
    key: str,
    weights: Sequence[float] = (0.7, 0.15, 0.15),
    seed: int = 42,
    names: Sequence[str] = ("train", "validation", "test"),
) -> DataFrame:
    """Random-looking split that follows from the row key, an integer or a text, so every run repeats it."""
    small = F.pmod(integer_key(df, key), F.lit(_SPLIT_MODULUS))
    share = F.pmod(small * _SPLIT_FACTOR + seed, F.lit(_SPLIT_MODULUS)) / F.lit(float(_SPLIT_MODULUS))
    edge, split = 0.0, F.lit(names[-1])
    edges = []
    for weight in weights[:-1]:
        edge += weight
        edges.append(edge)
    for limit, name in reversed(list(zip(edges, names))):
        split = F.when(share < F.lit(limit), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def drop_empty(df: DataFrame, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Keep the slices that have rows in every one of the splits."""
    present = df.groupBy("slice_id").agg(
        *[F.count_if(F.col("split") == s).alias(f"_n{i}") for i, s in enumerate(splits)]
    )
    for i in range(len(splits)):
        present = present.filter(F.col(f"_n{i}") > 0)
    return lookup(df, present.select("slice_id"), "slice_id", "left_semi")


def only_slices(df: DataFrame, slices: Sequence[str] | DataFrame) -> DataFrame:
    """Keep the slices of an include list."""
    if isinstance(slices, DataFrame):
        return lookup(df, slices.select("slice_id").distinct(), "slice_id", "left_semi")
    return df.filter(F.col("slice_id").isin(list(slices)))


def common_slices(*frames: DataFrame) -> DataFrame:
    """Slice keys present in every frame."""
    keys = [f.select("slice_id").distinct() for f in frames]
    out = keys[0]
    for other in keys[1:]:
        out = out.intersect(other)
    return out


def align_to_model(grid: DataFrame, model: DataFrame) -> DataFrame:
    """Keep the series the model was fitted on."""
    known = model.select("slice_id", "series_id").distinct()
    return lookup(grid, known, ["slice_id", "series_id"], "left_semi")


def unmatched_slices(df: DataFrame, model: DataFrame) -> DataFrame:
    """Slices without a model."""
    return df.select("slice_id").distinct().join(
        model.select("slice_id").distinct(), "slice_id", "left_anti"
    )


def restart_positions(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Positions from 0 within each split, for splits cut out of the middle of the axis.

    Needs ``pos`` on the full axis: the rows of a range follow one another there.
    """
    starts = df.groupBy("slice_id", "split").agg(F.min("pos").alias("_start"))
    return (
        lookup(df, starts, ["slice_id", "split"])
        .withColumn("pos", F.col("pos") - F.col("_start"))
        .withColumn("chunk", F.floor(F.col("pos") / chunk_rows).cast("bigint"))
        .drop("_start")
    )
