"""Principal components per histogram bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.arrays import pad_array, parse_array
from driftgrid.operators.impute import impute
from driftgrid.operators.pca import fit_pca, score_vectors, squared_sum
from driftgrid.operators.shape import max_len, to_bucket_grid
from driftgrid.session import store
from driftgrid.spread import lookup

BUCKET = ("slice_id", "bucket")


def bucket_grid(df: DataFrame, arr: str = "bucket_counts") -> DataFrame:
    """Gap-free grid of zero-padded bucket arrays from samples with bucket text.

    Padding comes before any split, so every array of a slice has one length.  The longest
    array is found among the samples, before the gaps are filled.
    """
    cells = store(to_bucket_grid(df, arr))
    longest = max_len(cells.withColumn(arr, parse_array(F.col(arr))), arr)
    filled = impute(cells, rows=1, value=arr).withColumn(arr, parse_array(F.col(arr)))
    padded = lookup(filled, longest, "slice_id")
    return padded.withColumn(arr, pad_array(F.col(arr), F.col("max_len"))).drop("max_len")


def bucket_matrices(grid: DataFrame, arr: str = "bucket_counts") -> DataFrame:
    """For each time the arrays of all series, gathered where the grid rows already are."""
    cells = F.array_sort(F.collect_list(F.struct("series_id", arr)))
    return (
        grid.groupBy("slice_id", "chunk", "ts")
        .agg(cells.alias("_cells"))
        .select("slice_id", "chunk", "ts", F.col(f"_cells.{arr}").alias("cells"))
    )


def bucket_vectors(matrices: DataFrame) -> DataFrame:
    """For each bucket and time the counts of all series as one vector."""
    carried = [c for c in ("split",) if c in matrices.columns]
    turned = F.transform(
        F.sequence(F.lit(0), F.size(F.col("cells")[0]) - 1),
        lambda b: F.transform("cells", lambda c: c[b]),
    )
    return matrices.filter(F.size(F.col("cells")[0]) > 0).select(
        "slice_id", "chunk", *carried, "ts", F.posexplode(turned).alias("bucket", "x")
    )


def fit_bucket_pca(vectors: DataFrame, k: int | None = None) -> DataFrame:
    """One model per slice and bucket on the train split; full rank unless ``k`` is given."""
    train = vectors.filter(F.col("split") == "train")
    return fit_pca(train, k=k, full_rank=k is None, keys=BUCKET)


def bucket_residuals(vectors: DataFrame, model: DataFrame) -> DataFrame:
    return score_vectors(vectors, model, keys=BUCKET)


def loss_mse(residuals: DataFrame) -> DataFrame:
    """Mean squared error of each time over all series and buckets."""
    return residuals.groupBy("slice_id", "split", "ts").agg(
        (F.sum(squared_sum(F.col("residual"))) / F.sum(F.size("residual"))).alias("loss")
    )


def overall_mse(residuals: DataFrame) -> DataFrame:
    """Mean squared error of each split of a slice."""
    return residuals.groupBy("slice_id", "split").agg(
        (F.sum(squared_sum(F.col("residual"))) / F.sum(F.size("residual"))).alias("mse")
    )
