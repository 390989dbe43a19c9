"""Sliding windows, the window forecast detector and the window reconstruction detector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.axis import CHUNK_ROWS, with_halo
from driftgrid.operators.moments import moments, square
from driftgrid.operators.pca import fit_pca, loss_mean, score_vectors
from driftgrid.spread import lookup


def sliding_windows(df: DataFrame, length: int = 50, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``length`` values before each row as ``x``, the row itself as ``y``.

    Needs ``pos`` and ``chunk`` within the split.  Rows with a shorter past give no window.
    The last rows of a chunk are repeated ahead of the next one, so windows are whole
    across chunk borders and a long series is cut in many tasks.
    """
    placed = with_halo(df.select("slice_id", "split", "ts", "value", "pos", "chunk"), length, chunk_rows)
    past = Window.partitionBy("slice_id", "split", "chunk").orderBy("pos").rowsBetween(-length, -1)
    return (
        placed.withColumn("x", F.collect_list("value").over(past))
        .filter(~F.col("halo") & (F.size("x") == length))
        .select("slice_id", "split", "ts", "pos", "chunk", "x", F.col("value").alias("y"))
    )


def fit_forecast(windows: DataFrame) -> DataFrame:
    """Least-squares forecast of ``y`` from ``x`` per slice, fitted on the train split.

    Spark sums the products; a task solves one small system per slice.  ``coef`` starts with
    the constant.  A system without a unique solution takes the shortest one around the mean.
    """
    joint = windows.filter(F.col("split") == "train").select(
        "slice_id", F.concat("x", F.array("y")).alias("x")
    )

    def solve(n: int, mean: np.ndarray, products: np.ndarray) -> np.ndarray:
        cov = square(products, len(mean)) / n
        slopes = np.linalg.pinv(cov[:-1, :-1], rcond=1e-12, hermitian=True) @ cov[:-1, -1]
        return np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            coef = [solve(n, np.asarray(m, float), np.asarray(p, float)) for n, m, p in zip(b["n"], b["mean"], b["products"])]
            yield b[["slice_id"]].assign(coef=pd.Series(coef, index=b.index, dtype=object))

    slice_type = windows.schema["slice_id"].dataType.simpleString()
    return moments(joint).mapInPandas(run, f"slice_id {slice_type}, coef array<double>")


def forecast_loss(windows: DataFrame, model: DataFrame, against: str = "window") -> DataFrame:
    """Error of the forecast: mean squared distance of the window from it, or of the target."""
    joined = lookup(windows, model, "slice_id")
    products = F.zip_with("x", F.slice("coef", 2, F.size("x")), lambda x, c: x * c)
    predicted = joined.withColumn("predicted", F.aggregate(products, F.col("coef")[0], lambda a, v: a + v))
    if against == "window":
        squares = F.aggregate(
            "x", F.lit(0.0), lambda a, x: a + (x - F.col("predicted")) * (x - F.col("predicted"))
        )
        loss = squares / F.size("x")
    elif against == "target":
        loss = (F.col("y") - F.col("predicted")) * (F.col("y") - F.col("predicted"))
    else:
        raise ValueError(f"against must be 'window' or 'target', not {against!r}")
    return predicted.withColumn("loss", loss).select("slice_id", "split", "ts", "pos", "predicted", "loss")


def window_vectors(windows: DataFrame) -> DataFrame:
    return windows.select("slice_id", "chunk", "split", "pos", "ts", "x")


def fit_window_autoencoder(windows: DataFrame, k: int = 4) -> DataFrame:
    """The best linear encoder of width ``k``: principal components of the train windows."""
    train = windows.filter(F.col("split") == "train")
    return fit_pca(window_vectors(train), k=k)


def window_reconstruction_loss(windows: DataFrame, model: DataFrame) -> DataFrame:
    """Mean squared error between a window and its reconstruction."""
    return loss_mean(score_vectors(window_vectors(windows), model)).select(
        "slice_id", "split", "ts", "pos", "loss"
    )
