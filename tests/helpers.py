"""Small inputs and plain numpy or pandas answers."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)


def grid_rows(slices: dict[str, np.ndarray]) -> list[tuple]:
    """(slice, time, series, value) for matrices of times x series; nan means no sample."""
    out = []
    for name, matrix in slices.items():
        for i, row in enumerate(matrix):
            for j, v in enumerate(row):
                if not math.isnan(v):
                    out.append((name, START + dt.timedelta(minutes=i), j, float(v)))
    return out


def grid_frame(spark, slices: dict[str, np.ndarray]):
    return spark.createDataFrame(grid_rows(slices), "slice_id string, ts timestamp_ntz, series_id int, value double")


def sparse_matrix(seed: int, times: int, series: int, share: float = 0.4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(times, series)).round(3)
    m[rng.random(m.shape) > share] = np.nan
    m[0, 0] = m[-1, 0] = 1.0
    return m


def pandas_impute(m: np.ndarray, rows: int = 3) -> np.ndarray:
    """The imputation on a dense table: times and series without values dropped first."""
    df = pd.DataFrame(m).dropna(how="all").dropna(how="all", axis=1)
    for c in df.columns:
        df[c] = df[c].fillna(df[c].rolling(rows, min_periods=1).mean())
    return df.ffill().bfill().to_numpy()


def matrix_of(df, value: str = "value") -> dict[str, np.ndarray]:
    pdf = df.toPandas()
    return {
        name: group.pivot(index="ts", columns="series_id", values=value).sort_index().sort_index(axis=1).to_numpy(dtype=float)
        for name, group in pdf.groupby("slice_id")
    }


def numpy_pca_loss(train: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    mean = train.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((train - mean).T, bias=True).reshape(train.shape[1], train.shape[1]))
    axes = axes[:, ::-1][:, :k]
    centred = rows - mean
    return ((centred - centred @ axes @ axes.T) ** 2).sum(axis=1)
