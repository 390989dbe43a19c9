"""Detectors whose models outlive a run: fitted on one range, stored as tables, and applied to samples that come later.

Metric components have theirs in ``analyses`` (``fit_metric_pca``, ``score_metric_pca``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.operators import buckets, iforest, scale, shape, split, traces, windows
from driftgrid.operators.impute import impute
from driftgrid.operators.pca import loss_mean, score_vectors
from driftgrid.plans.analyses import Range, long_enough
from driftgrid.session import store
from driftgrid.sources import writers


def _series_windows(samples: DataFrame, series: DataFrame, times: Range, length: int, rows: int, scaler: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows of one series per slice within a time range, and the scaler of that range unless one is given."""
    grid = split.split_range(impute(long_enough(samples, rows), only=series), *times)
    grid = store(grid.withColumn("split", F.lit("train")))
    if scaler is None:
        scaler = store(scale.fit_minmax(grid))
    placed = split.restart_positions(scale.apply_scaler(grid, scaler))
    return store(windows.sliding_windows(store(placed), length)), scaler


def fit_window_model(samples: DataFrame, train: Range, length: int = 50, kind: str = "forecast", k: int = 4, rows: int = 50) -> DataFrame:
    """One row per slice: its first series, that series' min-max scaler, and the fitted window detector.

    ``kind``: ``forecast`` (``coef``) or ``reconstruction`` (``n``, ``k``, ``mean``, ``eigenvalues``, ``loadings``).  Scaler and detector
    both see the train range alone.
    """
    series = store(shape.lowest_series(long_enough(samples, rows)))
    found, scaler = _series_windows(samples, series, train, length, rows)
    if kind == "forecast":
        model = windows.fit_forecast(found)
    elif kind == "reconstruction":
        model = windows.fit_window_autoencoder(found, k)
    else:
        raise ValueError(f"kind must be 'forecast' or 'reconstruction', not {kind!r}")
    return scaler.join(model, "slice_id")


def score_window_model(samples: DataFrame, model: DataFrame, times: Range, length: int = 50, against: str = "window", rows: int = 1) -> DataFrame:
    """Loss of every window of a time range under stored window models; slices without a model have none.

    A series is scaled as its train range was, whatever its values are now.
    """
    known = store(model.select("slice_id", "series_id"))
    found, _ = _series_windows(samples, known, times, length, rows, model.select("slice_id", "series_id", "center", "scale"))
    if "coef" in model.columns:
        return windows.forecast_loss(found, model.select("slice_id", "coef"), against).drop("split")
    scored = score_vectors(windows.window_vectors(found), model.select("slice_id", "k", "mean", "loadings"))
    return loss_mean(scored).select("slice_id", "ts", "pos", "loss")


def fit_histogram_model(samples: DataFrame, train: Range, k: int | None = None, by_bounds: bool = True) -> DataFrame:
    """One model per slice and bucket, fitted on a time range.  Bounds are taken apart as in ``histogram_pca``."""
    return buckets.fit_bucket_pca(_bucket_vectors(samples, train, by_bounds), k)


def score_histogram_model(samples: DataFrame, model: DataFrame, times: Range, by_bounds: bool = True) -> DataFrame:
    """Mean squared error of each time of a range under stored bucket models; buckets that have none are left out.

    The samples must have the series that the models were fitted on.
    """
    return buckets.loss_mse(buckets.bucket_residuals(_bucket_vectors(samples, times, by_bounds), model)).drop("split")


def _bucket_vectors(samples: DataFrame, times: Range, by_bounds: bool) -> DataFrame:
    if by_bounds and "explicit_bounds" in samples.columns:
        samples = store(shape.split_by_bounds(samples))
    matrices = store(buckets.bucket_matrices(buckets.bucket_grid(samples)))
    placed = split.split_range(matrices, *times, closed="both").withColumn("split", F.lit("train"))
    return store(buckets.bucket_vectors(placed))


def fit_span_forest(
    spans: DataFrame, metrics: DataFrame, path: str, key: str = "span_id", trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42
) -> None:
    """Fit an isolation forest on spans beside metrics and store it under ``path``: its nodes, and one row of scalers and limit.

    Scaler, forest and limit come from the train split of the spans that have both features.
    """
    features = ["span_duration", "metric_value"]
    joined = traces.span_features(traces.join_telemetry(spans, metrics))
    rows = split.split_hashed(joined, key, seed=seed).na.drop(subset=features).filter("split = 'train'")
    train = store(rows.select(key, *features))
    stats = scale.fit_features(train, features)
    scaled = store(scale.scale_features(train, stats))
    nodes = store(iforest.fit_iforest(scaled, features, key, trees, sample, seed))
    writers.write_model(nodes, f"{path}/nodes")
    scores = iforest.score_iforest(scaled, nodes, features, sample)
    limit = iforest.score_limit(scores, contamination)
    row = [(f, *map(float, stats[f]), float(limit), sample) for f in features]
    writers.write_model(spans.sparkSession.createDataFrame(row, "feature string, center double, scale double, score_limit double, sample int"), f"{path}/scalers")


def score_span_forest(spark: SparkSession, spans: DataFrame, metrics: DataFrame, path: str) -> DataFrame:
    """Spans beside metrics with ``score`` and ``anomaly`` under a stored forest; both are null where a feature is missing."""
    held = {r["feature"]: r for r in writers.read_model(spark, f"{path}/scalers").collect()}  # one row per feature
    features, one = ["span_duration", "metric_value"], next(iter(held.values()))
    joined = store(traces.span_features(traces.join_telemetry(spans, metrics)))
    rows = scale.scale_features(joined.na.drop(subset=features), {f: (held[f]["center"], held[f]["scale"]) for f in features})
    scored = iforest.score_iforest(rows, writers.read_model(spark, f"{path}/nodes"), features, one["sample"])
    flagged = scored.withColumn("anomaly", F.when(F.col("score") > F.lit(one["score_limit"]), -1).otherwise(1))
    rest = joined.filter(" or ".join(f"{f} is null" for f in features))
    return flagged.unionByName(rest, allowMissingColumns=True)
