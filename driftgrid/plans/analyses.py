"""End-to-end analyses: metric PCA, window forecast, wavelet forecast, histogram PCA, span isolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.operators import buckets, iforest, moments, networks, pca, scale, shape, split, thresholds, traces, wavelet, windows
from driftgrid.operators.impute import impute
from driftgrid.operators.quality import prune_one_sided
from driftgrid.operators.vectors import to_vectors
from driftgrid.session import store
from driftgrid.spread import lookup

Range = tuple[Column, Column]


def long_enough(samples: DataFrame, rows: int = 50, cutoff: Column | None = None) -> DataFrame:
    """Sparse samples (slice_id, ts, series_id, value) to the means of the slices long enough.

    The samples are read once: their means are written out, since several steps use them.  A column ``copies``,
    as a merge leaves it, weighs the samples.
    """
    weight = "copies" if "copies" in samples.columns else None
    grid = shape.min_length(store(shape.to_grid(samples, weight=weight)), rows)
    return grid if cutoff is None else prune_one_sided(grid, cutoff)


def prepared_grid(samples: DataFrame, rows: int = 50, cutoff: Column | None = None) -> DataFrame:
    """Gap-free grid of the slices long enough, in long form."""
    return impute(long_enough(samples, rows, cutoff))


def prepared_vectors(samples: DataFrame, rows: int = 50, cutoff: Column | None = None) -> DataFrame:
    """The same grid as one vector per time, written out.

    The vectors are gathered where the filled rows are made, so the dense grid is neither
    shuffled nor stored row by row.
    """
    return store(to_vectors(prepared_grid(samples, rows, cutoff)))


def scaled_vectors(
    vectors: DataFrame, train: Range, test: Range, fit_on: str = "all", closed: str = "right"
) -> DataFrame:
    """Standardised vectors of both splits, for the slices that have rows in each."""
    tagged = split.drop_empty(split.tag_ranges(vectors, train, test, closed))
    source = vectors if fit_on == "all" else tagged.filter("split = 'train'")
    return scale.scale_vectors(tagged, scale.fit_vectors(source))


def metric_pca(
    samples: DataFrame,
    train: Range,
    test: Range,
    target: float = 0.8,
    plus: int = 1,
    k: int | None = None,
    fit_on: str = "all",
    cutoff: Column | None = None,
) -> DataFrame:
    """Reconstruction loss of every train and test time of every slice."""
    vectors = store(scaled_vectors(prepared_vectors(samples, cutoff=cutoff), train, test, fit_on))
    model = store(pca.fit_pca(vectors.filter("split = 'train'"), k=k, target=target, plus=plus))
    return pca.score_losses(vectors, model).select("slice_id", "split", "ts", "loss")


def vector_moments(vectors: DataFrame, series: DataFrame) -> DataFrame:
    """The state of vectors (``moments``) with the series of each slice, to be stored, merged and fitted."""
    return moments.moments(vectors).join(series.withColumnRenamed("_series", "series"), "slice_id")


def metric_moments(samples: DataFrame, times: Range, rows: int = 50, cutoff: Column | None = None) -> DataFrame:
    """The state of the samples of a time range: what a fit needs of them, one row per slice."""
    means = long_enough(samples, rows, cutoff)
    return vector_moments(split.split_range(to_vectors(impute(means)), *times), shape.series_lists(means))


def fit_from_moments(state: DataFrame, target: float = 0.8, plus: int = 1, k: int | None = None) -> DataFrame:
    """One row per slice with its series, scaler and components, from a state alone; no sample is read again.

    States of several ranges are merged first (``moments.merge_moments``), on the series that they share.
    """
    return pca.pca_of(state, k=k, target=target, plus=plus, standardise=True)


def fit_metric_pca(
    samples: DataFrame, train: Range, target: float = 0.8, plus: int = 1, k: int | None = None, cutoff: Column | None = None
) -> DataFrame:
    """One row per slice with its series, scaler and components, all fitted on the train range."""
    return fit_from_moments(metric_moments(samples, train, cutoff=cutoff), target, plus, k)


def score_metric_pca(samples: DataFrame, model: DataFrame, times: Range, rows: int = 1) -> DataFrame:
    """Reconstruction loss of the times of a range under fitted models.

    Series the model does not know are left out, and a series of the model without samples counts as its
    train mean.  Slices without a model have no loss; ``split.unmatched_slices`` names them.
    """
    known = model.select("slice_id", F.explode("series").alias("series_id"))
    means = split.align_to_model(long_enough(samples, rows), known)
    vectors = split.split_range(to_vectors(impute(means)), *times)
    carried = vectors.columns
    placed = lookup(vectors, shape.series_lists(means), "slice_id")
    placed = lookup(placed, model.select("slice_id", "series", "center", "scale"), "slice_id")
    value = lambda s, i: F.coalesce(
        F.get("x", (F.array_position("_series", s) - 1).cast("int")), F.col("center")[i]
    )
    x = F.transform("series", lambda s, i: (value(s, i) - F.col("center")[i]) / F.col("scale")[i])
    return pca.score_losses(placed.withColumn("x", x).select(*carried), model).select("slice_id", "ts", "loss")


def _train_scaled(samples: DataFrame, train: Range, test: Range, slices: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    """Series lists, and vectors of both splits scaled by the train split."""
    if slices is not None:
        samples = split.only_slices(samples, slices)
    means = long_enough(samples)
    vectors = store(to_vectors(impute(means)))
    return store(shape.series_lists(means)), store(scaled_vectors(vectors, train, test, fit_on="train"))


def metric_root_causes(
    samples: DataFrame,
    train: Range,
    test: Range,
    threshold: float = 50.0,
    k: int = 5,
    components: int = 2,
    slices: Sequence[str] | None = None,
) -> DataFrame:
    """Test times over the threshold with their most responsible series.

    Scaler and components both come from the train split.
    """
    series, vectors = _train_scaled(samples, train, test, slices)
    model = pca.fit_pca(vectors.filter("split = 'train'"), k=components)
    return pca.explain(vectors.filter("split = 'test'"), model, series, threshold, k)


def described_root_causes(samples: DataFrame, identity: Sequence[str], train: Range, test: Range, **options) -> DataFrame:
    """The root causes of samples whose series are named by identity columns, with the identity of each series."""
    found = metric_root_causes(shape.assign_series(samples, identity), train, test, **options)
    return pca.describe_series(found, shape.series_dictionary(samples, identity), identity)


def root_cause_signals(
    samples: DataFrame,
    train: Range,
    test: Range,
    threshold: float = 50.0,
    k: int = 5,
    components: int = 2,
    slices: Sequence[str] | None = None,
) -> DataFrame:
    """Scaled values, in train and test, of every series that is named at some flagged test time."""
    series, vectors = _train_scaled(samples, train, test, slices)
    model = pca.fit_pca(vectors.filter("split = 'train'"), k=components)
    named = pca.explain(vectors.filter("split = 'test'"), model, series, threshold, k)
    cells = lookup(vectors, series, "slice_id").select(
        "slice_id", "split", "ts", F.posexplode("x").alias("_i", "value"), "_series"
    )
    tall = cells.select("slice_id", "split", "ts", F.col("_series")[F.col("_i")].alias("series_id"), "value")
    return thresholds.top_signals(tall, named)


def _minmax_first_series(samples: DataFrame) -> DataFrame:
    means = long_enough(samples)
    grid = store(impute(means, only=shape.lowest_series(means)))
    return scale.apply_scaler(grid, scale.fit_minmax(grid))


def window_forecast(samples: DataFrame, length: int = 50, ratio: float = 0.8, against: str = "window") -> DataFrame:
    """Forecast loss, threshold and flag of every window of the first series of each slice."""
    parts = store(split.split_ratio(_minmax_first_series(samples), ratio))
    found = windows.sliding_windows(parts, length)
    loss = windows.forecast_loss(found, windows.fit_forecast(found), against)
    return thresholds.sigma_threshold(store(loss))


def window_reconstruction(samples: DataFrame, length: int = 50, ratio: float = 0.8, k: int = 4) -> DataFrame:
    """Reconstruction loss, threshold and flag of every window of the first series of each slice."""
    parts = store(split.split_ratio(_minmax_first_series(samples), ratio))
    found = windows.sliding_windows(parts, length)
    loss = windows.window_reconstruction_loss(found, windows.fit_window_autoencoder(found, k))
    return thresholds.sigma_threshold(store(loss))


def _windows(samples: DataFrame, length: int, ratio: float) -> DataFrame:
    """Stored windows of the first series of each slice, min-max scaled."""
    return store(windows.sliding_windows(store(split.split_ratio(_minmax_first_series(samples), ratio)), length))


def gated_forecast(samples: DataFrame, length: int = 50, ratio: float = 0.8, hidden: int = 8, against: str = "window", **options) -> DataFrame:
    """The window forecast by a recurrent network per slice, trained on the train windows (``networks.train``)."""
    found = _windows(samples, length, ratio)
    model = networks.fit_gated_forecast(found, hidden, **options)
    return thresholds.sigma_threshold(store(networks.gated_forecast_loss(found, model, hidden, against)))


def stacked_reconstruction(samples: DataFrame, length: int = 50, ratio: float = 0.8, **options) -> DataFrame:
    """The window reconstruction by a stacked encoder per slice, trained until its held-out loss stops falling."""
    found = _windows(samples, length, ratio)
    return thresholds.sigma_threshold(store(networks.stacked_encoder_loss(found, networks.fit_stacked_encoder(found, **options))))


def wavelet_forecast(
    samples: DataFrame, train: Range, test: Range, length: int = 50, name: str = "db4", against: str = "window"
) -> DataFrame:
    """The window forecast on wavelet-smoothed train and test ranges."""
    tagged = split.tag_ranges(_minmax_first_series(samples), train, test, closed="both")
    parts = split.restart_positions(tagged)
    smooth = store(wavelet.wavelet_smooth(parts, name))
    found = windows.sliding_windows(smooth, length)
    loss = windows.forecast_loss(found, windows.fit_forecast(found), against)
    return thresholds.sigma_threshold(store(loss))


def histogram_pca(
    samples: DataFrame, train: Range, test: Range, k: int | None = None, by_bounds: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Loss per time and overall error per split, from one model per slice and bucket.

    Buckets of different bounds are not comparable: with a column ``explicit_bounds`` a slice with several of them is
    taken apart first, unless ``by_bounds`` is off.
    """
    if by_bounds and "explicit_bounds" in samples.columns:
        samples = store(shape.split_by_bounds(samples))
    matrices = store(buckets.bucket_matrices(buckets.bucket_grid(samples)))
    tagged = split.drop_empty(split.tag_ranges(matrices, train, test, closed="both"))
    vectors = store(buckets.bucket_vectors(tagged))
    residuals = store(buckets.bucket_residuals(vectors, buckets.fit_bucket_pca(vectors, k)))
    return buckets.loss_mse(residuals), buckets.overall_mse(residuals)


def span_isolation(
    spans: DataFrame,
    metrics: DataFrame,
    key: str = "span_id",
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Spans beside metrics, split at random, scored by an isolation forest fitted on train.

    Every span is returned.  One without both features, such as a span at whose time no metric is known, is neither
    fitted nor scored: its score and ``anomaly`` are null and its ``note`` says ``no metric``.
    """
    features = ["span_duration", "metric_value"]
    joined = traces.span_features(traces.join_telemetry(spans, metrics))
    every = store(split.split_hashed(joined, key, seed=seed))
    rows = every.na.drop(subset=features)
    train = rows.filter("split = 'train'")
    stats = scale.fit_features(train, features)
    scaled = store(scale.scale_features(rows, stats))
    model = store(iforest.fit_iforest(scaled.filter("split = 'train'"), features, key, trees, sample, seed))
    scored = store(iforest.score_iforest(scaled, model, features, sample))
    labelled = iforest.label_scores(scored, scored.filter("split = 'train'"), contamination)
    rest = every.filter(" or ".join(f"{f} is null" for f in features)).withColumn("note", F.lit("no metric"))
    return labelled.withColumn("note", F.lit(None).cast("string")).unionByName(rest, allowMissingColumns=True)


def seconds_range(start: str, end: str) -> Range:
    """Two literal times as a range."""
    return F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
