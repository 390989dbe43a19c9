"""Queries with detectors that are fitted and stored first, and applied to later samples after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import r, with_sql
from checks.models import _HIST, _LABELLED, _LABELS, _LINE, _MINMAX, SPLIT_SQL, _hist_ranges, closed_form, forest_sql, ranges
from checks.registry import check
from driftgrid.plans import saved
from driftgrid.session import fresh_path
from driftgrid.sources import writers

#: The first series of each slice, scaled by its train range, in windows that stay within a range.
_TRAIN_MINMAX = [
    *_MINMAX[:-3],
    f"tagged as (select slice_id, ts, v, {SPLIT_SQL} from one)",
    """spans as (select slice_id, min(v) as low, coalesce(nullif(max(v) - min(v), 0), 1) as width from tagged where split = 'train' group by 1)""",
    "parts as (select slice_id, ts, split, (v - low) / width as v from tagged join spans using (slice_id))",
    _MINMAX[-1],
]


def stored(model: DataFrame) -> DataFrame:
    path = fresh_path(model.sparkSession, "window_model")
    writers.write_model(model, path)
    return writers.read_model(model.sparkSession, path)


@check(
    "forecast_saved_model",
    with_sql(*_TRAIN_MINMAX, _LINE)
    + "select slice_id, ts, round((y - m * x1 - c) * (y - m * x1 - c), 6) as loss from lagged join line using (slice_id) where x1 is not null and split = 'test'",
)
def forecast_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast loss of later windows under stored models."""
    train, test = ranges()
    samples = fx.gauge(spark, sf_dir)
    model = stored(saved.fit_window_model(samples, train, length=1))
    found = saved.score_window_model(samples, model, test, length=1, against="target")
    return found.select("slice_id", "ts", r("loss").alias("loss"))


@check(
    "reconstruction_saved_model",
    with_sql(*_TRAIN_MINMAX, "pairs as (select slice_id, split, ts, x0, x1 from lagged where x0 is not null)", closed_form("pairs"))
    + "select slice_id, ts, round(p * p / 2, 6) as loss from scored where split = 'test'",
)
def reconstruction_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction loss of later windows of two values under stored models."""
    train, test = ranges()
    samples = fx.gauge(spark, sf_dir)
    model = stored(saved.fit_window_model(samples, train, length=2, kind="reconstruction", k=1))
    return saved.score_window_model(samples, model, test, length=2).select("slice_id", "ts", r("loss").alias("loss"))


@check(
    "histogram_saved_model",
    with_sql(*_HIST, closed_form("tall", "slice_id, bucket")) + "select slice_id, ts, round(sum(p * p) / 8, 4) as loss from scored where split = 'test' group by 1, 2",
)
def histogram_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of later histograms under stored bucket models."""
    train, test = _hist_ranges()
    samples = fx.histogram(spark, sf_dir)
    model = stored(saved.fit_histogram_model(samples, train, k=1, by_bounds=False))
    return saved.score_histogram_model(samples, model, test, by_bounds=False).select("slice_id", "ts", r("loss", 4).alias("loss"))


@check(
    "isolation_saved_model",
    with_sql(fx.SPANS, fx.METRICS, forest_sql(), _LABELS) + "select span_id, score, anomaly from (" + _LABELLED + ")",
)
def isolation_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans under a stored forest."""
    path = fresh_path(spark, "forest")
    spans, metrics = fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir)
    saved.fit_span_forest(spans, metrics, path)
    found = saved.score_span_forest(spark, spans, metrics, path)
    return found.select("span_id", r("score").alias("score"), F.col("anomaly").cast("int").alias("anomaly"))
