"""Queries that build on what was stored before: moments in parts, streams, repeated writes, trained networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import moment, r, recursive_sql, table, with_sql
from checks.models import _DETECTORS, TRAIN_SCALED, _TRAIN_TEST, _losses, ranges
from checks.registry import check
from checks.spectrum import residual_sql
from driftgrid.operators import moments, shape, split, subspace
from driftgrid.operators.impute import impute
from driftgrid.operators.vectors import to_vectors
from driftgrid.plans import analyses
from driftgrid.session import fresh_path, store
from driftgrid.sources import writers
from driftgrid.spread import store_measured
from driftgrid.streaming import grid as stream_grid
from driftgrid.streaming import scoring

# --- moments of two time ranges, stored as runs and merged ---------------------------------

MIDDLE = "2024-01-05 07:00:00"


def stored_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The train range in two parts, each reduced to its moments; the second part is written twice."""
    means = store(shape.to_grid(fx.gauge(spark, sf_dir)))
    vectors, series = store(to_vectors(impute(means))), shape.series_lists(means)
    path = fresh_path(spark, "moments")
    for run, lo, hi in (("first", fx.FIRST, MIDDLE), ("second", MIDDLE, fx.CUT), ("second", MIDDLE, fx.CUT)):
        part = split.split_range(vectors, moment(lo), moment(hi))
        writers.write_run(analyses.vector_moments(part, series), path, run)
    parts = [writers.read_runs(spark, path, [run]).drop("run") for run in ("first", "second")]
    return moments.merge_moments(parts)


_TRAIN_SCALED_ROWS = "train as (select * from imputed where ts <= timestamp '%s')" % fx.CUT


@check(
    "moments_merged",
    with_sql(*fx.TO_IMPUTED, _TRAIN_SCALED_ROWS)
    + """select a.slice_id, cast(a.series_id as int) as i, cast(b.series_id as int) as j, round(covar_pop(a.v, b.v), 6) as cov, count(*) as n, round(avg(a.v), 6) as mean
    from train a join train b on a.slice_id = b.slice_id and a.ts = b.ts and a.series_id <= b.series_id group by 1, 2, 3""",
)
def moments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of the whole train range from the stored moments of its two parts."""
    state = store(stored_moments(spark, sf_dir))
    cov = moments.covariances(state)
    both = cov.join(state.select("slice_id", "n", "mean"), "slice_id")
    return both.select("slice_id", "i", "j", r("cov").alias("cov"), "n", r(F.col("mean")[F.col("i")]).alias("mean"))


@check(
    "pca_from_two_parts",
    recursive_sql(*fx.TO_IMPUTED, TRAIN_SCALED, _TRAIN_TEST, residual_sql("tagged", k=2))
    + "select slice_id, ts, round(sum(r * r), 6) as loss from residual where split = 'test' group by 1, 2",
)
def pca_from_two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test losses under models fitted on merged moments, without a second look at the train samples."""
    model = analyses.fit_from_moments(stored_moments(spark, sf_dir), k=2)
    found = analyses.score_metric_pca(fx.gauge(spark, sf_dir), model, ranges()[1])
    return found.withColumn("loss", r("loss"))


@check(
    "pca_by_subspace",
    recursive_sql(*fx.TO_SCALED, _TRAIN_TEST, residual_sql("tagged", k=2))
    + """select slice_id, cast(rank as int) as component, round(eigenvalue, 6) as eigenvalue, round(sum(eigenvalue) over (partition by slice_id), 6) as variance
    from shares qualify rank <= 2""",
)
def pca_by_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two leading eigenvalues of every slice and its whole variance, by multiplying a block of three directions."""
    rows = store(analyses.scaled_vectors(analyses.prepared_vectors(fx.gauge(spark, sf_dir)), *ranges()))
    model = subspace.fit_wide_pca(rows.filter("split = 'train'"), k=2, extra=1)
    rows = model.select("slice_id", "variance", F.posexplode("eigenvalues").alias("component", "eigenvalue"))
    return rows.select("slice_id", (F.col("component") + 1).alias("component"), r("eigenvalue").alias("eigenvalue"), r("variance").alias("variance"))


# --- streams ------------------------------------------------------------------------------

#: Samples arrive in files of five days; one in 23 comes a file late, one in 29 three files.
FILES, DELAY = 6, "2 hours"
_ARRIVED = f"""arrived as (
  select *, least({FILES - 1}, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 432000) as int)
    + case when event_id % 23 = 0 then 1 when event_id % 29 = 0 then 3 else 0 end) as file
  from (select event_type as slice_id, cast(user_id % 4 as int) as series_id, ts, "value" as v, event_id from events where event_id % 17 <> 0 and "value" is not null))"""
#: A sample is late if its window was behind the watermark of two files before; windows behind the last watermark are given out.
_CELLS = f"""limits as (
  select f.file, (select date_trunc('milliseconds', max(ts)) - interval {DELAY} from arrived a where a.file <= f.file - 2) as watermark from (select unnest(range({FILES})) as file) f),
placed as (
  select slice_id, series_id, date_trunc('hour', ts) as start, v, coalesce(date_trunc('hour', ts) + interval 1 hour <= watermark, false) as late
  from arrived join limits using (file)),
ended as (select date_trunc('milliseconds', max(ts)) - interval {DELAY} as watermark from arrived),
cells as (
  select slice_id, start as ts, series_id, avg(v) as v, count(*) as n from placed, ended
  where not late and start + interval 1 hour <= watermark group by 1, 2, 3)"""


def arriving(spark: SparkSession, sf_dir: str, after: str | None = None, files: range = range(FILES), path: str | None = None) -> str:
    """A folder with one file of samples per arrival, written in order."""
    events = table(spark, sf_dir, "events")
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 432_000_000_000)
    late = F.when(F.col("event_id") % 23 == 0, 1).when(F.col("event_id") % 29 == 0, 3).otherwise(0)
    samples = events.select(
        F.col("event_type").alias("slice_id"), F.col("ts"), (F.col("user_id") % 4).cast("int").alias("series_id"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), F.least(days + late, F.lit(FILES - 1)).alias("file"),
    )
    if after is not None:
        samples = samples.filter(F.col("ts") > moment(after))
    path = path or fresh_path(spark, "arrivals")
    for n in files:
        samples.filter(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(path)
    return path


def no_model(spark: SparkSession) -> tuple[DataFrame, int]:
    """A model of no slice, for streams that are only gathered."""
    return spark.createDataFrame([], "slice_id string, series array<int>, center array<double>, scale array<double>, loadings array<double>, k int"), 0


@check(
    "stream_grid",
    with_sql(_ARRIVED, _CELLS, "closed as (select slice_id, start as ts, series_id, count(*) filter (late) as late from placed where start <= (select max(ts) from cells) group by 1, 2, 3)")
    + "select slice_id, ts, series_id, round(v, 6) as value, coalesce(n, 0) as n, late from closed left join cells using (slice_id, ts, series_id)",
)
def streamed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of samples that arrive in files, and how many came too late for their window."""
    path, out = arriving(spark, sf_dir), fresh_path(spark, "streamed")
    samples = stream_grid.read_samples(spark, path)
    scoring.score_stream(samples, no_model(spark), out, f"{out}/checkpoint", delay=DELAY).awaitTermination()
    cells = writers.read_runs(spark, f"{out}/grid").drop("run")
    counted = stream_grid.late_counts(spark.read.schema(stream_grid.SAMPLES).parquet(path), cells)
    means = cells.select("slice_id", "ts", "series_id", r("value").alias("value"))
    return counted.join(means, ["slice_id", "ts", "series_id"], "left").select("slice_id", "ts", "series_id", "value", "n", "late")


@check(
    "stream_losses",
    recursive_sql(
        *fx.TO_IMPUTED, f"stats as (select slice_id, series_id, avg(v) as center, coalesce(nullif(stddev_pop(v), 0), 1) as scale from imputed where ts <= timestamp '{fx.CUT}' group by 1, 2)",
        _ARRIVED.replace("arrived as (", "every as (", 1), f"arrived as (select * from every where ts > timestamp '{fx.CUT}')", _CELLS,
        f"""tagged as (
          select slice_id, ts, 'train' as split, series_id, (v - center) / scale as v from imputed join stats using (slice_id, series_id) where ts <= timestamp '{fx.CUT}'
          union all
          select t.slice_id, t.ts, 'test', s.series_id, coalesce((c.v - center) / scale, 0)
          from (select distinct slice_id, ts from cells) t join stats s using (slice_id) left join cells c on c.slice_id = t.slice_id and c.ts = t.ts and c.series_id = s.series_id)""",
        residual_sql("tagged", k=2),
    ) + "select slice_id, ts, round(sum(r * r), 6) as loss from residual where split = 'test' group by 1, 2",
)
def streamed_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of arriving samples under stored models; the stream is started twice, the second time with nothing new."""
    model = store_measured(analyses.fit_metric_pca(fx.gauge(spark, sf_dir), ranges()[0], k=2))
    path, out = arriving(spark, sf_dir, after=fx.CUT), fresh_path(spark, "streamed")
    for _ in range(2):
        samples = stream_grid.read_samples(spark, path)
        scoring.score_stream(samples, model, out, f"{out}/checkpoint", delay=DELAY).awaitTermination()
    return writers.read_runs(spark, f"{out}/loss").select("slice_id", "ts", r("loss").alias("loss"))


# --- sinks that may be repeated -----------------------------------------------------------

@check(
    "loss_sink_repeated",
    """select event_type as slice_id, ts, "value" as loss, case when ts < timestamp '2024-01-10' then 'early' else 'late' end as run from events""",
)
def loss_sink_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of two runs, one of which was written wrongly first and one twice."""
    path, losses = fresh_path(spark, "loss_runs"), _losses(spark, sf_dir).select("slice_id", "split", "ts", "loss")
    writers.write_loss(losses.withColumn("loss", F.lit(0.0)), path, run="early")
    for run, part in (("early", "train"), ("late", "test"), ("late", "test")):
        writers.write_loss(losses.filter(F.col("split") == part), path, run=run)
    return writers.read_runs(spark, path).select("slice_id", "ts", "loss", "run")


@check("anomaly_log_repeated", with_sql(fx.LOG) + "select start_ts, end_ts, anomaly_type, flags from log")
def anomaly_log_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval log that was written twice by a retry."""
    path, log = fresh_path(spark, "log_runs"), fx.anomaly_log(spark, sf_dir)
    for _ in range(2):
        writers.write_anomaly_log(log, path, run="2024-01")
    rows = writers.read_runs(spark, path)
    return rows.select("start_ts", "end_ts", "anomaly_type", F.array_join("flags", ",").alias("flags"))


# --- trained networks, and the smoothed forecast by itself --------------------------------

@check("window_forecast_gated")
def window_forecast_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of a recurrent network from the last ten values, one network per slice."""
    return analyses.gated_forecast(fx.gauge(spark, sf_dir), length=10, steps=8)


@check("window_reconstruction_stacked")
def window_reconstruction_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty values through a stacked encoder, one per slice."""
    return analyses.stacked_reconstruction(fx.gauge(spark, sf_dir), steps=8)


_SMOOTH = _DETECTORS["wavelet"][: _DETECTORS["wavelet"].rindex("select ts, loss")]


@check("wavelet_forecast_target", _SMOOTH + "select slice_id, split, ts, round(loss, 6) as loss from loss")
def wavelet_forecast_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the forecast of each smoothed value from the one before."""
    later = moment(fx.CUT.replace("00:00:00", "00:00:01")), moment(fx.LAST)
    found = analyses.wavelet_forecast(fx.gauge(spark, sf_dir), ranges()[0], later, length=1, against="target")
    return found.select("slice_id", "split", "ts", r("loss").alias("loss"))
