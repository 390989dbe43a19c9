"""Queries for the model operators and the end-to-end analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import moment, r, recursive_sql, table, to_scaled, with_sql
from checks.registry import check
from checks.spectrum import residual_sql
from driftgrid.operators import buckets, iforest, impute, labels, pca, scale, shape, split, thresholds, vectors, wavelet
from driftgrid.plans import analyses, exports
from driftgrid.session import fresh_path, store
from driftgrid.sources import readers, schemas, writers

def ranges() -> tuple[analyses.Range, analyses.Range]:
    """Train and test range of the gauge samples."""
    return (moment(fx.FIRST), moment(fx.CUT)), (moment(fx.CUT), moment(fx.LAST))


SPLIT_SQL = f"case when ts <= timestamp '{fx.CUT}' then 'train' else 'test' end as split"


def scaled_grid(spark: SparkSession, sf_dir: str, series: int = 4) -> DataFrame:
    grid = store(impute.impute(store(shape.to_grid(fx.gauge(spark, sf_dir, series)))))
    return scale.apply_scaler(grid, scale.fit_standard(grid))


def split_vectors(spark: SparkSession, sf_dir: str, series: int = 2, fit_on: str = "all") -> DataFrame:
    return store(analyses.scaled_vectors(analyses.prepared_vectors(fx.gauge(spark, sf_dir, series)), *ranges(), fit_on))


# Two series have a closed form: the minor axis of a 2 x 2 covariance matrix.

def closed_form(rows: str, keys: str = "slice_id", on_split: bool = True) -> str:
    """CTEs from ``rows`` (keys, ts, split, x0, x1): ``fit`` per key and ``scored`` with the residual length p."""
    train = "where split = 'train'" if on_split else ""
    return f"""moments as (
      select {keys}, avg(x0) as m0, avg(x1) as m1, var_pop(x0) as a, covar_pop(x0, x1) as b, var_pop(x1) as c
      from {rows} {train} group by {keys}),
    eigen as (
      select *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as e1,
             (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) as e2 from moments),
    fit as (
      select *, b / sqrt(b * b + (e2 - a) * (e2 - a)) as u0, (e2 - a) / sqrt(b * b + (e2 - a) * (e2 - a)) as u1,
             b / sqrt(b * b + (e1 - a) * (e1 - a)) as w0, (e1 - a) / sqrt(b * b + (e1 - a) * (e1 - a)) as w1 from eigen),
    scored as (
      select *, (x0 - m0) * u0 + (x1 - m1) * u1 as p, (x0 - m0) * w0 + (x1 - m1) * w1 as s
      from {rows} join fit using ({keys}))"""


PAIRS = f"""pairs as (
  select slice_id, ts, {SPLIT_SQL}, max(v) filter (series_id = 0) as x0, max(v) filter (series_id = 1) as x1
  from scaled group by slice_id, ts)"""
TWO = [*to_scaled(2), PAIRS]
# Scaled with the statistics of the train split.
TRAIN_SCALED = f"""scaled as (
  select slice_id, ts, series_id, (v - center) / scale as v from imputed join (
    select slice_id, series_id, avg(v) as center, coalesce(nullif(stddev_pop(v), 0), 1) as scale
    from imputed where ts <= timestamp '{fx.CUT}' group by 1, 2) using (slice_id, series_id))"""
TWO_TRAIN = [fx.gauge_sql(2), *fx.TO_IMPUTED[1:], TRAIN_SCALED, PAIRS]


@check(
    "norm_loss_flags",
    with_sql(*fx.TO_SCALED, f"loss as (select slice_id, ts, {SPLIT_SQL}, sum(v * v) as loss from scaled group by 1, 2)")
    + """select slice_id, split, ts, round(loss, 6) as loss, round(avg(loss) over w + 3 * stddev_pop(loss) over w, 6) as threshold,
    loss > avg(loss) over w + 3 * stddev_pop(loss) over w as is_anomaly from loss window w as (partition by slice_id, split)""",
)
def norm_loss_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples to flags with no components kept: the loss is the squared norm."""
    tagged = split.tag_ranges(scaled_grid(spark, sf_dir), *ranges())
    loss = tagged.groupBy("slice_id", "split", "ts").agg(F.sum(pca.sq_error(F.col("value"))).alias("loss"))
    flags = thresholds.sigma_threshold(store(loss))
    return flags.select("slice_id", "split", "ts", r("loss").alias("loss"), r("threshold").alias("threshold"), "is_anomaly")


@check(
    "covariance",
    with_sql(*fx.TO_SCALED) + """select a.slice_id, cast(a.series_id as int) as i, cast(b.series_id as int) as j, round(covar_pop(a.v, b.v), 6) as cov
    from scaled a join scaled b on a.slice_id = b.slice_id and a.ts = b.ts and a.series_id <= b.series_id group by 1, 2, 3""",
)
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.covariance(vectors.to_vectors(scaled_grid(spark, sf_dir))).withColumn("cov", r("cov"))


@check(
    "pca_model",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, 0 as component, 0 as position, round(case when abs(w0) >= abs(w1) then abs(w0) else w0 * sign(w1) end, 6) as loading,
      round(m0, 6) as mean, round(e1, 6) as eigenvalue from fit
    union all select slice_id, 0, 1, round(case when abs(w1) > abs(w0) then abs(w1) else w1 * sign(w0) end, 6), round(m1, 6), round(e1, 6) from fit""",
)
def pca_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First component of every slice in long form."""
    train = split_vectors(spark, sf_dir).filter("split = 'train'")
    rows = pca.model_rows(pca.fit_pca(train, k=1))
    return rows.select("slice_id", "component", "position", r("loading").alias("loading"), r("mean").alias("mean"), r("eigenvalue").alias("eigenvalue"))


@check(
    "num_components",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, cast(case when e1 / (e1 + e2) >= 0.55 then 1 else 2 end as int) as with_last,
    cast(case when e1 / (e1 + e2) >= 0.55 then 0 else 1 end as int) as one_short from fit""",
)
def num_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components for 55 % of the variance, counted in both ways."""
    train = split_vectors(spark, sf_dir).filter("split = 'train'")
    model = store(pca.fit_pca(train, k=2))
    one = pca.num_components(model, 0.55, 1).withColumnRenamed("n_components", "with_last")
    two = pca.num_components(model, 0.55, 0).withColumnRenamed("n_components", "one_short")
    return one.join(two, "slice_id")


@check(
    "variance_ratio",
    with_sql(*TWO, closed_form("pairs")) + "select slice_id, round(e1 / (e1 + e2), 6) as variance_ratio from fit",
)
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_vectors(spark, sf_dir).filter("split = 'train'")
    return pca.variance_ratio(pca.fit_pca(train, k=1), 1).withColumn("variance_ratio", r("variance_ratio"))


@check(
    "pca_project",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, ts, 0 as component,
    round(s * case when abs(w0) >= abs(w1) then sign(w0) else sign(w1) end, 6) as score from scored""",
)
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = split_vectors(spark, sf_dir)
    return pca.project(v, pca.fit_pca(v.filter("split = 'train'"), k=1)).withColumn("score", r("score"))


@check(
    "pca_reconstruct",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, ts, 0 as position, round(x0 - p * u0, 6) as rebuilt, round(p * u0, 6) as residual from scored
    union all select slice_id, ts, 1, round(x1 - p * u1, 6), round(p * u1, 6) from scored""",
)
def pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = split_vectors(spark, sf_dir)
    rebuilt = pca.reconstruct(v, pca.fit_pca(v.filter("split = 'train'"), k=1))
    return rebuilt.withColumn("rebuilt", r("rebuilt")).withColumn("residual", r("residual"))


@check(
    "pca_losses",
    with_sql(*TWO, closed_form("pairs")) + "select slice_id, split, ts, round(p * p, 6) as loss from scored",
)
def pca_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction loss of train and test times, all slices in one job."""
    loss = analyses.metric_pca(fx.gauge(spark, sf_dir, 2), *ranges(), k=1)
    return loss.withColumn("loss", r("loss"))


@check(
    "pca_train_losses",
    with_sql(*TWO, closed_form("pairs")) + "select slice_id, ts, round(p * p, 6) as loss from scored where split = 'train'",
)
def pca_train_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, loss = pca.train_losses(split_vectors(spark, sf_dir), k=1)
    return loss.select("slice_id", "ts", r("loss").alias("loss"))


@check(
    "pca_score_losses",
    with_sql(*TWO, closed_form("pairs")) + "select slice_id, ts, round(p * p, 6) as loss from scored where split = 'test' and slice_id <> 'view'",
)
def pca_score_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test losses under stored models; a slice without a model is skipped."""
    v = split_vectors(spark, sf_dir)
    model, _ = pca.train_losses(v.filter("slice_id <> 'view'"), k=1)
    loss = pca.score_losses(v.filter("split = 'test'"), model)
    return loss.select("slice_id", "ts", r("loss").alias("loss"))


@check(
    "pca_contributions",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, ts, 0 as series_id, round(p * u0 * p * u0, 6) as sq_error from scored
    union all select slice_id, ts, 1, round(p * u1 * p * u1, 6) from scored""",
)
def pca_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = split_vectors(spark, sf_dir)
    scored = pca.score_vectors(v, pca.fit_pca(v.filter("split = 'train'"), k=1))
    series = shape.series_lists(shape.to_grid(fx.gauge(spark, sf_dir, 2)))
    return pca.contributions(scored, series).withColumn("sq_error", r("sq_error"))


@check(
    "explain_two_series",
    with_sql(*TWO, closed_form("pairs")) + """select slice_id, ts, round(p * p, 6) as loss, series_id, round(e, 6) as sq_error, cast(rank as int) as rank from (
      select *, row_number() over (partition by slice_id, ts order by e desc, series_id) as rank from (
        select slice_id, ts, split, p, 0 as series_id, p * u0 * p * u0 as e from scored union all select slice_id, ts, split, p, 1, p * u1 * p * u1 from scored))
    where split = 'test' and p * p > 1.5""",
)
def explain_two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged test times with the share and rank of each series."""
    v = split_vectors(spark, sf_dir)
    model = pca.fit_pca(v.filter("split = 'train'"), k=1)
    series = shape.series_lists(shape.to_grid(fx.gauge(spark, sf_dir, 2)))
    found = pca.explain(v.filter("split = 'test'"), model, series, threshold=1.5, k=2)
    return found.select("slice_id", "ts", r("loss").alias("loss"), "series_id", r("sq_error").alias("sq_error"), "rank")


@check(
    "root_causes_two_series",
    with_sql(*TWO_TRAIN, closed_form("pairs")) + """select slice_id, ts, round(p * p, 6) as loss, round(p * p / 2, 6) as sq_error, rank from scored,
    (values (cast(1 as int)), (cast(2 as int))) as ranks(rank) where split = 'test' and p * p > 1.5""",
)
def root_causes_two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from samples on, scaler and component fitted on train.

    Two standardised series always share a residual equally, so the shares are compared, not the order.
    """
    found = analyses.metric_root_causes(fx.gauge(spark, sf_dir, 2), *ranges(), threshold=1.5, k=2, components=1)
    return found.select("slice_id", "ts", r("loss").alias("loss"), r("sq_error").alias("sq_error"), "rank")


# With no component kept the loss is the squared norm, at any number of series.
_NAMED = with_sql(*fx.TO_IMPUTED, TRAIN_SCALED, f"""causes as (select *, row_number() over (partition by slice_id, ts order by e desc, number) as rank from (
      select slice_id, ts, {SPLIT_SQL}, 3 - series_id as number, v * v as e, sum(v * v) over (partition by slice_id, ts) as loss from scaled))""")


@check(
    "root_causes_described",
    _NAMED + """select slice_id, ts, round(loss, 6) as loss, cast(number as int) as series_id, round(e, 6) as sq_error, cast(rank as int) as rank, 'unit ' || number as unit_value
    from causes where split = 'test' and loss > 5 and rank <= 3""",
)
def root_causes_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged times with the identity of their three most responsible series, of four."""
    samples = fx.gauge(spark, sf_dir).withColumn("unit", F.concat(F.lit("unit "), (3 - F.col("series_id")).cast("string"))).drop("series_id")
    found = analyses.described_root_causes(samples, ["unit"], *ranges(), threshold=5.0, k=3, components=0)
    return found.select("slice_id", "ts", r("loss").alias("loss"), "series_id", r("sq_error").alias("sq_error"), "rank", "unit_value")


@check(
    "root_cause_signals",
    _NAMED + f"""select slice_id, {SPLIT_SQL}, ts, series_id, round(v, 6) as value from scaled
    where (slice_id, 3 - series_id) in (select (slice_id, number) from causes where split = 'test' and loss > 30 and rank = 1)""",
)
def root_cause_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled signals, in both splits, of the series most responsible for some flagged time."""
    found = analyses.root_cause_signals(fx.gauge(spark, sf_dir), *ranges(), threshold=30.0, k=1, components=0)
    return found.select("slice_id", "split", "ts", "series_id", r("value").alias("value"))


def _saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of all slices but one, written under a name and read back."""
    path = fresh_path(spark, "metric_pca")
    samples = fx.gauge(spark, sf_dir, 2).filter("slice_id <> 'view'")
    writers.write_model(analyses.fit_metric_pca(samples, ranges()[0], k=1), path)
    return writers.read_model(spark, path)


@check(
    "pca_saved_model",
    with_sql(*TWO_TRAIN, closed_form("pairs")) + "select slice_id, ts, round(p * p, 6) as loss from scored where split = 'test' and slice_id <> 'view'",
)
def pca_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test losses under models fitted before, saved and loaded."""
    found = analyses.score_metric_pca(fx.gauge(spark, sf_dir, 2), _saved_model(spark, sf_dir), ranges()[1])
    return found.withColumn("loss", r("loss"))


@check("pca_saved_model_unmatched", "select distinct event_type as slice_id from events where event_type = 'view'")
def pca_saved_model_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices that the loaded models leave without a loss."""
    return split.unmatched_slices(fx.gauge(spark, sf_dir, 2), _saved_model(spark, sf_dir))


_TRAIN_TEST = f"tagged as (select slice_id, ts, {SPLIT_SQL}, series_id, v from scaled)"


@check(
    "gauge_root_causes",
    recursive_sql(*fx.TO_IMPUTED, TRAIN_SCALED, _TRAIN_TEST, residual_sql("tagged", k=2)) + """select slice_id, ts, series_id, round(loss, 6) as loss, round(e, 6) as sq_error, cast(rank as int) as rank from (
      select *, sum(e) over (partition by slice_id, ts) as loss, row_number() over (partition by slice_id, ts order by e desc, series_id) as rank
      from (select slice_id, ts, series_id, r * r as e from residual where split = 'test')) where loss > 5 and rank <= 3""",
)
def gauge_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged test times of all slices with their most responsible series, two components kept."""
    found = analyses.metric_root_causes(fx.gauge(spark, sf_dir), *ranges(), threshold=5.0, k=3)
    return found.withColumns({"loss": r("loss"), "sq_error": r("sq_error")})


#: The grid without the series that have no sample on one side of the cut.
_TWO_SIDED = f"""grid as (
  select * from all_means semi join (
    select slice_id, series_id from all_means group by 1, 2
    having min(ts) < timestamp '{fx.CUT}' and max(ts) >= timestamp '{fx.CUT}') using (slice_id, series_id))"""
_LOSS = "select slice_id, split, ts, round(sum(r * r), 6) as loss from residual group by 1, 2, 3"


@check(
    "gauge_pca",
    recursive_sql(fx.GAUGE, fx.GRID.replace("grid as", "all_means as"), _TWO_SIDED, *fx.TO_SCALED[2:], _TRAIN_TEST, residual_sql("tagged")) + _LOSS,
)
def gauge_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge losses with components for 80 % of the variance, one-sided series pruned."""
    return analyses.metric_pca(fx.gauge(spark, sf_dir), *ranges(), target=0.8, cutoff=moment(fx.CUT)).withColumn("loss", r("loss"))


_SUM_GRID = """grid as (
  select slice_id, ts, priority as series_id, v from sums semi join (
    select slice_id from sums group by 1 having count(distinct ts) >= 50) using (slice_id))"""
_SUM_SPLITS = """tagged as (
  select slice_id, ts, case when ts <= timestamp '1998-06-01' then 'train' else 'test' end as split, series_id, v
  from scaled where ts > timestamp '1994-01-01')"""
_SUM_BOTH = """both_splits as (select * from tagged semi join (
    select slice_id from tagged group by 1 having count(distinct split) = 2) using (slice_id))"""


@check(
    "sum_pca",
    recursive_sql(fx.SUMS, _SUM_GRID, *fx.TO_SCALED[2:], _SUM_SPLITS, _SUM_BOTH, residual_sql("both_splits", target=0.9, plus=0)) + _LOSS,
)
def sum_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order sums with components for 90 % of the variance, one short."""
    samples = shape.assign_series(fx.sums(spark, sf_dir), ["priority"], "first_seen", ["ts", "first_key"])
    spans = analyses.seconds_range("1994-01-01", "1998-06-01"), analyses.seconds_range("1998-06-01", "2030-01-01")
    return analyses.metric_pca(samples, *spans, target=0.9, plus=0).withColumn("loss", r("loss"))


# --- histograms: two line states per bucket, so the closed form holds again ---------------

_HIST = [
    fx.HISTOGRAM,
    "grid as (select slice_id, ts, series_id, [b0, b1, b2, b3] as arr from histogram where bucket_counts is not null)",
    """dense as (select a.slice_id, a.ts, s.series_id, g.arr from (select distinct slice_id, ts from grid) a
      join (select distinct slice_id, series_id from grid) s using (slice_id) left join grid g using (slice_id, ts, series_id))""",
    """ff as (select slice_id, ts, series_id, last_value(arr ignore nulls) over (partition by slice_id, series_id order by ts
      rows between unbounded preceding and current row) as arr from dense)""",
    """filled as (select slice_id, ts, series_id, coalesce(arr, first_value(arr ignore nulls) over (partition by slice_id, series_id order by ts
      rows between current row and unbounded following)) as arr from ff)""",
    " union all ".join(
        f"""{'tall as (' if i == 0 else ''}select slice_id, {i} as bucket, ts, case when ts <= timestamp '1998-06-01' then 'train' else 'test' end as split,
      max(arr[{i + 1}]) filter (series_id = 0) as x0, max(arr[{i + 1}]) filter (series_id = 1) as x1
      from filled where ts >= timestamp '1994-01-01' group by slice_id, ts"""
        for i in range(4)
    ) + ")",
]


def _hist_ranges():
    return analyses.seconds_range("1994-01-01", "1998-06-01"), (moment("1998-06-01 00:00:01"), moment(fx.LAST))


@check(
    "histogram_loss",
    with_sql(*_HIST, closed_form("tall", "slice_id, bucket")) + "select slice_id, split, ts, round(sum(p * p) / 8, 4) as loss from scored group by 1, 2, 3",
)
def histogram_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One component per slice and bucket; mean squared error of each time over series and buckets."""
    loss, _ = analyses.histogram_pca(fx.histogram(spark, sf_dir), *_hist_ranges(), k=1, by_bounds=False)
    return loss.withColumn("loss", r("loss", 4))


@check(
    "histogram_overall_error",
    with_sql(*_HIST, closed_form("tall", "slice_id, bucket")) + "select slice_id, split, round(sum(p * p) / (count(*) * 2), 4) as mse from scored group by 1, 2",
)
def histogram_overall_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, overall = analyses.histogram_pca(fx.histogram(spark, sf_dir), *_hist_ranges(), k=1, by_bounds=False)
    return overall.withColumn("mse", r("mse", 4))


@check(
    "histogram_full_rank",
    with_sql(*_HIST) + "select distinct slice_id, split, 0.0::double as mse from tall",
)
def histogram_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At full rank every bucket is rebuilt exactly."""
    _, overall = analyses.histogram_pca(fx.histogram(spark, sf_dir), *_hist_ranges(), by_bounds=False)
    return overall.withColumn("mse", r("mse"))


@check(
    "filled_bucket_grid",
    with_sql(*_HIST[:-1]) + "select slice_id, ts, series_id, arr[1] || '.0,' || arr[2] || '.0,' || arr[3] || '.0,' || arr[4] || '.0' as counts from filled",
)
def filled_bucket_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket arrays on a dense grid, filled forward, then backward."""
    grid = buckets.bucket_grid(fx.histogram(spark, sf_dir))
    return grid.select("slice_id", "ts", "series_id", F.array_join("bucket_counts", ",").alias("counts"))


# --- windows -----------------------------------------------------------------------------

_MINMAX = [
    *fx.TO_IMPUTED,
    "one as (select * from imputed i where series_id = (select min(series_id) from imputed j where j.slice_id = i.slice_id))",
    """scaled1 as (select slice_id, ts, pos, (v - min(v) over w) / coalesce(nullif(max(v) over w - min(v) over w, 0), 1) as v
      from one window w as (partition by slice_id))""",
    """parts as (select slice_id, ts, v, case when pos < floor((max(pos) over (partition by slice_id) + 1) * 0.8::double) then 'train' else 'test' end as split from scaled1)""",
    """lagged as (select slice_id, split, ts, v as y, lag(v, 1) over w as x1, lag(v, 2) over w as x0 from parts window w as (partition by slice_id, split order by ts))""",
]


@check(
    "window_forecast_one",
    with_sql(*_MINMAX, "line as (select slice_id, regr_slope(y, x1) as m, regr_intercept(y, x1) as c from lagged where split = 'train' and x1 is not null group by 1)",
             "loss as (select slice_id, split, ts, m * x1 + c as predicted, (x1 - (m * x1 + c)) * (x1 - (m * x1 + c)) as loss from lagged join line using (slice_id) where x1 is not null)")
    + """select slice_id, split, ts, round(predicted, 6) as predicted, round(loss, 6) as loss,
    round(avg(loss) over w + 3 * stddev_pop(loss) over w, 6) as threshold, loss > avg(loss) over w + 3 * stddev_pop(loss) over w as is_anomaly
    from loss window w as (partition by slice_id, split)""",
)
def window_forecast_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast from the last value alone: a straight line per slice."""
    found = analyses.window_forecast(fx.gauge(spark, sf_dir), length=1)
    return found.select("slice_id", "split", "ts", *[r(c).alias(c) for c in ("predicted", "loss", "threshold")], "is_anomaly")


@check(
    "window_forecast_target",
    with_sql(*_MINMAX, "line as (select slice_id, regr_slope(y, x1) as m, regr_intercept(y, x1) as c from lagged where split = 'train' and x1 is not null group by 1)")
    + "select slice_id, split, ts, round((y - m * x1 - c) * (y - m * x1 - c), 6) as loss from lagged join line using (slice_id) where x1 is not null",
)
def window_forecast_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same forecast measured against the value it predicts."""
    found = analyses.window_forecast(fx.gauge(spark, sf_dir), length=1, against="target")
    return found.select("slice_id", "split", "ts", r("loss").alias("loss"))


@check("window_forecast")
def window_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast from the last fifty values."""
    return analyses.window_forecast(fx.gauge(spark, sf_dir))


@check(
    "window_reconstruction_two",
    with_sql(*_MINMAX, "pairs as (select slice_id, split, ts, x0, x1 from lagged where x0 is not null)", closed_form("pairs"))
    + "select slice_id, split, ts, round(p * p / 2, 6) as loss from scored",
)
def window_reconstruction_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two values through one component."""
    found = analyses.window_reconstruction(fx.gauge(spark, sf_dir), length=2, k=1)
    return found.select("slice_id", "split", "ts", r("loss").alias("loss"))


@check("window_reconstruction")
def window_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty values through four components."""
    return analyses.window_reconstruction(fx.gauge(spark, sf_dir))


def smoothing_sql(rows: str, levels: int, taps: tuple[float, ...] = wavelet.LOW_PASS["db4"]) -> str:
    """CTEs from ``rows`` (slice_id, split, i, v): ``smooth`` after ``levels`` steps down and up.

    Written as a gather over the eight inputs of each output, the other way round than the engine.
    """
    width = len(taps)
    values = ", ".join(f"({j}, {t}::double)" for j, t in enumerate(taps))
    out = [
        f"taps(j, h) as (values {values})",
        f"sizes as (select slice_id, split, count(*) as n0, least({levels}, case when count(*) >= {width - 1} then cast(floor(log2(count(*) / {width - 1}.0)) as int) else 0 end) as depth from {rows} group by 1, 2)",
        f"down0 as (select r.slice_id, r.split, r.i, r.v, n0 as n, depth from {rows} r join sizes using (slice_id, split))",
    ]
    for step in range(1, levels + 1):
        at = "(2 * k + 1 - j)"
        mirrored = f"case when {at} < 0 then -1 - {at} when {at} >= n then 2 * n - 1 - {at} else {at} end"
        out.append(
            f"""down{step} as (select o.slice_id, o.split, o.k as i, sum(h * v) as v, (n + {width - 1}) // 2 as n, o.depth from (
            select slice_id, split, n, depth, k, h, {mirrored} as src from (
              select distinct slice_id, split, n, depth from down{step - 1} where depth >= {step}) s, unnest(range(0, (n + {width - 1}) // 2)) as t(k), taps) o
            join (select slice_id, split, i, v from down{step - 1}) d on d.slice_id = o.slice_id and d.split = o.split and d.i = o.src
            group by o.slice_id, o.split, o.k, n, o.depth)"""
        )
    above = f"select slice_id, split, i, v, depth from down{levels}"
    for step in range(levels, 0, -1):
        out.append(f"low{step} as ({above})")
        out.append(
            f"""up{step} as (select o.slice_id, o.split, o.i, sum(h * l.v) as v, o.depth from (
            select slice_id, split, depth, i, h, (i + {width - 2} - ({width - 1} - j)) // 2 as k, (i + {width - 2} - ({width - 1} - j)) % 2 as odd
            from (select distinct slice_id, split, n, depth from down{step - 1} where depth >= {step}) s, unnest(range(0, n)) as t(i), taps) o
            join low{step} l on l.slice_id = o.slice_id and l.split = o.split and l.i = o.k where o.odd = 0 group by o.slice_id, o.split, o.i, o.depth)"""
        )
        above = f"select * from up{step} union all select slice_id, split, i, v, depth from down{step - 1} where depth = {step - 1}"
    out.append(f"smooth as ({above})")
    return ",\n".join(out)


_WAVE_ROWS = [
    *_MINMAX[:-2],
    f"""waves as (select slice_id, split, row_number() over (partition by slice_id, split order by ts) - 1 as i, v, ts
      from (select slice_id, ts, v, {SPLIT_SQL} from scaled1))""",
]


def _wave_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = store(shape.to_grid(fx.gauge(spark, sf_dir)))
    grid = store(impute.impute(means, only=shape.lowest_series(means)))
    scaled = scale.apply_scaler(grid, scale.fit_minmax(grid))
    return store(split.restart_positions(split.tag_ranges(scaled, *ranges())))


@check(
    "wavelet_smooth_two_levels",
    with_sql(*_WAVE_ROWS, smoothing_sql("waves", 2)) + "select slice_id, split, i as pos, round(v, 6) as value from smooth",
)
def wavelet_smooth_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = wavelet.wavelet_smooth(_wave_parts(spark, sf_dir), "db4", level=2)
    return smooth.select("slice_id", "split", "pos", r("value").alias("value"))


@check(
    "wavelet_smooth",
    with_sql(*_WAVE_ROWS, smoothing_sql("waves", 12)) + "select slice_id, split, i as pos, round(v, 6) as value from smooth",
)
def wavelet_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing to the deepest level of each slice and split."""
    smooth = wavelet.wavelet_smooth(_wave_parts(spark, sf_dir), "db4")
    return smooth.select("slice_id", "split", "pos", r("value").alias("value"))


@check("wavelet_forecast")
def wavelet_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window forecast on smoothed ranges."""
    return analyses.wavelet_forecast(fx.gauge(spark, sf_dir), *ranges())


# --- isolation forest --------------------------------------------------------------------

_HASHED = """case when ((span_id * 7919 + 42) % 10007) / 10007.0::double < 0.7::double then 'train'
  when ((span_id * 7919 + 42) % 10007) / 10007.0::double < 0.7::double + 0.15::double then 'validation' else 'test' end"""


def forest_sql(trees: int = 100, sample: int = 256, seed: int = 42, levels: int = 8) -> str:
    """CTEs ``nodes`` and ``scores``: the forest grown and walked level by level."""
    m, rf, tf, nf, steps = iforest.MODULUS, iforest.ROW_FACTOR, iforest.TREE_FACTOR, iforest.NODE_FACTOR, iforest.FRACTION_STEPS
    mixed = f"(((span_id % {m}) * ({rf} + {tf} * tree) + {nf} * (tree + {seed})) % {m})"
    choice = f"((tree * {tf} + node * {nf} + {seed} * 31 + 17) % {m})"
    path = lambda n: f"case when {n} > 2 then 2 * (ln({n} - 1.0::double) + {iforest.EULER_GAMMA}::double) - 2 * ({n} - 1.0::double) / {n} when {n} = 2 then 1.0 else 0.0 end"
    out = [
        f"rows0 as (select span_id, {_HASHED} as split, duration as d, v as m from spans join metrics using (ts))",
        "stats as (select avg(d) as md, stddev_pop(d) as sd, avg(m) as mm, stddev_pop(m) as sm from rows0 where split = 'train')",
        "feats as (select span_id, split, (d - md) / sd as f0, (m - mm) / sm as f1 from rows0, stats)",
        f"""picked as (select tree, f0, f1, 1 as node from (select *, row_number() over (partition by tree order by rank, span_id) as place from (
          select span_id, f0, f1, tree, ({mixed} * {mixed} + span_id) % {m} as rank from feats, (select cast(range as bigint) as tree from range({trees})) where split = 'train'))
          where place <= {sample})""",
    ]
    current = "picked"
    for level in range(levels + 1):
        stop = "true" if level == levels else "n <= 1 or (lo0 = hi0 and lo1 = hi1)"
        out.append(
            f"""box{level} as materialized (select *, (h // 2 % {steps} + 0.5::double) / {steps} as part,
              case when {stop} then -1 when lo0 = hi0 then 1 when lo1 = hi1 then 0 else h % 2 end as feature from (
              select tree, node, count(*) as n, min(f0) as lo0, max(f0) as hi0, min(f1) as lo1, max(f1) as hi1, any_value({choice} * {choice} % {m}) as h
              from {current} group by tree, node))"""
        )
        out.append(
            f"""level{level} as materialized (select tree, node, n, feature, case feature when 0 then lo0 + part * (hi0 - lo0) when 1 then lo1 + part * (hi1 - lo1) else 0 end as threshold from box{level})"""
        )
        if level < levels:
            out.append(
                f"""rows{level + 1} as materialized (select c.tree, f0, f1, 2 * c.node + case when case feature when 0 then f0 else f1 end < threshold then 0 else 1 end as node
                from {current} c join level{level} l on c.tree = l.tree and c.node = l.node where feature >= 0)"""
            )
            current = f"rows{level + 1}"
    out.append("nodes as (" + " union all ".join(f"select * from level{level}" for level in range(levels + 1)) + ")")
    walk = "(select span_id, f0, f1, tree, cast(1 as bigint) as node from feats, (select cast(range as bigint) as tree from range(%d)))" % trees
    ends = []
    for level in range(levels + 1):
        out.append(
            f"""walk{level} as materialized (select w.span_id, f0, f1, w.tree, w.node, n, feature, threshold from {walk} w join level{level} l on l.tree = w.tree and l.node = w.node)"""
        )
        ends.append(f"select span_id, {level} + {path('n')} as depth from walk{level} where feature < 0")
        walk = f"(select span_id, f0, f1, tree, 2 * node + case when case feature when 0 then f0 else f1 end < threshold then 0 else 1 end as node from walk{level} where feature >= 0)"
    psi = f"(select least({sample}, count(*)) as psi from feats where split = 'train')"
    out.append(
        f"""scores as (select span_id, power(2.0::double, -(sum(depth) / {trees}) / (select {path('psi')} from {psi})) as score
          from ({' union all '.join(ends)}) group by span_id)"""
    )
    return ",\n".join(out)


_FOREST = [fx.SPANS, fx.METRICS, forest_sql()]
_FEATURES = ["span_duration", "metric_value"]


def _forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators import traces

    joined = traces.span_features(traces.join_telemetry(fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir)))
    rows = store(split.split_hashed(joined, "span_id").na.drop(subset=_FEATURES))
    return store(scale.scale_features(rows, scale.fit_features(rows.filter("split = 'train'"), _FEATURES)))


_LABELS = "limits as (select quantile_cont(score, 0.9) as t from scores join feats using (span_id) where split = 'train')"
_LABELLED = f"""select s.span_id, {_HASHED.replace("span_id", "s.span_id")} as split, round(score, 6) as score,
    cast(case when score is null then null when score > t then -1 else 1 end as int) as anomaly, case when score is null then 'no metric' end as note
    from spans s left join scores using (span_id), limits"""


@check(
    "forest_nodes",
    with_sql(*_FOREST) + "select cast(tree as int) as tree, cast(node as bigint) as node, cast(feature as int) as feature, round(threshold, 6) as threshold, n as size from nodes",
)
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred trees of the forest."""
    rows = _forest_rows(spark, sf_dir).filter("split = 'train'")
    return iforest.fit_iforest(rows, _FEATURES, "span_id").withColumn("threshold", r("threshold"))


@check(
    "span_isolation",
    with_sql(*_FOREST, _LABELS) + _LABELLED,
)
def span_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans beside metrics, scored by the forest; a tenth of the train rows counts as anomalous."""
    found = analyses.span_isolation(fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir))
    return found.select("span_id", "split", r("score").alias("score"), "anomaly", "note")


@check("span_isolation_unmatched", with_sql(fx.SPANS, fx.VIEW_METRICS, forest_sql(), _LABELS) + _LABELLED)
def span_isolation_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one event type only: spans at hours without one stay in the result, unscored."""
    found = analyses.span_isolation(fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir, "view"))
    return found.select("span_id", "split", r("score").alias("score"), "anomaly", "note")


_SLICES = """case event_id % 3 when 0 then '007' when 1 then '1.50' else '{"service":"' || repeat('x', 400) || '"}' end"""


@check("loss_sink_long_ids", f"""select {_SLICES} as slice_id, event_id, "value" as loss from events""")
def loss_sink_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice ids that look like numbers, and one of 400 characters, come back as they were written."""
    path = fresh_path(spark, "loss")
    events = table(spark, sf_dir, "events")
    writers.write_loss(events.select(F.expr(_SLICES).alias("slice_id"), "event_id", F.col("value").alias("loss")), path)
    return writers.read_loss(spark, path)


# --- results of detectors ----------------------------------------------------------------

_LIMITS = """losses as (select event_type as slice_id, case when ts < timestamp '2024-01-10' then 'train' else 'test' end as split, event_id, ts, "value" as loss from events),
    flags as (select *, avg(loss) over w + 3 * stddev_pop(loss) over w as threshold, loss > avg(loss) over w + 3 * stddev_pop(loss) over w as is_anomaly
      from losses window w as (partition by slice_id, split))"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slice_id"),
        F.when(F.col("ts") < moment("2024-01-10"), "train").otherwise("test").alias("split"),
        "event_id", "ts", F.col("value").alias("loss"),
    )


@check("loss_sink", with_sql(_LIMITS) + "select slice_id, split, ts, loss from losses")
def loss_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses written in one folder per slice and read back."""
    path = fresh_path(spark, "loss")
    writers.write_loss(_losses(spark, sf_dir).drop("event_id"), path)
    return writers.read_loss(spark, path).select("slice_id", "split", "ts", "loss")


@check(
    "anomaly_report",
    with_sql(_LIMITS) + """select slice_id, split, event_id, position from (
      select *, row_number() over (partition by slice_id, split order by ts) - 1 as position from flags) where is_anomaly""",
)
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows with their position in slice and split."""
    flags = thresholds.sigma_threshold(_losses(spark, sf_dir))
    return thresholds.anomaly_report(flags).select("slice_id", "split", "event_id", "position")


@check(
    "labelled_points",
    """with points as (select event_id, "value" as value, case when event_id % 20 < 14 then 'train' when event_id % 20 < 17 then 'validation' else 'test' end as split,
      case when "value" > 60 then -1 else 1 end as anomaly from events)
    select event_id, value, 'Normal' as point from points union all select event_id, value, 'Validation Anomalies' from points where split = 'validation' and anomaly = -1
    union all select event_id, value, 'Test Anomalies' from points where split = 'test' and anomaly = -1""",
)
def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point, and the flagged validation and test points again under their own label."""
    part = F.col("event_id") % 20
    df = table(spark, sf_dir, "events").select(
        "event_id", "value",
        F.when(part < 14, "train").when(part < 17, "validation").otherwise("test").alias("split"),
        F.when(F.col("value") > 60, -1).otherwise(1).alias("anomaly"),
    )
    return thresholds.labelled_points(df).select("event_id", "value", "point")


@check(
    "top_signals",
    with_sql(*fx.TO_SCALED) + f"""select slice_id, ts, series_id, {SPLIT_SQL}, round(v, 6) as value from scaled
    where (slice_id, series_id) in (select (slice_id, series_id) from scaled where v * v > 40)""",
)
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled signals, in both splits, of the series that were named at some flagged time."""
    grid = store(scaled_grid(spark, sf_dir))
    named = grid.filter(pca.sq_error(F.col("value")) > 40)
    tagged = split.tag_ranges(grid, *ranges())
    return thresholds.top_signals(tagged, named).select("slice_id", "ts", "series_id", "split", r("value").alias("value"))


@check(
    "detector_quality",
    with_sql(_LIMITS, fx.LOG, """truth as (select e.event_id, exists (select 1 from log where e.ts between start_ts and end_ts) as t from events e)""",
             """calls as (select event_id, 'sigma' as detector, is_anomaly as f from flags union all select event_id, 'fixed', loss > 50 from losses)""",
             """counts as (select detector, count(*) filter (f and t) as tp, count(*) filter (f and not t) as fp, count(*) filter (not f and t) as fn, count(*) filter (not f and not t) as tn
               from calls join truth using (event_id) group by 1)""")
    + """select *, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall,
    round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1 from counts""",
)
def detector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors against the logged intervals."""
    losses = _losses(spark, sf_dir)
    sigma = thresholds.sigma_threshold(losses).select("event_id", "ts", F.lit("sigma").alias("detector"), F.col("is_anomaly").alias("flagged"))
    fixed = losses.select("event_id", "ts", F.lit("fixed").alias("detector"), (F.col("loss") > 50).alias("flagged"))
    labelled = labels.label_intervals(sigma.unionByName(fixed), fx.anomaly_log(spark, sf_dir))
    out = labels.evaluate(labelled)
    return out.select("detector", "tp", "fp", "fn", "tn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


_LINE = "line as (select slice_id, regr_slope(y, x1) as m, regr_intercept(y, x1) as c from lagged where split = 'train' and x1 is not null group by 1)"
_LINE_LOSS = "loss as (select slice_id, split, ts, (y - m * x1 - c) * (y - m * x1 - c) as loss from lagged join line using (slice_id) where x1 is not null)"
_SIGMA = "select ts, loss > avg(loss) over w + 3 * stddev_pop(loss) over w as f from loss window w as (partition by slice_id, split)"
#: What each detector says of its rows: ts and the flag f.
_DETECTORS = {
    "pca": recursive_sql(
        *fx.TO_SCALED, _TRAIN_TEST, residual_sql("tagged"), "loss as (select slice_id, split, ts, sum(r * r) as loss from residual group by 1, 2, 3)"
    ) + _SIGMA,
    "forecast": with_sql(*_MINMAX, _LINE, _LINE_LOSS) + _SIGMA,
    "reconstruction": with_sql(
        *_MINMAX, "pairs as (select slice_id, split, ts, x0, x1 from lagged where x0 is not null)", closed_form("pairs"),
        "loss as (select slice_id, split, ts, p * p / 2 as loss from scored)",
    ) + _SIGMA,
    "wavelet": with_sql(
        *_WAVE_ROWS, smoothing_sql("waves", 12),
        """lagged as (select slice_id, split, ts, smooth.v as y, lag(smooth.v) over (partition by slice_id, split order by i) as x1
          from smooth join waves using (slice_id, split, i))""",
        _LINE, _LINE_LOSS,
    ) + _SIGMA,
    "forest": with_sql(*_FOREST, _LABELS) + "select s.ts, coalesce(score > t, false) as f from spans s left join scores using (span_id), limits",
}


@check(
    "detector_comparison",
    with_sql(
        fx.LOG,
        "calls as (" + " union all ".join(f"select '{name}' as detector, ts, f from ({sql})" for name, sql in _DETECTORS.items()) + ")",
        "truth as (select ts, exists (select 1 from log where c.ts between date_trunc('hour', start_ts) and end_ts) as t from (select distinct ts from calls) c)",
        """counts as (select detector, count(*) filter (f and t) as tp, count(*) filter (f and not t) as fp, count(*) filter (not f and t) as fn,
          count(*) filter (not f and not t) as tn from calls join truth using (ts) group by 1)""",
    )
    + """select *, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall,
    round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1 from counts""",
)
def detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, forecast, reconstruction, smoothed forecast and forest against the logged intervals."""
    samples = fx.gauge(spark, sf_dir)
    train, test = ranges()
    # The wavelet ranges hold both their ends, so its test range starts after the cut.
    later = moment(fx.CUT.replace("00:00:00", "00:00:01")), moment(fx.LAST)
    forest = analyses.span_isolation(fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir))
    results = {
        "pca": thresholds.sigma_threshold(store(analyses.metric_pca(samples, train, test))),
        "forecast": analyses.window_forecast(samples, length=1, against="target"),
        "reconstruction": analyses.window_reconstruction(samples, length=2, k=1),
        "wavelet": analyses.wavelet_forecast(samples, train, later, length=1, against="target"),
        "forest": forest.withColumn("is_anomaly", F.col("anomaly") == -1),
    }
    # Samples stand at full hours, so an interval counts from the hour it begins in.
    log = fx.anomaly_log(spark, sf_dir).withColumn("start_ts", fx.hour("start_ts"))
    out = labels.compare_detectors(results, log)
    return out.select("detector", "tp", "fp", "fn", "tn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@check(
    "window_reconstruction_eight",
    recursive_sql(
        *_MINMAX,
        "windowed as (select slice_id, split, ts, list(v) over (partition by slice_id, split order by ts rows between 8 preceding and 1 preceding) as x from parts)",
        "cells as (select slice_id, split, ts, unnest(range(8)) as series_id, unnest(x) as v from windowed where len(x) = 8)",
        residual_sql("cells", k=4),
    ) + "select slice_id, split, ts, round(avg(r * r), 6) as loss from residual group by 1, 2, 3",
)
def window_reconstruction_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight values through four components."""
    found = analyses.window_reconstruction(fx.gauge(spark, sf_dir), length=8)
    return found.select("slice_id", "split", "ts", r("loss").alias("loss"))


# --- raw exports to losses --------------------------------------------------------------

def _gauge_exports(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two CSV exports of all events that share rows; the first holds one row in ten twice."""
    raw = fx.raw_gauge(spark, sf_dir)
    known = {
        "ScopeName": F.lit("scope"), "MetricName": F.lit("metric"), "TimeUnix": F.date_trunc("hour", F.col("TimeUnix")).cast("string"),
        "Attributes": F.concat(F.lit("{'unit': '1', 'series': 's"), F.col("user_id") % 4, F.lit("'}")), "SpanId": F.col("event_id").cast("string"),
        "ResourceAttributes": F.col("ResourceAttributes"), "Value": F.col("Value"),
    }
    names = [c.split()[0] for c in schemas.GAUGE.split(", ")]
    columns = [known.get(c, F.lit(None).cast("string")).alias(c) for c in names]
    digit = F.col("event_id") % 10
    first = raw.filter(digit <= 6)
    out = []
    for part in (first.unionByName(first.filter(digit == 0)), raw.filter(digit >= 4)):
        path = fresh_path(spark, "export")
        part.select(*columns).write.option("escape", '"').csv(path)
        out.append(readers.read_metrics_csv(spark, path, schemas.GAUGE))
    return out


_EXPORT_ROWS = """export_rows as (
  select case when event_id % 97 = 0 then 'unparsed ' || event_type
           else '{"host.name":"h' || (user_id % 3) || '","os.type":"linux","service.name":"' || event_type || '"}' end as slice_id,
         user_id % 4 as series_id, date_trunc('hour', ts) as ts, "value" as v, case when event_id % 10 = 0 then 2 else 1 end as copies
  from events where event_id % 17 <> 0 and event_id % 19 <> 0 and "value" is not null)"""
_EXPORT_GRID = """grid as (
  select slice_id, ts, series_id, sum(v * copies) / sum(copies) as v
  from export_rows semi join (select slice_id from export_rows group by 1 having count(distinct ts) >= 50) using (slice_id) group by 1, 2, 3)"""
_EXPORT_BOTH = """both_splits as (select * from tagged semi join (
    select slice_id from tagged group by 1 having count(distinct split) = 2) using (slice_id))"""


@check(
    "gauge_export_pca",
    recursive_sql(_EXPORT_ROWS, _EXPORT_GRID, *fx.TO_SCALED[2:], _TRAIN_TEST, _EXPORT_BOTH, residual_sql("both_splits", k=2)) + _LOSS,
)
def gauge_export_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw gauge exports in CSV to the losses of every resource, two components kept."""
    samples = exports.metric_samples(_gauge_exports(spark, sf_dir))
    return analyses.metric_pca(samples, *ranges(), k=2).withColumn("loss", r("loss"))
