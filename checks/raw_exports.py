"""Queries from raw export files to results, for sums, histograms, windows and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import r, recursive_sql, table, with_sql
from checks.models import _EXPORT_GRID, _EXPORT_ROWS, _HIST, _LABELLED, _LABELS, _LINE, _LOSS, _MINMAX, _SUM_BOTH, _SUM_GRID, _SUM_SPLITS, _gauge_exports, _hist_ranges, closed_form, forest_sql
from checks.registry import check
from checks.spectrum import residual_sql
from driftgrid.plans import analyses, exports
from driftgrid.session import fresh_path
from driftgrid.sources import readers, schemas


def written(df: DataFrame, parts: Sequence[Column], known: dict[str, Column], schema: str, wide: bool = False) -> list[DataFrame]:
    """The rows of each condition as a CSV export with the columns of ``schema``, read back."""
    spark, out = df.sparkSession, []
    columns = [known.get(c, F.lit(None)).cast("string").alias(c) for c in schemas.columns(schema)]
    for part in parts:
        path = fresh_path(spark, "export")
        writer = df.filter(part).select(*columns).write.option("escape", '"')
        (writer.option("encoding", "UTF-16LE").option("lineSep", "\n") if wide else writer).csv(path)
        out.append(readers.read_metrics_csv(spark, path, schema, encoding="UTF-16" if wide else "UTF-8"))
    return out


def resource(name: str) -> Column:
    return F.concat(F.lit("{'service.name': '"), F.col(name), F.lit("', 'telemetry.sdk': 'x'}"))


_NAMED = """'{"service.name":"' || %s || '"}'"""


@check(
    "sum_export_pca",
    recursive_sql(
        fx.SUMS.replace("o_orderstatus as slice_id", _NAMED % "o_orderstatus" + " as slice_id"), _SUM_GRID, *fx.TO_SCALED[2:], _SUM_SPLITS, _SUM_BOTH,
        residual_sql("both_splits", target=0.9, plus=0),
    ) + _LOSS,
)
def sum_export_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two UTF-16 exports of sums, which share rows, to the losses of every resource."""
    sums = fx.sums(spark, sf_dir)
    known = {"ResourceAttributes": resource("slice_id"), "MetricName": F.lit("orders"), "Attributes": F.concat(F.lit("{'priority': '"), F.col("priority"), F.lit("'}")),
             "TimeUnix": F.col("ts"), "Value": F.col("value"), "IsMonotonic": F.lit("true")}
    early, late = F.col("ts") < "1996-01-01", F.col("ts") >= "1995-06-01"
    samples = exports.metric_samples(written(sums, (early, late), known, schemas.SUM, wide=True), schemas.SUM_SERIES)
    spans = analyses.seconds_range("1994-01-01", "1998-06-01"), analyses.seconds_range("1998-06-01", "2030-01-01")
    return analyses.metric_pca(samples, *spans, target=0.9, plus=0).withColumn("loss", r("loss"))


#: Counts by return flag, line state, week and one of two bounds texts; one supplier in five names no bounds.
_BOUNDS = "case when l_suppkey % 5 = 0 then null when l_suppkey % 2 = 0 then '[10, 20, 35]' else '[10.0, 20.0, 35.0]' end"
_BOUNDED = f"""bounded as (
  select {_NAMED % "l_returnflag"} || '_' || bounds as slice_id, case when l_linestatus = 'F' then 0 else 1 end as series_id, ts, b0, b1, b2, b3
  from (select l_returnflag, l_linestatus, date_trunc('week', l_shipdate) as ts, {_BOUNDS} as bounds,
      count(*) filter (l_quantity <= 10) as b0, count(*) filter (l_quantity > 10 and l_quantity <= 20) as b1,
      count(*) filter (l_quantity > 20 and l_quantity <= 35) as b2, count(*) filter (l_quantity > 35) as b3
    from lineitem group by all) where bounds is not null)"""


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus", fx.week("l_shipdate").alias("ts"), F.expr(_BOUNDS).alias("bounds"))
        .agg(F.count_if(q <= 10).alias("b0"), F.count_if((q > 10) & (q <= 20)).alias("b1"), F.count_if((q > 20) & (q <= 35)).alias("b2"), F.count_if(q > 35).alias("b3"))
    )


@check(
    "histogram_export_loss",
    with_sql(_BOUNDED, "grid as (select slice_id, ts, series_id, [b0, b1, b2, b3] as arr from bounded)", *_HIST[2:], closed_form("tall", "slice_id, bucket"))
    + "select slice_id, split, ts, round(sum(p * p) / 8, 4) as loss from scored group by 1, 2, 3",
)
def histogram_export_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histogram exports to the losses of every resource and bounds, one component kept."""
    known = {"ResourceAttributes": resource("l_returnflag"), "MetricName": F.concat(F.lit("state "), F.col("l_linestatus")), "TimeUnix": F.col("ts"),
             "BucketCounts": F.format_string("[%d, %d, %d, %d]", "b0", "b1", "b2", "b3"), "ExplicitBounds": F.coalesce("bounds", F.lit("\\N"))}
    parts = F.col("ts") < "1996-01-01", F.col("ts") >= "1995-01-01"
    samples = exports.histogram_samples(written(bounded(spark, sf_dir), parts, known, schemas.HISTOGRAM))
    loss, _ = analyses.histogram_pca(samples, *_hist_ranges(), k=1)
    return loss.withColumn("loss", r("loss", 4))


@check(
    "histogram_loss_by_bounds",
    with_sql(
        _BOUNDED.replace(_NAMED % "l_returnflag", "l_returnflag"), "grid as (select slice_id, ts, series_id, [b0, b1, b2, b3] as arr from bounded)",
        *_HIST[2:], closed_form("tall", "slice_id, bucket"),
    ) + "select slice_id, split, ts, round(sum(p * p) / 8, 4) as loss from scored group by 1, 2, 3",
)
def histogram_loss_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose slices have two bounds texts each: a slice and its models for every one."""
    samples = bounded(spark, sf_dir).select(
        F.col("l_returnflag").alias("slice_id"), "ts", F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("series_id"),
        F.format_string("[%d, %d, %d, %d]", "b0", "b1", "b2", "b3").alias("bucket_counts"), F.col("bounds").alias("explicit_bounds"),
    )
    loss, _ = analyses.histogram_pca(samples, *_hist_ranges(), k=1)
    return loss.withColumn("loss", r("loss", 4))


@check(
    "window_export_forecast",
    with_sql(_EXPORT_ROWS, _EXPORT_GRID, *fx.TO_IMPUTED[2:], *_MINMAX[len(fx.TO_IMPUTED):], _LINE)
    + "select slice_id, split, ts, round((y - m * x1 - c) * (y - m * x1 - c), 6) as loss from lagged join line using (slice_id) where x1 is not null",
)
def window_export_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge exports to the forecast loss of the first series of every resource."""
    samples = exports.metric_samples(_gauge_exports(spark, sf_dir), schemas.WINDOW_SERIES)
    found = analyses.window_forecast(samples, length=1, against="target")
    return found.select("slice_id", "split", "ts", r("loss").alias("loss"))


@check("trace_export_isolation", with_sql(fx.SPANS, fx.METRICS, forest_sql(), _LABELS) + _LABELLED)
def trace_export_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flat trace exports, which share spans, beside hourly metrics, scored by the forest."""
    known = {"Timestamp": F.col("ts"), "TraceId": F.lit(1), "SpanId": F.col("span_id"), "ParentSpanId": F.coalesce(F.col("parent_span_id").cast("string"), F.lit("\\N")),
             "ServiceName": F.col("service"), "Duration": F.col("duration"), "Events.Name": F.lit("start")}
    digit = F.col("span_id") % 10
    spans = exports.spans(written(fx.spans(spark, sf_dir), (digit <= 6, digit >= 4), known, schemas.TRACES_FLAT))
    found = analyses.span_isolation(spans, fx.hourly_metrics(spark, sf_dir))
    return found.select("span_id", "split", r("score").alias("score"), "anomaly", "note")
