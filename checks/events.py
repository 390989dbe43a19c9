"""Queries on events rather than samples: roots of spans, alarms against logged intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import r, with_sql
from checks.models import _LIMITS, _losses
from checks.registry import check
from driftgrid.operators import labels, thresholds, traces
from driftgrid.session import store

_FOREST = """cut as (select span_id, case when span_id % 64 <> 5 then parent_span_id end as parent_span_id from spans)"""


@check(
    "span_roots",
    f"""with recursive {fx.SPANS}, {_FOREST},
    up as (select span_id, span_id as root_id, parent_span_id as above, cast(0 as bigint) as depth from cut
      union all select u.span_id, p.span_id, p.parent_span_id, depth + 1 from up u join cut p on p.span_id = u.above)
    select span_id, root_id, depth from up where above is null""",
)
def span_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every span, in a forest: one span in 64 has lost its parent."""
    spans = fx.spans(spark, sf_dir)
    return traces.span_roots(spans.withColumn("parent_span_id", F.when(F.col("span_id") % 64 != 5, F.col("parent_span_id"))))


_ALARMS = """calls as (select ts, 'sigma' as detector from flags where is_anomaly union all select ts, 'fixed' from losses where loss > 50),
    stepped as (select detector, ts, coalesce(ts > lag(ts) over w + interval 1 hour, true) as new from calls window w as (partition by detector order by ts)),
    numbered as (select *, sum(cast(new as int)) over (partition by detector order by ts rows between unbounded preceding and current row) as run from stepped),
    alarms as (select detector, min(ts) as start_ts, max(ts) as end_ts, count(*) as n from numbered group by detector, run)"""


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = _losses(spark, sf_dir)
    sigma = thresholds.sigma_threshold(losses).select("ts", F.lit("sigma").alias("detector"), F.col("is_anomaly").alias("flagged"))
    fixed = losses.select("ts", F.lit("fixed").alias("detector"), (F.col("loss") > 50).alias("flagged"))
    return store(labels.alarms(sigma.union(fixed)))


@check("alarm_runs", with_sql(_LIMITS, _ALARMS) + "select detector, start_ts, end_ts, n from alarms")
def alarm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of flagged times of two detectors."""
    return _alarms(spark, sf_dir)


@check(
    "intervals_found",
    with_sql(
        _LIMITS, _ALARMS, fx.LOG,
        """met as (select a.detector, l.event_id, count(*) as alarms, min(greatest(epoch_us(a.start_ts) - epoch_us(l.start_ts), 0)) / 1000000.0::double as delay_seconds
          from alarms a join log l on a.start_ts <= l.end_ts and l.start_ts <= a.end_ts group by 1, 2)""",
    )
    + """select detector, event_id, alarms is not null as found, coalesce(alarms, 0) as alarms, round(delay_seconds, 6) as delay_seconds
    from (select event_id, unnest(['sigma', 'fixed']) as detector from log) left join met using (detector, event_id)""",
)
def intervals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged interval: found or missed by each detector, and how late."""
    found = labels.found_intervals(_alarms(spark, sf_dir), fx.anomaly_log(spark, sf_dir), ["sigma", "fixed"])
    return found.select("detector", "event_id", "found", "alarms", r("delay_seconds").alias("delay_seconds"))


@check(
    "alarms_judged",
    with_sql(_LIMITS, _ALARMS, fx.LOG)
    + "select detector, start_ts, end_ts, n, exists (select 1 from log l where a.start_ts <= l.end_ts and l.start_ts <= a.end_ts) as is_true from alarms a",
)
def alarms_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm: true if it meets a logged interval."""
    return labels.judged_alarms(_alarms(spark, sf_dir), fx.anomaly_log(spark, sf_dir))
