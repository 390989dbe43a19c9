r"""Telemetry views over the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour(col: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(col)).cast("timestamp_ntz")


def week(col: str) -> Column:
    return F.date_trunc("week", F.col(col)).cast("timestamp_ntz")


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def with_sql(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def recursive_sql(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


# Gauge samples: event types as slices, four series each, hourly, one value in seventeen null.

def gauge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 17 == 0, F.lit("\\N")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slice_id"),
        (F.col("user_id") % 4).cast("int").alias("series_id"),
        hour().alias("ts"),
        value.alias("value"),
        "event_id",
    )


GAUGE_TEXT = r"""gauge_text as (
  select event_type as slice_id, cast(user_id % 4 as int) as series_id, date_trunc('hour', ts) as ts,
         case when event_id % 17 = 0 then '\N' else cast("value" as varchar) end as v, event_id
  from events)"""


def gauge(spark: SparkSession, sf_dir: str, series: int = 4) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slice_id"),
        (F.col("user_id") % series).cast("int").alias("series_id"),
        hour().alias("ts"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        "event_id",
    )


def gauge_sql(series: int = 4) -> str:
    return f"""gauge as (
  select event_type as slice_id, cast(user_id % {series} as int) as series_id, date_trunc('hour', ts) as ts,
         case when event_id % 17 <> 0 then "value" end as v, event_id
  from events)"""


GAUGE = gauge_sql()
GRID = """grid as (
  select slice_id, ts, series_id, avg(v) as v from gauge where v is not null group by slice_id, ts, series_id)"""
AXIS = """axis as (
  select slice_id, ts, row_number() over (partition by slice_id order by ts) - 1 as pos
  from (select distinct slice_id, ts from grid))"""
DENSE = """dense as (
  select a.slice_id, a.ts, s.series_id, g.v, a.pos
  from axis a join (select distinct slice_id, series_id from grid) s using (slice_id)
  left join grid g using (slice_id, ts, series_id))"""
SMA = """sma as (
  select slice_id, ts, series_id, pos, coalesce(v, avg(v) over (
    partition by slice_id, series_id order by ts rows between 2 preceding and current row)) as v
  from dense)"""
FFILL = """ff as (
  select slice_id, ts, series_id, pos, last_value(v ignore nulls) over (
    partition by slice_id, series_id order by ts rows between unbounded preceding and current row) as v
  from sma)"""
IMPUTED = """imputed as (
  select slice_id, ts, series_id, pos, coalesce(v, first_value(v ignore nulls) over (
    partition by slice_id, series_id order by ts rows between current row and unbounded following)) as v
  from ff)"""
SCALED = """scaled as (
  select slice_id, ts, series_id, pos,
         (v - avg(v) over (partition by slice_id, series_id))
         / coalesce(nullif(stddev_pop(v) over (partition by slice_id, series_id), 0), 1) as v
  from imputed)"""
TO_DENSE = [GAUGE, GRID, AXIS, DENSE]
TO_IMPUTED = [*TO_DENSE, SMA, FFILL, IMPUTED]
TO_SCALED = [*TO_IMPUTED, SCALED]


def to_scaled(series: int) -> list[str]:
    return [gauge_sql(series), *TO_SCALED[1:]]


# Train and test ranges that lie inside the data at every scale.
CUT = "2024-01-10 00:00:00"
LAST = "2030-01-01 00:00:00"
FIRST = "2023-12-31 00:00:00"


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# Raw gauge export rows with attribute text, as the exporter writes them.

def raw_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, host, box = F.col("event_type"), (F.col("user_id") % 3).cast("string"), F.col("user_id").cast("string")
    forward = F.concat(
        F.lit("{'service.name': '"), kind, F.lit("', 'host.name': 'h"), host,
        F.lit("', 'os.type': 'linux', 'container.id': 'c"), box, F.lit("', 'zone': None}"),
    )
    backward = F.concat(
        F.lit("{'zone': None, 'container.id': 'c"), box, F.lit("', 'os.type': 'linux', 'host.name': 'h"), host,
        F.lit("', 'service.name': '"), kind, F.lit("'}"),
    )
    text = (
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("unparsed "), kind))
        .when(F.col("event_id") % 2 == 0, forward)
        .otherwise(backward)
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.alias("ResourceAttributes"),
        F.lit("https://schema").alias("ResourceSchemaUrl"),
        F.concat(F.lit("scope"), F.col("user_id") % 2).alias("ScopeName"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("v"), F.col("user_id") % 3)).alias("ScopeVersion"),
        F.lit(None).cast("string").alias("ScopeSchemaUrl"),
        F.concat(F.lit("metric"), F.col("user_id") % 7).alias("MetricName"),
        F.col("ts").cast("string").alias("TimeUnix"),
        F.when(F.col("event_id") % 17 == 0, F.lit("\\N"))
        .when(F.col("event_id") % 19 == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string")).alias("Value"),
        "event_type",
        "user_id",
    )


# Histogram exports: return flags as slices, two line states as series, four buckets, weekly;
# one state has a bounds text of its own.

def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("slice_id"),
            F.col("l_linestatus").alias("state"),
            week("l_shipdate").alias("ts"),
        )
        .agg(
            F.count_if(q <= 10).alias("b0"),
            F.count_if((q > 10) & (q <= 20)).alias("b1"),
            F.count_if((q > 20) & (q <= 35)).alias("b2"),
            F.count_if(q > 35).alias("b3"),
        )
        .withColumn("series_id", F.when(F.col("state") == "F", 0).otherwise(1))
        .withColumn(
            "bucket_counts",
            F.when(F.col("b0") % 11 != 0, F.format_string("[%d, %d, %d, %d]", "b0", "b1", "b2", "b3")),
        )
        .withColumn(
            "explicit_bounds",
            F.when((F.col("slice_id") == "A") | (F.col("state") == "F"), F.lit("[10, 20, 35]"))
            .when(F.col("b1") % 7 != 0, F.lit("[10.0, 20.0, 35.0]")),
        )
    )


HISTOGRAM = """histogram as (
  select slice_id, state, ts, b0, b1, b2, b3, case when state = 'F' then 0 else 1 end as series_id,
         case when b0 % 11 <> 0 then '[' || b0 || ', ' || b1 || ', ' || b2 || ', ' || b3 || ']' end as bucket_counts,
         case when slice_id = 'A' or state = 'F' then '[10, 20, 35]'
              when b1 % 7 <> 0 then '[10.0, 20.0, 35.0]' end as explicit_bounds
  from (
    select l_returnflag as slice_id, l_linestatus as state, date_trunc('week', l_shipdate) as ts,
           count(*) filter (l_quantity <= 10) as b0,
           count(*) filter (l_quantity > 10 and l_quantity <= 20) as b1,
           count(*) filter (l_quantity > 20 and l_quantity <= 35) as b2,
           count(*) filter (l_quantity > 35) as b3
    from lineitem group by 1, 2, 3))"""


# Sum samples: order states as slices, priorities as series, weekly, in millions.

def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("slice_id"),
            F.col("o_orderpriority").alias("priority"),
            week("o_orderdate").alias("ts"),
        )
        .agg((F.sum("o_totalprice") / 1e6).alias("value"), F.min("o_orderkey").alias("first_key"))
    )


SUMS = """sums as (
  select o_orderstatus as slice_id, o_orderpriority as priority, date_trunc('week', o_orderdate) as ts,
         sum(o_totalprice) / 1e6 as v, min(o_orderkey) as first_key
  from orders group by 1, 2, 3)"""


# Spans: one tree over the events; hourly mean values as the metrics beside them.

def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 2).cast("bigint"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("span_id"),
        parent.alias("parent_span_id"),
        hour().alias("ts"),
        F.col("value").alias("duration"),
        F.col("event_type").alias("service"),
        F.lit("span").alias("kind"),
    )


SPANS = """spans as (
  select event_id as span_id,
         case when event_id > 0 then cast(floor((event_id - 1) / 2) as bigint) end as parent_span_id,
         date_trunc('hour', ts) as ts, "value" as duration, event_type as service, 'span' as kind
  from events)"""


def hourly_metrics(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """One metric per hour with an event, or with an event of one type."""
    events = table(spark, sf_dir, "events")
    return (
        (events if event_type is None else events.filter(F.col("event_type") == event_type))
        .groupBy(hour().alias("ts"))
        .agg(F.avg("value").alias("value"), F.count("*").alias("n"))
        .withColumn("kind", F.lit("metric"))
    )


METRICS = """metrics as (
  select date_trunc('hour', ts) as ts, avg("value") as v, count(*) as n, 'metric' as kind
  from events group by 1)"""
VIEW_METRICS = METRICS.replace("from events", "from events where event_type = 'view'")


# Anomaly log: half an hour after every error with a high value.

def anomaly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("event_id") % 3 == 0, "point").when(F.col("event_id") % 3 == 1, "s_long").otherwise("multiple")
    )
    return (
        table(spark, sf_dir, "events")
        .filter((F.col("event_type") == "error") & (F.col("value") > 200))
        .select(
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("interval 30 minutes")).alias("end_ts"),
            kind.alias("anomaly_type"),
            F.when(kind == "multiple", F.array(F.lit("adServiceFailure"), F.lit("imageSlowLoad")))
            .otherwise(F.array(F.lit("cartServiceFailure"))).alias("flags"),
            "event_id",
        )
    )


LOG = """log as (
  select ts as start_ts, ts + interval 30 minutes as end_ts,
         case when event_id % 3 = 0 then 'point' when event_id % 3 = 1 then 's_long' else 'multiple' end as anomaly_type,
         case when event_id % 3 = 2 then 'adServiceFailure,imageSlowLoad' else 'cartServiceFailure' end as flags,
         event_id
  from events where event_type = 'error' and "value" > 200)"""
