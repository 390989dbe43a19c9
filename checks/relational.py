r"""Queries for sources, projections, joins, aggregations, windows, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import moment, r, table, with_sql
from checks.registry import check
from driftgrid.functions import arrays, attrs, times
from driftgrid.operators import clean, impute, labels, merge, quality, scale, shape, split, traces
from driftgrid.session import fresh_path, store
from driftgrid.sources import readers, writers

# --- sources and sinks -------------------------------------------------------------------

_CSV = "slice_id string, series_id int, t string, value string, event_id bigint"
_CSV_SQL = with_sql(fx.GAUGE_TEXT) + """
  select slice_id, series_id, ts as t, case when v = '\\N' then null else v end as value, event_id from gauge_text"""


def _csv_ready(df: DataFrame) -> DataFrame:
    return df.select(
        "slice_id", "series_id", times.parse_ts(F.col("t")).alias("t"),
        clean.null_text(F.col("value")).alias("value"), "event_id",
    )


def _as_csv_lines(df: DataFrame) -> DataFrame:
    cells = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("slice_id", "series_id", "ts", "value", "event_id")]
    return df.withColumn("line", F.concat_ws(",", *cells))


@check("csv_scan_utf16", _CSV_SQL)
def csv_scan_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless UTF-16 export, written from the gauge samples and scanned with given names."""
    path = fresh_path(spark, "export")
    fx.gauge_text(spark, sf_dir).withColumn("ts", F.col("ts").cast("string")).write.option(
        "encoding", "UTF-16LE"
    ).option("lineSep", "\n").csv(path)
    return _csv_ready(readers.read_metrics_csv(spark, path, _CSV, encoding="UTF-16"))


@check("csv_scan_drop_last_line", _CSV_SQL)
def csv_scan_drop_last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that each end in a cut line; the files hold ten thousand ids each, so their number grows."""
    path = fresh_path(spark, "export")
    lines = _as_csv_lines(fx.gauge_text(spark, sf_dir)).select(
        F.floor(F.col("event_id") / 10_000).alias("part"), F.lit(0).alias("cut"), "line"
    )
    ends = lines.select("part", F.lit(1).alias("cut"), F.lit('"cli').alias("line")).distinct()
    (
        lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "cut")
        .select("part", "line").write.partitionBy("part").text(path)
    )
    rows = readers.read_metrics_csv(spark, f"{path}/*/", _CSV, drop_last_line=True)
    return _csv_ready(rows)


@check(
    "multi_file_scan",
    "select l_returnflag, l_linestatus, count(*) as n from (select l_returnflag, l_linestatus from lineitem "
    "where l_shipdate < timestamp '1998-01-01' union all select l_returnflag, l_linestatus from lineitem "
    "where l_shipdate >= timestamp '1998-01-01') group by 1, 2",
)
def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports read as one input."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate")
    paths = []
    for part in (F.col("l_shipdate") < moment("1998-01-01"), F.col("l_shipdate") >= moment("1998-01-01")):
        paths.append(fresh_path(spark, "export"))
        items.filter(part).write.csv(paths[-1])
    rows = readers.read_metrics_csv(spark, paths, "l_returnflag string, l_linestatus string, l_shipdate string")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@check(
    "load_spans_and_metrics",
    with_sql(fx.SPANS, fx.METRICS)
    + "select 'spans' as source, service as name, count(*) as n, round(sum(duration), 2) as total from spans group by service "
    "union all select 'metrics', 'view', count(*), round(sum(v), 2) from metrics",
)
def load_spans_and_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span and metric tables kept as Parquet and read back into the canonical layout."""
    span_path, metric_path = fresh_path(spark, "spans"), fresh_path(spark, "metrics")
    fx.spans(spark, sf_dir).write.parquet(span_path)
    fx.hourly_metrics(spark, sf_dir).write.parquet(metric_path)
    one = readers.load_spans(spark, span_path).groupBy(F.lit("spans").alias("source"), F.col("service").alias("name"))
    two = readers.load_metrics(spark, metric_path).groupBy(F.lit("metrics").alias("source"), F.lit("view").alias("name"))
    return one.agg(F.count("*").alias("n"), r(F.sum("duration"), 2).alias("total")).unionByName(
        two.agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))
    )


@check(
    "spans_from_dotted_columns",
    "select event_id as span_id, event_type as service, user_id as link_trace, date_trunc('hour', ts) as event_ts, props as event_attributes from events",
)
def spans_from_dotted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat span rows with dotted event and link columns to structs."""
    ev = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    flat = ev.select(
        F.col("ts").alias("Timestamp"), F.col("user_id").alias("TraceId"), F.col("event_id").alias("SpanId"),
        F.col("user_id").alias("ParentSpanId"), none.alias("TraceState"), none.alias("SpanName"), none.alias("SpanKind"),
        F.col("event_type").alias("ServiceName"), none.alias("ResourceAttributes"), none.alias("ScopeName"),
        none.alias("ScopeVersion"), none.alias("SpanAttributes"), F.col("value").alias("Duration"),
        none.alias("StatusCode"), none.alias("StatusMessage"), fx.hour().alias("Events.Timestamp"),
        none.alias("Events.Name"), F.col("props").alias("Events.Attributes"), F.col("user_id").alias("Links.TraceId"),
        F.col("event_id").alias("Links.SpanId"), none.alias("Links.TraceState"), none.alias("Links.Attributes"),
    )
    return readers.spans_from_flat(flat).select(
        "span_id", "service", F.col("links.trace_id").alias("link_trace"),
        F.col("events.ts").alias("event_ts"), F.col("events.attributes").alias("event_attributes"),
    )


@check(
    "anomaly_log_sink",
    with_sql(fx.LOG) + "select start_ts, end_ts, anomaly_type, flags from log",
)
def anomaly_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval log appended in two runs and read back."""
    path, log = fresh_path(spark, "anomaly-log"), fx.anomaly_log(spark, sf_dir)
    for part in (F.col("anomaly_type") == "multiple", F.col("anomaly_type") != "multiple"):
        writers.write_anomaly_log(log.filter(part), path)
    return writers.read_anomaly_log(spark, path).withColumn("flags", arrays.join_flags(F.col("flags")))


# --- projections, filters, predicates ----------------------------------------------------

@check(
    "prune_constant_columns",
    "select event_id, event_type || '-x' as kept_text, \"value\" as kept_value from events",
)
def prune_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant, an all-null and a constant-or-null column go; the others stay."""
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat("event_type", F.lit("-x")).alias("kept_text"),
        F.col("value").alias("kept_value"),
        F.lit("same").alias("constant"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("event_id") % 2 == 0, 7).alias("half"),
    )
    return clean.prune_constant_columns(df)


@check(
    "null_literal",
    with_sql(fx.GAUGE_TEXT) + "select event_id, slice_id, case when contains(v, '\\N') then null else v end as value from gauge_text",
)
def null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.gauge_text(spark, sf_dir).select("event_id", "slice_id", "value")
    return clean.null_literal(df)


@check(
    "coerce_value",
    """select event_id, "value" as value from events where event_id % 17 <> 0 and event_id % 19 <> 0""",
)
def coerce_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.coerce_value(fx.raw_gauge(spark, sf_dir).select("event_id", F.col("Value").alias("value")))


@check("parse_ts", "select event_id, ts, case when event_id % 2 = 0 then ts end as maybe from events")
def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time text with nanoseconds, and bad text."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789"))
    return table(spark, sf_dir, "events").select(
        "event_id", times.parse_ts(text).alias("ts"),
        times.parse_ts(F.when(F.col("event_id") % 2 == 0, text).otherwise(F.lit("soon"))).alias("maybe"),
    )


_CANON = """'{"container.id":"c' || user_id || '","host.name":"h' || (user_id % 3) || '","os.type":"linux","service.name":"' || event_type || '","zone":null}'"""
_KEY = """'{"host.name":"h' || (user_id % 3) || '","os.type":"linux","service.name":"' || event_type || '"}'"""


@check(
    "slice_by_resource",
    f"select slice_id, count(*) as n, min(event_id) as first_event from (select case when event_id % 97 = 0 then 'unparsed ' || event_type else {_KEY} end as slice_id, event_id from events) group by 1",
)
def slice_by_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by their filtered resource attributes; text that does not parse is its own key."""
    raw = fx.raw_gauge(spark, sf_dir).select("event_id", attrs.resource_key(F.col("ResourceAttributes")).alias("resource"))
    return shape.with_slice(raw, "resource").groupBy("slice_id").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_event")
    )


@check(
    "filter_attrs",
    "select event_id, event_type as service, 'h' || user_id as host, cast(2 as bigint) as kept from events",
)
def filter_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backslashes around keys and values are stripped before the keys are matched."""
    ev = table(spark, sf_dir, "events")
    m = F.create_map(
        F.lit("\\service.name\\"), F.concat(F.lit("\\"), F.col("event_type"), F.lit("\\\\")),
        F.lit("host.name"), F.concat(F.lit("h"), F.col("user_id").cast("string")),
        F.lit("container.id"), F.lit("x"),
    )
    kept = attrs.filter_attrs(m)
    return ev.select("event_id", kept["service.name"].alias("service"), kept["host.name"].alias("host"), F.size(kept).cast("bigint").alias("kept"))


@check(
    "canonical_attrs",
    f"select event_id, case when event_id % 97 = 0 then 'unparsed ' || event_type else {_CANON} end as attrs from events",
)
def canonical_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_gauge(spark, sf_dir).select("event_id", attrs.canonical_attrs(F.col("ResourceAttributes")).alias("attrs"))


@check(
    "min_length",
    with_sql(fx.SUMS) + """
    select s.slice_id, s.priority, s.ts, round(v, 4) as value from (select *, slice_id || '-' || case
      when ts < timestamp '1995-12-01' then 'short' else 'long' end as part from sums) s
    where part in (select part from (select slice_id || '-' || case when ts < timestamp '1995-12-01' then 'short' else 'long' end as part, ts from sums)
                   group by part having count(distinct ts) >= 50)""",
)
def min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices shorter than fifty times are left out."""
    df = fx.sums(spark, sf_dir)
    part = F.when(F.col("ts") < moment("1995-12-01"), "short").otherwise("long")
    keyed = df.withColumn("base", F.col("slice_id")).withColumn("slice_id", F.concat_ws("-", "slice_id", part))
    kept = shape.min_length(keyed.withColumn("series_id", F.col("priority")), 50)
    return kept.select(F.col("base").alias("slice_id"), "priority", "ts", r("value", 4).alias("value"))


@check(
    "split_range_right_closed",
    "select event_id, ts from events where ts > timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-20 12:00:00'",
)
def split_range_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts")
    return split.split_range(df, moment("2024-01-05"), moment("2024-01-20 12:00:00"))


@check(
    "split_range_both_closed",
    "select l_orderkey, l_linenumber, l_shipdate as ts from lineitem where l_shipdate between timestamp '1996-01-02' and timestamp '1998-03-04'",
)
def split_range_both_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"))
    return split.split_range(df, moment("1996-01-02"), moment("1998-03-04"), closed="both")


@check(
    "split_ratio",
    with_sql(*fx.TO_DENSE) + """
    select slice_id, ts, series_id, case when pos < floor((max(pos) over (partition by slice_id) + 1) * 0.8::double)
           then 'train' else 'test' end as split from dense""",
)
def split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = shape.densify(shape.to_grid(fx.gauge(spark, sf_dir)))
    return split.split_ratio(dense).select("slice_id", "ts", "series_id", "split")


_HASHED = """case when ((event_id * 7919 + 42) % 10007) / 10007.0::double < 0.7::double then 'train'
  when ((event_id * 7919 + 42) % 10007) / 10007.0::double < 0.7::double + 0.15::double then 'validation' else 'test' end"""


@check("split_hashed", f"select event_id, {_HASHED} as split from events")
def split_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_hashed(table(spark, sf_dir, "events").select("event_id"), "event_id")


def _wide(expr: str, small: str) -> str:
    return f"select {expr} as key, {_HASHED.replace('event_id', small)} as split from events"


@check("split_hashed_wide_ids", _wide("event_id + 9000000000000000000", "((event_id + 9000000000000000000) % 10007)"))
def split_hashed_wide_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys near the end of 64 bits."""
    keys = table(spark, sf_dir, "events").select((F.col("event_id") + 9000000000000000000).alias("key"))
    return split.split_hashed(keys, "key")


@check("split_hashed_text_ids", _wide("md5(event_id::varchar)", "(('0x' || substr(md5(md5(event_id::varchar)), 1, 15))::bigint % 10007)"))
def split_hashed_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal text keys."""
    keys = table(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("key"))
    return split.split_hashed(keys, "key")


@check("split_random", "select event_id, true as near_share from events")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own sampler: three parts that together hold every row once, each near its share."""
    weights = {"train": 0.7, "validation": 0.15, "test": 0.15}
    parts = split.split_random(table(spark, sf_dir, "events").select("event_id"), tuple(weights.values()))
    tagged = [p.withColumn("split", F.lit(n)) for p, n in zip(parts, weights)]
    whole = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy())
    wanted = F.coalesce(*(F.when(F.col("split") == n, w) for n, w in weights.items()))
    near = whole.groupBy("split").agg((F.abs(share - F.first(wanted)) < 0.05).alias("near_share"))
    return whole.join(F.broadcast(near), "split").select("event_id", "near_share")


_TAGGED = """tagged as (
  select slice_id, ts, 'train' as split from sums where ts > timestamp '1995-06-01' and ts <= timestamp '1997-01-01'
  union all
  select slice_id, ts, 'test' from sums where ts > timestamp '1998-01-01' and ts <= timestamp '1999-01-01' and slice_id <> 'P')"""


@check(
    "drop_empty_slices",
    with_sql(fx.SUMS, _TAGGED) + """select slice_id, split, count(*) as n from tagged
    where slice_id in (select slice_id from tagged where split = 'train') and slice_id in (select slice_id from tagged where split = 'test')
    group by slice_id, split""",
)
def drop_empty_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sums(spark, sf_dir)
    tagged = split.tag_ranges(
        df, (moment("1995-06-01"), moment("1997-01-01")), (moment("1998-01-01"), moment("1999-01-01"))
    ).filter((F.col("split") == "train") | (F.col("slice_id") != "P"))
    return split.drop_empty(tagged).groupBy("slice_id", "split").agg(F.count("*").alias("n"))


@check(
    "only_slices",
    with_sql(fx.SUMS) + "select slice_id, priority, ts, round(v, 4) as value from sums where slice_id in ('F', 'O')",
)
def only_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sums(spark, sf_dir).select("slice_id", "priority", "ts", r("value", 4).alias("value"))
    return split.only_slices(df, ["F", "O", "missing"])


@check(
    "align_to_model",
    with_sql(fx.GAUGE, fx.GRID) + """select slice_id, ts, series_id, round(v, 6) as value from grid
    where (slice_id, series_id) in (select (slice_id, series_id) from grid where ts < timestamp '2024-01-01 12:00:00')""",
)
def align_to_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series seen in the first twelve hours are the model's."""
    grid = shape.to_grid(fx.gauge(spark, sf_dir))
    model = scale.fit_standard(grid.filter(F.col("ts") < moment("2024-01-01 12:00:00")))
    return split.align_to_model(grid, model).withColumn("value", r("value"))


@check("numeric_columns", "select c_custkey, c_nationkey, c_acctbal from customer")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.select_numeric(table(spark, sf_dir, "customer"))


@check(
    "span_features",
    with_sql(fx.SPANS) + "select span_id, duration as span_duration, cast(span_id as double) as metric_value from spans",
)
def span_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.spans(spark, sf_dir).withColumn("value", F.col("span_id").cast("double"))
    return traces.span_features(df).select("span_id", "span_duration", "metric_value")


@check(
    "first_series",
    with_sql(fx.GAUGE, fx.GRID) + """select slice_id, ts, series_id, round(v, 6) as value from grid g
    where series_id = (select min(series_id) from grid h where h.slice_id = g.slice_id)""",
)
def first_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.first_series(shape.to_grid(fx.gauge(spark, sf_dir))).withColumn("value", r("value"))


@check(
    "row_position",
    "select event_type as slice_id, ts, event_id, row_number() over (partition by event_type order by ts) - 1 as pos from events",
)
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("slice_id"), "ts", "event_id")
    return shape.with_position(df)


@check(
    "over_threshold",
    'select event_id, "value" as loss from events where "value" > 50',
)
def over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.pca import over_threshold as over

    return over(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("loss")), 50)


@check(
    "require_columns",
    """select event_id, event_type as slice_id, user_id, case when event_type <> 'view' then props end as props
    from events where event_type <> 'view'""",
)
def require_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice whose identity column is null throughout is skipped."""
    df = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("slice_id"), "user_id",
        F.when(F.col("event_type") != "view", F.col("props")).alias("props"),
    )
    return clean.require_columns(df, ["user_id", "props"])


# --- joins -------------------------------------------------------------------------------

_MERGE_COLS = "o_orderpriority, o_orderstatus, case when o_custkey % 3 > 0 then o_custkey % 11 end as bucket"


def _merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "orders")
    cols = [
        "o_orderpriority", "o_orderstatus",
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 11).alias("bucket"),
    ]
    early = F.col("o_orderdate") < moment("1998-01-01")
    return df.filter(early).select(*cols), df.filter(~early).select(*cols)


@check(
    "merge_all_columns",
    f"""with a as (select {_MERGE_COLS}, count(*) as m from orders where o_orderdate < timestamp '1998-01-01' group by all),
    b as (select {_MERGE_COLS}, count(*) as n from orders where o_orderdate >= timestamp '1998-01-01' group by all)
    select coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority,
           coalesce(a.o_orderstatus, b.o_orderstatus) as o_orderstatus,
           coalesce(a.bucket, b.bucket) as bucket,
           cast(coalesce(m, 1) * coalesce(n, 1) as bigint) as copies
    from a full join b on a.o_orderpriority is not distinct from b.o_orderpriority
      and a.o_orderstatus is not distinct from b.o_orderstatus and a.bucket is not distinct from b.bucket""",
)
def merge_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls match, copies multiply; a merged row is kept once with its number of copies."""
    return merge.merge_all(*_merge_sides(spark, sf_dir))


@check(
    "merge_expanded",
    """select c_custkey, c_nationkey, c_mktsegment from customer where c_nationkey < 15
    union select c_custkey, c_nationkey, c_mktsegment from customer where c_nationkey > 10""",
)
def merge_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping exports without copies of their own merge to their union."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return merge.expand_copies(
        readers.merge_files(df.filter("c_nationkey < 15"), df.filter("c_nationkey > 10"))
    )


@check(
    "join_telemetry",
    with_sql(fx.SPANS, fx.METRICS) + """select span_id, ts, duration, spans.kind as kind_x, metrics.kind as kind_y,
    round(v, 6) as value, n from spans left join metrics using (ts)""",
)
def join_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = traces.join_telemetry(fx.spans(spark, sf_dir), fx.hourly_metrics(spark, sf_dir))
    return joined.select("span_id", "ts", "duration", "kind_x", "kind_y", r("value").alias("value"), "n")


_PAIRS = [("1-URGENT", "wrong"), ("1-URGENT", "5-LOW"), ("2-HIGH", "2-HIGH"), ("3-MEDIUM", "absent")]


@check(
    "map_slices",
    """with mapping(a, b) as (values ('1-URGENT', '5-LOW'), ('2-HIGH', '2-HIGH')),
    train as (select o_orderpriority as p, o_orderkey, o_totalprice from orders where o_orderdate < timestamp '1998-01-01'),
    test as (select o_orderpriority as p, o_orderkey, o_orderstatus from orders where o_orderdate >= timestamp '1998-01-01')
    select a || '_' || b as slice_id, o_orderkey, o_totalprice, null as o_orderstatus from train join mapping on p = a
    union all select a || '_' || b, o_orderkey, null, o_orderstatus from test join mapping on p = b""",
)
def map_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated train slice the last pair counts; a pair without rows on one side is left out."""
    df = table(spark, sf_dir, "orders").withColumn("slice_id", F.col("o_orderpriority"))
    early = F.col("o_orderdate") < moment("1998-01-01")
    return merge.map_slices(
        df.filter(early).select("slice_id", "o_orderkey", "o_totalprice"),
        df.filter(~early).select("slice_id", "o_orderkey", "o_orderstatus"),
        merge.mapping_table(df, _PAIRS),
    )


@check(
    "unmatched_slices",
    "select distinct o_orderpriority as slice_id from orders where o_orderpriority not in (select distinct o_orderpriority from orders where o_orderpriority < '3')",
)
def unmatched_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that have no model."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("slice_id"))
    return split.unmatched_slices(df, df.filter(F.col("slice_id") < "3"))


@check(
    "describe_series",
    """select o_orderkey as ts, o_orderstatus as slice_id, o_custkey % 7 as series_id,
    case when o_custkey % 7 < 5 then 'series ' || (o_custkey % 7) else 'N/A' end as label_value from orders""",
)
def describe_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a series, N/A where the dictionary does not have it."""
    from driftgrid.operators.pca import describe_series as describe

    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("slice_id"), (F.col("o_custkey") % 7).alias("series_id")
    )
    dictionary = (
        df.select("slice_id", "series_id").distinct().filter("series_id < 5")
        .withColumn("label", F.concat(F.lit("series "), F.col("series_id")))
    )
    return describe(df, dictionary, ["label"])


@check(
    "span_chains",
    f"""with recursive {fx.SPANS},
    chain as (select span_id, span_id as ancestor_id, 0 as depth, parent_span_id from spans
      union all select chain.span_id, p.span_id, depth + 1, p.parent_span_id from chain join spans p on p.span_id = chain.parent_span_id)
    select span_id, ancestor_id, depth from chain""",
)
def span_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span with all its ancestors."""
    return traces.span_chains(fx.spans(spark, sf_dir))


@check(
    "chain_rows",
    with_sql(fx.SPANS) + "select distinct span_id, duration, service from spans",
)
def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all chains without duplicates: the input rows again."""
    df = fx.spans(spark, sf_dir)
    return traces.chain_rows(df, traces.span_chains(df)).select("span_id", "duration", "service")


@check(
    "densify",
    with_sql(*fx.TO_DENSE) + "select slice_id, ts, series_id, round(v, 6) as value, pos from dense",
)
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = shape.densify(shape.to_grid(fx.gauge(spark, sf_dir)))
    return dense.select("slice_id", "ts", "series_id", r("value").alias("value"), "pos")


@check(
    "label_intervals",
    with_sql(fx.LOG) + """select e.event_id, exists (select 1 from log where e.ts between start_ts and end_ts) as is_anomaly from events e""",
)
def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_id", "ts")
    return labels.label_intervals(samples, fx.anomaly_log(spark, sf_dir)).select("event_id", "is_anomaly")


# --- aggregations ------------------------------------------------------------------------

_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@check(
    "profile_distinct",
    " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct from orders" for c in _ORDER_COLS),
)
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile_distinct(table(spark, sf_dir, "orders"))


@check(
    "profile_table",
    " union all ".join(
        f"""select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
        round(min({c}), 4) as min, round(quantile_cont({c}::double, 0.25), 4) as q25, round(quantile_cont({c}::double, 0.5), 4) as q50,
        round(quantile_cont({c}::double, 0.75), 4) as q75, round(max({c}), 4) as max from lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, deviation and exact quartiles of the numeric columns."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = quality.profile(table(spark, sf_dir, "lineitem"), cols)
    return out.select("column_name", "n", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@check(
    "grid_mean",
    with_sql(fx.GAUGE, fx.GRID) + "select slice_id, ts, series_id, round(v, 6) as value from grid",
)
def grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with null text to the mean per slice, time and series."""
    samples = clean.coerce_value(clean.null_literal(fx.gauge_text(spark, sf_dir), ["value"]))
    return shape.to_grid(samples).withColumn("value", r("value"))


@check(
    "grid_wide",
    with_sql(fx.GAUGE, fx.GRID) + """select slice_id, ts, round(max(v) filter (series_id = 0), 6) as s0, round(max(v) filter (series_id = 1), 6) as s1,
    round(max(v) filter (series_id = 2), 6) as s2, round(max(v) filter (series_id = 3), 6) as s3 from grid group by 1, 2""",
)
def grid_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = shape.widen(shape.to_grid(fx.gauge(spark, sf_dir)), [0, 1, 2, 3])
    return wide.select("slice_id", "ts", *[r(f"`{i}`").alias(f"s{i}") for i in range(4)])


@check(
    "bucket_grid",
    with_sql(fx.HISTOGRAM) + "select slice_id, ts, series_id, min(bucket_counts) as bucket_counts from histogram where bucket_counts is not null group by 1, 2, 3",
)
def bucket_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.to_bucket_grid(fx.histogram(spark, sf_dir))


@check(
    "null_counts",
    with_sql(*fx.TO_DENSE) + "select slice_id, series_id, count(*) filter (v is null) as null_cells from dense group by 1, 2",
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(shape.densify(shape.to_grid(fx.gauge(spark, sf_dir))))


@check(
    "null_pct",
    with_sql(fx.HISTOGRAM) + "select slice_id, round(avg(case when bucket_counts is null then 1.0::double else 0 end) * 100, 6) as null_pct from histogram group by 1",
)
def null_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_pct(fx.histogram(spark, sf_dir), "bucket_counts").withColumn("null_pct", r("null_pct"))


@check(
    "bounds_count",
    with_sql(fx.HISTOGRAM) + "select slice_id, count(distinct explicit_bounds) as n_bounds from histogram group by 1",
)
def bounds_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bounds_count(fx.histogram(spark, sf_dir))


@check(
    "split_by_bounds",
    with_sql(fx.HISTOGRAM) + """select case when n > 1 then slice_id || '_' || explicit_bounds else slice_id end as slice_id, ts, series_id, b0
    from (select *, (select count(distinct explicit_bounds) from histogram g where g.slice_id = h.slice_id) as n from histogram h)
    where n <= 1 or explicit_bounds is not null""",
)
def split_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.split_by_bounds(fx.histogram(spark, sf_dir)).select("slice_id", "ts", "series_id", "b0")


@check(
    "prune_one_sided",
    with_sql(fx.GAUGE, """grid as (select slice_id, ts, series_id, v from gauge
      where not (series_id = 1 and ts < timestamp '2024-01-10') and not (series_id = 2 and slice_id = 'view' and ts >= timestamp '2024-01-10'))""")
    + """select slice_id, ts, series_id, count(v) as n from grid
    where (slice_id, series_id) in (select (slice_id, series_id) from grid group by slice_id, series_id
      having count(v) filter (ts < timestamp '2024-01-10') > 0 and count(v) filter (ts >= timestamp '2024-01-10') > 0)
    group by 1, 2, 3""",
)
def prune_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = moment("2024-01-10")
    df = fx.gauge(spark, sf_dir).filter(
        ~((F.col("series_id") == 1) & (F.col("ts") < cut))
        & ~((F.col("series_id") == 2) & (F.col("slice_id") == "view") & (F.col("ts") >= cut))
    )
    return quality.prune_one_sided(df, cut).groupBy("slice_id", "ts", "series_id").agg(F.count("value").alias("n"))


@check(
    "fit_standard",
    with_sql(fx.GAUGE, fx.GRID) + """select slice_id, series_id, round(avg(v), 6) as center,
    round(coalesce(nullif(stddev_pop(v), 0), 1), 6) as scale from grid group by 1, 2""",
)
def fit_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scale.fit_standard(shape.to_grid(fx.gauge(spark, sf_dir)))
    return model.select("slice_id", "series_id", r("center").alias("center"), r("scale").alias("scale"))


@check(
    "fit_minmax",
    with_sql(fx.GAUGE, fx.GRID) + """select slice_id, series_id, round(min(v), 6) as center,
    round(coalesce(nullif(max(v) - min(v), 0), 1), 6) as scale from grid group by 1, 2""",
)
def fit_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scale.fit_minmax(shape.to_grid(fx.gauge(spark, sf_dir)))
    return model.select("slice_id", "series_id", r("center").alias("center"), r("scale").alias("scale"))


@check(
    "apply_standard",
    with_sql(*fx.TO_SCALED) + "select slice_id, ts, series_id, round(v, 6) as value from scaled",
)
def apply_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imputed grid, standardised per series."""
    grid = store(impute.impute(shape.to_grid(fx.gauge(spark, sf_dir))))
    return scale.apply_scaler(grid, scale.fit_standard(grid)).select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "apply_minmax",
    with_sql(*fx.TO_IMPUTED) + """select slice_id, ts, series_id, round((v - min(v) over w) / coalesce(nullif(max(v) over w - min(v) over w, 0), 1), 6) as value
    from imputed window w as (partition by slice_id, series_id)""",
)
def apply_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = store(impute.impute(shape.to_grid(fx.gauge(spark, sf_dir))))
    return scale.apply_scaler(grid, scale.fit_minmax(grid)).select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "sigma_threshold",
    """with loss as (select event_type as slice_id, case when ts < timestamp '2024-01-10' then 'train' else 'test' end as split, event_id, "value" as loss from events)
    select slice_id, split, event_id, round(avg(loss) over w + 3 * stddev_pop(loss) over w, 6) as threshold,
           loss > avg(loss) over w + 3 * stddev_pop(loss) over w as is_anomaly from loss window w as (partition by slice_id, split)""",
)
def sigma_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.thresholds import sigma_threshold as sigma

    loss = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slice_id"),
        F.when(F.col("ts") < moment("2024-01-10"), "train").otherwise("test").alias("split"),
        "event_id", F.col("value").alias("loss"),
    )
    return sigma(loss).select("slice_id", "split", "event_id", r("threshold").alias("threshold"), "is_anomaly")


@check(
    "sigma_threshold_from_train",
    """with loss as (select event_type as slice_id, case when ts < timestamp '2024-01-10' then 'train' else 'test' end as split, event_id, "value" as loss from events),
    limits as (select slice_id, avg(loss) + 3 * stddev_pop(loss) as threshold from loss where split = 'train' group by 1)
    select slice_id, split, event_id, round(threshold, 6) as threshold, loss > threshold as is_anomaly from loss join limits using (slice_id)""",
)
def sigma_threshold_from_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.thresholds import sigma_threshold as sigma

    loss = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slice_id"),
        F.when(F.col("ts") < moment("2024-01-10"), "train").otherwise("test").alias("split"),
        "event_id", F.col("value").alias("loss"),
    )
    return sigma(loss, threshold_from="train").select("slice_id", "split", "event_id", r("threshold").alias("threshold"), "is_anomaly")


@check(
    "quantile_threshold",
    'select event_type as slice_id, round(quantile_cont("value", 0.1), 6) as threshold from events group by 1',
)
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.thresholds import quantile_threshold as quantile

    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("slice_id"), F.col("value").alias("score"))
    return quantile(df, 0.1, keys=["slice_id"]).withColumn("threshold", r("threshold"))


@check("longest_array", "select o_orderstatus as slice_id, cast(max(o_custkey % 6) as int) as max_len from orders group by 1")
def longest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("slice_id"), F.array_repeat(F.lit(1.0), (F.col("o_custkey") % 6).cast("int")).alias("arr")
    )
    return shape.max_len(df, "arr")


@check("slice_summary", "select event_type as slice_id, count(*) as n_rows from events group by 1")
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.slice_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("slice_id")))


# --- windows -----------------------------------------------------------------------------

_IDENTITY = "'scope' || (user_id % 2) as ScopeName, case when user_id % 5 <> 0 then 'v' || (user_id % 3) end as ScopeVersion, 'metric' || (user_id % 7) as MetricName"


@check(
    "series_by_value",
    f"""with raw as (select event_id, event_type as slice_id, {_IDENTITY} from events)
    select event_id, slice_id, cast(dense_rank() over (partition by slice_id order by ScopeName nulls first, ScopeVersion nulls first, MetricName nulls first) - 1 as int) as series_id from raw""",
)
def series_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series numbers in the order of their identity tuples, which may hold nulls."""
    df = fx.raw_gauge(spark, sf_dir).withColumn("slice_id", F.col("event_type"))
    return shape.assign_series(df, ["ScopeName", "ScopeVersion", "MetricName"]).select("event_id", "slice_id", "series_id")


@check(
    "series_by_first_seen",
    f"""with raw as (select event_id, ts, event_type as slice_id, {_IDENTITY} from events),
    firsts as (select slice_id, ScopeName, ScopeVersion, MetricName, min((ts, event_id)) as seen from raw group by all),
    ranked as (select *, row_number() over (partition by slice_id order by seen) - 1 as series_id from firsts)
    select event_id, raw.slice_id, cast(series_id as int) as series_id from raw join ranked on raw.slice_id = ranked.slice_id and raw.ScopeName = ranked.ScopeName
      and raw.ScopeVersion is not distinct from ranked.ScopeVersion and raw.MetricName = ranked.MetricName""",
)
def series_by_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.raw_gauge(spark, sf_dir).withColumn("slice_id", F.col("event_type")).withColumn("ts", times.parse_ts(F.col("TimeUnix")))
    return shape.assign_series(df, ["ScopeName", "ScopeVersion", "MetricName"], "first_seen", ["ts", "event_id"]).select(
        "event_id", "slice_id", "series_id"
    )


@check(
    "series_dictionary",
    f"""with raw as (select distinct event_type as slice_id, {_IDENTITY} from events)
    select slice_id, ScopeName as ScopeName_value, ScopeVersion as ScopeVersion_value, MetricName as MetricName_value,
    cast(row_number() over (partition by slice_id order by ScopeName, ScopeVersion nulls first, MetricName) - 1 as int) as series_id from raw""",
)
def series_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.raw_gauge(spark, sf_dir).withColumn("slice_id", F.col("event_type"))
    return shape.dictionary_values(shape.series_dictionary(df, ["ScopeName", "ScopeVersion", "MetricName"]))


@check(
    "impute_rolling_mean",
    with_sql(*fx.TO_DENSE, fx.SMA) + "select slice_id, ts, series_id, round(v, 6) as value from sma",
)
def impute_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = shape.densify(shape.to_grid(fx.gauge(spark, sf_dir)), chunk_rows=64)
    return impute.impute_sma(dense, 3, chunk_rows=64).select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "forward_fill",
    with_sql(*fx.TO_DENSE, fx.SMA, fx.FFILL) + "select slice_id, ts, series_id, round(v, 6) as value from ff",
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = shape.densify(shape.to_grid(fx.gauge(spark, sf_dir)), chunk_rows=64)
    filled = impute.ffill(impute.impute_sma(dense, 3, chunk_rows=64))
    return filled.select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "backward_fill",
    with_sql(*fx.TO_IMPUTED) + "select slice_id, ts, series_id, round(v, 6) as value from imputed",
)
def backward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = shape.densify(shape.to_grid(fx.gauge(spark, sf_dir)), chunk_rows=64)
    filled = impute.bfill(impute.ffill(impute.impute_sma(dense, 3, chunk_rows=64)))
    return filled.select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "impute_grid",
    with_sql(*fx.TO_IMPUTED) + "select slice_id, ts, series_id, round(v, 6) as value from imputed",
)
def impute_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three fills in one layout, with chunks small enough to have many borders."""
    filled = impute.impute(shape.to_grid(fx.gauge(spark, sf_dir)), chunk_rows=64)
    return filled.select("slice_id", "ts", "series_id", r("value").alias("value"))


@check(
    "sliding_windows",
    with_sql(*fx.TO_IMPUTED, """base as (select slice_id, ts, v, pos, case when pos < floor((max(pos) over (partition by slice_id) + 1) * 0.8::double) then 'train' else 'test' end as split
      from imputed i where series_id = (select min(series_id) from imputed j where j.slice_id = i.slice_id))""")
    + """select slice_id, split, ts, round(v, 6) as y, round(first_v, 6) as x_first, round(last_v, 6) as x_last, round(total, 6) as x_sum from (
      select slice_id, split, ts, v, lag(v, 50) over w as first_v, lag(v, 1) over w as last_v,
             sum(v) over (partition by slice_id, split order by ts rows between 50 preceding and 1 preceding) as total,
             row_number() over w as place from base window w as (partition by slice_id, split order by ts)) where place > 50""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty over the first series; chunks of 64 rows, so most windows cross a border."""
    from driftgrid.operators.windows import sliding_windows as slide

    means = store(shape.to_grid(fx.gauge(spark, sf_dir)))
    grid = store(impute.impute(means, only=shape.lowest_series(means)))
    found = slide(split.split_ratio(grid, chunk_rows=64), 50, chunk_rows=64)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "slice_id", "split", "ts", r("y").alias("y"), r(F.col("x")[0]).alias("x_first"),
        r(F.element_at("x", -1)).alias("x_last"), r(total).alias("x_sum"),
    )


@check(
    "top_k_series",
    with_sql(*fx.TO_SCALED) + """select slice_id, ts, series_id, round(v * v, 6) as sq_error, cast(rank as int) as rank from (
      select *, row_number() over (partition by slice_id, ts order by v * v desc, series_id) as rank from scaled) where rank <= 2""",
)
def top_k_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.pca import sq_error, top_k

    grid = store(impute.impute(shape.to_grid(fx.gauge(spark, sf_dir))))
    scaled = scale.apply_scaler(grid, scale.fit_standard(grid))
    contrib = scaled.select("slice_id", "ts", "series_id", sq_error(F.col("value")).alias("sq_error"))
    return top_k(contrib, 2).withColumn("sq_error", r("sq_error"))


# --- sorts, limits, sets -----------------------------------------------------------------

@check(
    "time_order",
    with_sql(fx.GAUGE, fx.GRID) + "select slice_id, ts, series_id, round(v, 6) as value from grid order by slice_id, ts, series_id",
)
def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = shape.to_grid(fx.gauge(spark, sf_dir)).withColumn("value", r("value"))
    return grid.orderBy("slice_id", "ts", "series_id")


@check("distinct_on", "select distinct o_orderstatus, o_orderpriority from orders")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.distinct_on(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@check(
    "first_rows",
    """select o_custkey, o_orderstatus, o_orderkey, o_totalprice from (
      select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as n from orders) where n = 1""",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.first_rows(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@check("dedup_rows", "select distinct l_orderkey, l_linenumber, l_returnflag from lineitem")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@check(
    "concat_rows",
    """select c_custkey as key, c_name as name, c_mktsegment as segment, null as balance from customer
    union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return merge.concat(a, b)


@check(
    "common_slices",
    """select cast(o_custkey as varchar) as slice_id from orders where o_orderdate < timestamp '1996-01-01'
    intersect select cast(o_custkey as varchar) from orders where o_orderdate >= timestamp '1999-01-01'""",
)
def common_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("slice_id", F.col("o_custkey").cast("string"))
    return split.common_slices(
        df.filter(F.col("o_orderdate") < moment("1996-01-01")), df.filter(F.col("o_orderdate") >= moment("1999-01-01"))
    )


# --- scalar functions --------------------------------------------------------------------

@check(
    "parse_attrs",
    """select event_id, case when event_id % 97 <> 0 then event_type end as service,
    case when event_id % 97 <> 0 then 'h' || (user_id % 3) end as host, case when event_id % 97 <> 0 then cast(5 as int) end as entries from events""",
)
def parse_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = attrs.parse_attrs(F.col("ResourceAttributes"))
    return fx.raw_gauge(spark, sf_dir).select(
        "event_id", m["service.name"].alias("service"), m["host.name"].alias("host"),
        F.when(m.isNotNull(), F.size(m)).alias("entries"),
    )


@check(
    "parse_array",
    with_sql(fx.HISTOGRAM) + """select slice_id, ts, series_id, cast(b0 as double) as first, cast(b0 + b1 + b2 + b3 as double) as total
    from histogram where bucket_counts is not null""",
)
def parse_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.histogram(spark, sf_dir).filter(F.col("bucket_counts").isNotNull())
    arr = arrays.parse_array(F.col("bucket_counts"))
    return df.select("slice_id", "ts", "series_id", arr[0].alias("first"), F.aggregate(arr, F.lit(0.0), lambda a, v: a + v).alias("total"))


@check("strip_backslash", "select event_id, event_type || '\\' || user_id as text from events")
def strip_backslash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backslashes at the ends go, those inside stay."""
    inner = F.concat(F.col("event_type"), F.lit("\\"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", attrs.strip_backslash(F.concat(F.lit("\\\\"), inner, F.lit("\\"))).alias("text")
    )


@check(
    "sort_attrs",
    "select c_custkey, 'a,b,c' as keys, c_mktsegment || ',' || c_name || ',' || c_nationkey as vals from customer",
)
def sort_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(
        F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_name")
    )
    ordered = attrs.sort_attrs(m)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(F.map_keys(ordered), ",").alias("keys"), F.array_join(F.map_values(ordered), ",").alias("vals")
    )


@check(
    "slice_key",
    f"select event_id, {_KEY} as key, sha256({_KEY}) as short from events where event_id % 97 <> 0",
)
def slice_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as a text key, and its fixed-length stand-in."""
    key = attrs.slice_key(attrs.filter_attrs(attrs.parse_attrs(F.col("ResourceAttributes"))))
    raw = fx.raw_gauge(spark, sf_dir).select("event_id", key.alias("key")).filter(F.col("key").isNotNull())
    return raw.withColumn("short", attrs.short_key(F.col("key")))


@check("join_key", "select o_orderkey, o_orderstatus || '_' || o_orderpriority as key from orders")
def join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", attrs.join_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


@check(
    "pad_array",
    """select o_orderkey, case when o_custkey % 6 = 0 then '' else repeat('1.0,', cast(o_custkey % 6 - 1 as int)) || '1.0' end
      || case when o_custkey % 6 < 4 then case when o_custkey % 6 = 0 then '' else ',' end || repeat('0.0,', cast(3 - o_custkey % 6 as int)) || '0.0' else '' end as arr from orders""",
)
def pad_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = F.array_repeat(F.lit(1.0), (F.col("o_custkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(arrays.pad_array(arr, 4), ",").alias("arr"))


@check(
    "explode_positions",
    with_sql(fx.HISTOGRAM) + " union all ".join(
        f"select slice_id, ts, series_id, {i} as pos, cast(b{i} as double) as value from histogram where bucket_counts is not null" for i in range(4)
    ),
)
def explode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.histogram(spark, sf_dir).select("slice_id", "ts", "series_id", arrays.parse_array(F.col("bucket_counts")).alias("arr"))
    return arrays.explode_positions(df, "arr")


@check(
    "collect_positions",
    with_sql(fx.HISTOGRAM) + """select slice_id, ts, series_id, b0 || '.0,' || b1 || '.0,' || b2 || '.0,' || b3 || '.0' as arr
    from histogram where bucket_counts is not null""",
)
def collect_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["slice_id", "ts", "series_id"]
    df = fx.histogram(spark, sf_dir).select(*keys, arrays.parse_array(F.col("bucket_counts")).alias("arr"))
    back = arrays.collect_positions(arrays.explode_positions(df, "arr"), keys)
    return back.withColumn("arr", F.array_join("arr", ","))


@check(
    "flatten_cells",
    with_sql(fx.HISTOGRAM) + """select slice_id, ts, string_agg(b0 || '.0,' || b1 || '.0,' || b2 || '.0,' || b3 || '.0', ',' order by series_id) as flat
    from histogram where bucket_counts is not null group by 1, 2""",
)
def flatten_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.histogram(spark, sf_dir).filter(F.col("bucket_counts").isNotNull()).withColumn("arr", arrays.parse_array(F.col("bucket_counts")))
    return arrays.flatten_cells(df, ["slice_id", "ts"], "series_id", "arr").withColumn("flat", F.array_join("flat", ","))


@check(
    "scale_arrays",
    with_sql(fx.HISTOGRAM) + "select slice_id, ts, series_id, " + ", ".join(
        f"round((b{i} - avg(b{i}) over w) / coalesce(nullif(stddev_pop(b{i}) over w, 0), 1), 6) as s{i}" for i in range(4)
    ) + " from histogram where bucket_counts is not null window w as (partition by slice_id)",
)
def scale_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.histogram(spark, sf_dir).select(
        "slice_id", "ts", "series_id", F.coalesce(arrays.parse_array(F.col("bucket_counts")), F.array().cast("array<double>")).alias("arr")
    )
    scaled = arrays.scale_arrays(df, "arr")
    return scaled.select("slice_id", "ts", "series_id", *[r(F.col("arr")[i]).alias(f"s{i}") for i in range(4)])


@check(
    "flag_lists",
    with_sql(fx.LOG) + "select event_id, trim(f) as flag, flags as joined from log, unnest(string_split(flags, ',')) as t(f)",
)
def flag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.anomaly_log(spark, sf_dir).select("event_id", arrays.join_flags(F.col("flags")).alias("joined"))
    return log.select("event_id", F.explode(arrays.split_flags(F.col("joined"))).alias("flag"), "joined")


@check(
    "iso_text",
    """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when extract(microsecond from ts) % 1000000 <> 0
      then '.' || lpad(cast(extract(microsecond from ts) % 1000000 as varchar), 6, '0') else '' end || '+00:00' as iso,
      strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso_hour from events""",
)
def iso_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", times.iso_text(F.col("ts")).alias("iso"), times.iso_text(fx.hour()).alias("iso_hour")
    )


@check(
    "interval_seconds",
    "select event_id, round((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000000.0::double, 6) as seconds from events",
)
def interval_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r(times.interval_seconds(fx.hour(), F.col("ts"))).alias("seconds"))


@check(
    "duration_by_type",
    with_sql(fx.LOG) + """select anomaly_type, count(*) as n_intervals, min(s) as min_seconds, avg(s) as mean_seconds, max(s) as max_seconds
    from (select anomaly_type, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0::double as s from log) group by 1""",
)
def duration_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.duration_by_type(fx.anomaly_log(spark, sf_dir))


@check(
    "squared_error",
    "select l_orderkey, l_linenumber, round((l_tax - l_discount) * (l_tax - l_discount), 6) as err from lineitem",
)
def squared_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftgrid.operators.pca import sq_error

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(sq_error(F.col("l_tax"), F.col("l_discount"))).alias("err"))


@check(
    "table_types",
    """select cast(row_number() over () - 1 as int) as position, column_name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
      when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' end as column_type from (describe events)""",
)
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table with their types."""
    return quality.column_types(table(spark, sf_dir, "events"))


@check("table_head", """select event_id, ts, event_type, "value" as value from events order by ts, event_id limit 5""")
def table_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest five events."""
    return quality.head(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "ts", "event_type", "value")
