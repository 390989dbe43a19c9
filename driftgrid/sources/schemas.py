"""Column lists of the telemetry exports (fixed values: they follow the exporter's table layout)."""

from __future__ import annotations

from pyspark.sql import types as T

_RESOURCE = (
    "ResourceAttributes string, ResourceSchemaUrl string, ScopeName string, ScopeVersion string, "
    "ScopeAttributes string, ScopeDroppedAttrCount string, ScopeSchemaUrl string, ServiceName string, "
    "MetricName string, MetricDescription string, MetricUnit string, Attributes string, "
    "StartTimeUnix string, TimeUnix string, "
)

GAUGE = _RESOURCE + (
    "Value string, Flags string, FilteredAttributes string, TimeUnix_ string, Value_ string, "
    "SpanId string, TraceId string"
)

SUM = _RESOURCE + (
    "Value string, Flags string, FilteredAttributes string, TimeUnix1 string, Value1 string, "
    "SpanId string, TraceId string, AggTemp string, IsMonotonic string"
)

HISTOGRAM = _RESOURCE + (
    "Count string, Sum string, BucketCounts string, ExplicitBounds string, FilteredAttributes string, "
    "TimeUnix1 string, Value string, SpanId string, TraceId string, Flags string, Min string, Max string"
)

#: Flat trace export; event and link columns have dotted names.
TRACES_FLAT = (
    "Timestamp string, TraceId string, SpanId string, ParentSpanId string, TraceState string, SpanName string, SpanKind string, "
    "ServiceName string, ResourceAttributes string, ScopeName string, ScopeVersion string, SpanAttributes string, Duration string, "
    "StatusCode string, StatusMessage string, `Events.Timestamp` string, `Events.Name` string, `Events.Attributes` string, "
    "`Links.TraceId` string, `Links.SpanId` string, `Links.TraceState` string, `Links.Attributes` string"
)

TRACES = (
    "ts timestamp_ntz, trace_id bigint, span_id bigint, parent_span_id bigint, trace_state string, "
    "span_name string, span_kind string, service string, resource_attributes string, scope_name string, "
    "scope_version string, span_attributes string, duration double, status_code string, "
    "status_message string, "
    "events struct<ts: timestamp_ntz, name: string, attributes: string>, "
    "links struct<trace_id: bigint, span_id: bigint, trace_state: string, attributes: string>"
)

ANOMALY_LOG = "`Start Time (UTC)` string, `End Time (UTC)` string, `Anomaly Type` string, `Flag(s)` string"

# Identity columns that form a series in each kind of export.
GAUGE_SERIES = ("ScopeName", "ScopeVersion", "MetricName", "Attributes")
SUM_SERIES = ("MetricName", "MetricDescription", "MetricUnit", "Attributes", "StartTimeUnix")
WINDOW_SERIES = (
    "ScopeName", "ScopeVersion", "MetricName", "MetricDescription", "MetricUnit", "Attributes", "StartTimeUnix",
)
HISTOGRAM_SERIES = (
    "ResourceSchemaUrl", "ScopeName", "MetricName", "MetricDescription", "MetricUnit", "Attributes",
    "StartTimeUnix", "ExplicitBounds",
)


def columns(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames()
