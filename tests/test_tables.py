"""Sources, attribute text, merges, spans, labels: edge cases on small inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgrid.functions import arrays, attrs, times
from driftgrid.operators import clean, impute, labels, merge, quality, shape, split, traces
from driftgrid.session import fresh_path
from driftgrid.sources import readers, schemas, writers
from tests.helpers import START, grid_frame


def one(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("{'host.name': 'a', 'service.name': 'b'}", {"host.name": "a", "service.name": "b"}),
        ("{'a': None, 'b': True, 'c': 'None, True'}", {"a": None, "b": "true", "c": "None, True"}),
        ("{'a': '[\"/usr/bin\", \"-jar\"]', 'b': None}", {"a": '["/usr/bin", "-jar"]', "b": None}),
        ("{'a': 'x: None, y', 'b': None}", {"a": "x: None, y", "b": None}),
        ("{}", {}),
        ("not a dict", None),
        ("{'a': 'it\\'s'", None),
        (None, None),
    ],
)
def test_parse_attrs(spark, text, want):
    assert one(spark, attrs.parse_attrs(F.col("t")), t=text) == want


def test_canonical_attrs(spark):
    a = one(spark, attrs.canonical_attrs(F.col("t")), t="{'b': 'x', 'a': None}")
    b = one(spark, attrs.canonical_attrs(F.col("t")), t="{'a': None, 'b': 'x'}")
    assert a == b == '{"a":null,"b":"x"}'
    assert one(spark, attrs.canonical_attrs(F.col("t")), t="plain text") == "plain text"


def test_filter_attrs_strips_before_it_matches(spark):
    m = attrs.filter_attrs(F.create_map(F.lit("\\host.name\\"), F.lit("\\a\\b\\"), F.lit("other"), F.lit("c")))
    assert one(spark, m, t="") == {"host.name": "a\\b"}


def test_repeated_attribute_keeps_its_last_value(spark):
    assert one(spark, attrs.canonical_attrs(F.col("t")), t="{'a': '1', 'a': '2'}") == '{"a":"2"}'


def test_null_slices_are_left_out(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y"), ("b", None)], "p string, q string")
    assert sorted(r["slice_id"] for r in shape.with_slice(df, "p").collect()) == ["a", "b"]
    assert [r["slice_id"] for r in shape.with_slice(df, ["p", "q"]).collect()] == ["a_x"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", None, None)], "k int, c string, n string, v double")
    assert clean.constant_columns(df) == ["c", "n", "v"]
    assert clean.prune_constant_columns(df, ["c"]).columns == ["k", "n", "v"]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), (None,), ("NaN",), ("\\N",)], "value string")
    assert [r[0] for r in clean.coerce_value(clean.null_literal(df)).collect()] == [1.5]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="ScopeName"):
        clean.require_columns(spark.range(1).withColumn("slice_id", F.lit("a")), ["id", "ScopeName"])


def test_times(spark):
    assert one(spark, times.parse_ts(F.col("t")), t="2024-07-22 16:47:22.882256861") == dt.datetime(2024, 7, 22, 16, 47, 22, 882256)
    assert one(spark, times.parse_ts(F.col("t")), t="soon") is None
    for moment in (dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60)):
        assert one(spark, times.iso_text(F.lit(moment)), t="") == moment.replace(tzinfo=dt.timezone.utc).isoformat()


def test_arrays(spark):
    assert one(spark, arrays.parse_array(F.col("t")), t="[1, 2.5]") == [1.0, 2.5]
    assert one(spark, arrays.pad_array(arrays.parse_array(F.col("t")), 4), t="[1, 2]") == [1, 2, 0, 0]
    assert one(spark, arrays.pad_array(arrays.parse_array(F.col("t")), 1), t="[1, 2]") == [1, 2]
    assert one(spark, arrays.split_flags(F.col("t")), t="a, b") == ["a", "b"]


def test_merge_equals_pandas_outer_merge(spark):
    a = pd.DataFrame({"k": ["x", "x", "y", None, "z"], "v": [1.0, 1.0, 2.0, 3.0, None]})
    b = pd.DataFrame({"k": ["x", "x", "x", None, None, "w"], "v": [1.0, 1.0, 1.0, 3.0, 3.0, 9.0]})
    schema = "k string, v double"
    sa = spark.createDataFrame([(None if r[0] is None else r[0], None if pd.isna(r[1]) else r[1]) for r in a.values.tolist()], schema)
    sb = spark.createDataFrame([(None if r[0] is None else r[0], None if pd.isna(r[1]) else r[1]) for r in b.values.tolist()], schema)
    want = a.merge(b, on=["k", "v"], how="outer")
    text = lambda rows: sorted((str(k), str(v)) for k, v in rows)
    got = merge.expand_copies(merge.merge_all(sa, sb)).collect()
    clean_want = [(None if pd.isna(k) else k, None if pd.isna(v) else v) for k, v in want.values.tolist()]
    assert text(got) == text(clean_want)


def test_weighted_grid_mean_needs_no_expansion(spark):
    schema = "slice_id string, ts timestamp_ntz, series_id int, value double"
    a = spark.createDataFrame([("a", START, 0, 1.0)] * 3 + [("a", START, 0, 5.0)], schema)
    b = spark.createDataFrame([("a", START, 0, 1.0)] * 2, schema)
    merged = merge.merge_all(a, b)
    wide = shape.to_grid(merge.expand_copies(merged)).first()["value"]
    assert shape.to_grid(merged, weight="copies").first()["value"] == pytest.approx(wide) == pytest.approx(11 / 7)


def test_three_files_merge_in_turn(spark):
    x = spark.createDataFrame([("a",)] * 2, "k string")
    rows = readers.merge_files(x, x, x).collect()
    assert [tuple(r) for r in rows] == [("a", 8)]


def test_large_multiplicity_expands(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1)], "k string, copies bigint")
    assert {r["k"]: r["count"] for r in merge.expand_copies(df).groupBy("k").count().collect()} == {"a": 25_001, "b": 1}


def test_series_numbers(spark):
    rows = [("s", 3, "b", None), ("s", 1, "b", "x"), ("s", 2, "a", None), ("s", 4, "b", None), ("t", 9, "z", "z")]
    df = spark.createDataFrame(rows, "slice_id string, ts int, p string, q string")
    by_value = {r["ts"]: r["series_id"] for r in shape.assign_series(df, ["p", "q"]).collect()}
    assert by_value == {2: 0, 3: 1, 4: 1, 1: 2, 9: 0}
    seen = {r["ts"]: r["series_id"] for r in shape.assign_series(df, ["p", "q"], "first_seen").collect()}
    assert seen == {1: 0, 2: 1, 3: 2, 4: 2, 9: 0}


def test_densify_leaves_out_what_has_no_value(spark):
    m = np.full((4, 3), np.nan)
    m[0, 0], m[2, 1] = 1.0, 2.0
    grid = grid_frame(spark, {"a": m}).unionByName(
        spark.createDataFrame([("a", START + dt.timedelta(minutes=3), 2, None)], "slice_id string, ts timestamp_ntz, series_id int, value double")
    )
    rows = shape.densify(grid).orderBy("ts", "series_id").collect()
    assert [(r["ts"].minute, r["series_id"], r["value"]) for r in rows] == [(0, 0, 1.0), (0, 1, None), (2, 0, None), (2, 1, 2.0)]


def test_split_by_bounds(spark):
    rows = [("a", "[1]", 1), ("a", "[2]", 2), ("a", None, 3), ("b", "[1]", 4), ("b", None, 5), ("c", None, 6)]
    got = shape.split_by_bounds(spark.createDataFrame(rows, "slice_id string, explicit_bounds string, n int")).collect()
    assert sorted((r["slice_id"], r["n"]) for r in got) == [("a_[1]", 1), ("a_[2]", 2), ("b", 4), ("b", 5), ("c", 6)]


@pytest.mark.parametrize("n,small_group", [(1, 10**6), (2, 10**6), (11, 10**6), (1000, 10**6), (1000, 0)])
def test_exact_quantiles(spark, n, small_group):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)] * 30, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quality.exact_quantiles(df, "v", probs, ["g"], small_group).collect()
    for r in got:
        want = np.quantile(x, r["prob"]) if r["g"] == "a" else 1.0
        assert r["quantile"] == pytest.approx(want, abs=1e-12)
    assert len(got) == 12


@pytest.mark.parametrize("cells", [64, 1024])
def test_exact_quantiles_by_counting(spark, monkeypatch, cells):
    """Groups that are never ranked: spread out, all equal, of very unequal scale, and with infinite ends."""
    monkeypatch.setattr(quality, "CELLS", cells)
    draw = np.random.default_rng(0)
    named = {
        "even": draw.exponential(size=20_000), "equal": np.full(5000, 3.25), "two": np.repeat([1.0, 2.0], 3000),
        "scales": np.concatenate([10.0 ** draw.uniform(-200, 200, 300), -(10.0 ** draw.uniform(-200, 200, 300))]),
        "wide": np.array([-1.7e308, 0.0, 1.7e308] * 40), "ends": np.concatenate([[-np.inf, np.inf], draw.normal(size=500)]),
    }
    df = spark.createDataFrame(pd.DataFrame([(k, v) for k, x in named.items() for v in x], columns=["g", "v"]))
    probs = [0.1, 0.5, 0.75, 0.99]
    got = {(r["g"], r["prob"]): r["quantile"] for r in quality.exact_quantiles(df, "v", probs, ["g"], small_group=0).collect()}
    assert len(got) == len(named) * len(probs)
    for (g, p), q in got.items():
        x = np.sort(named[g])
        at = (len(x) - 1) * p
        low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
        with np.errstate(over="ignore"):
            assert q == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-12), (g, p)
    whole = quality.exact_quantiles(df.filter("g = 'even'"), "v", probs, small_group=0).collect()
    assert {r["prob"]: r["quantile"] for r in whole} == pytest.approx({p: np.quantile(named["even"], p) for p in probs})


def test_large_groups_are_counted_without_a_window_over_their_values(spark, monkeypatch):
    monkeypatch.setattr(quality, "SMALL_GROUP", 50_000)
    df = spark.range(2_000_000).select((F.col("id") % 1_000_003).cast("double").alias("v"))
    got = {r["prob"]: r["quantile"] for r in quality.exact_quantiles(df, "v", [0.25, 0.9]).collect()}
    x = np.sort(np.arange(2_000_000) % 1_000_003)
    assert got == pytest.approx({0.25: np.quantile(x, 0.25), 0.9: np.quantile(x, 0.9)})


def test_split_ratio_follows_integer_part(spark):
    grid = impute.impute(grid_frame(spark, {"a": np.ones((7, 1)), "b": np.ones((10, 1))}))
    counts = split.split_ratio(grid).groupBy("slice_id", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in counts} == {("a", "train"): 5, ("a", "test"): 2, ("b", "train"): 8, ("b", "test"): 2}


def test_ranges_may_overlap(spark):
    df = grid_frame(spark, {"a": np.ones((10, 1))})
    at = lambda m: F.lit(START + dt.timedelta(minutes=m)).cast("timestamp_ntz")
    tagged = split.tag_ranges(df, (at(0), at(5)), (at(3), at(9)))
    assert {r[0]: r[1] for r in tagged.groupBy("split").count().collect()} == {"train": 5, "test": 6}


def chain_sets(spark, rows, **kw):
    df = spark.createDataFrame(rows, "span_id bigint, parent_span_id bigint")
    return {(r["span_id"], r["ancestor_id"]): r["depth"] for r in traces.span_chains(df, **kw).collect()}


def plain_chains(rows):
    parent = {}
    for s, p in rows:
        parent.setdefault(s, p)
    out = {}
    for s in parent:
        at, depth, seen = s, 0, []
        while at in parent and at not in seen:
            seen.append(at)
            out[(s, at)] = depth
            at, depth = parent[at], depth + 1
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [(1, None), (2, 1), (3, 2), (4, 99)],
        [(1, 2), (2, 1), (3, 1), (4, 3)],
        [(1, 1), (2, 1), (3, 2)],
        [(1, 2), (2, 3), (3, 4), (4, 2), (5, 1), (6, None)],
        [(i, i - 1 if i else None) for i in range(40)],
        [(i, 0 if i else None) for i in range(60)],
        [(0, None)],
    ],
    ids=["orphan", "two-cycle", "self", "tail-into-cycle", "long", "star", "single"],
)
def test_span_chains(spark, rows):
    assert chain_sets(spark, rows) == plain_chains(rows)
    assert chain_sets(spark, rows, rows_per_task=3) == plain_chains(rows)


def test_span_chains_depth_limit(spark):
    rows = [(i, i - 1 if i else None) for i in range(20)]
    assert chain_sets(spark, rows, max_depth=3) == {k: d for k, d in plain_chains(rows).items() if d <= 3}


def test_first_row_of_a_span_gives_its_parent(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 0), (3, 2, 5), (3, 1, 4)], "span_id bigint, parent_span_id bigint, n int")
    got = traces.span_chains(df, order=["n"]).filter("span_id = 3 and depth = 1").collect()
    assert [r["ancestor_id"] for r in got] == [1]


def test_interval_labels(spark):
    base = dt.datetime(2024, 1, 1, 10)
    minute = lambda m: base + dt.timedelta(minutes=m)
    log = [(minute(10), minute(20)), (minute(15), minute(30)), (minute(30), minute(31)), (minute(50), minute(190)), (minute(5), minute(5))]
    frame = spark.createDataFrame(log, "start_ts timestamp_ntz, end_ts timestamp_ntz")
    moments = [minute(m / 2) for m in range(-10, 500)]
    got = labels.label_intervals(spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz"), frame).collect()
    assert len(got) == len(moments)
    for r in got:
        assert r["is_anomaly"] == any(s <= r["ts"] <= e for s, e in log)


def test_labels_beyond_the_broadcast_limit(spark, no_broadcast):
    test_interval_labels(spark)


def test_evaluate(spark):
    rows = [("d", True, True)] * 3 + [("d", True, False)] + [("d", False, True)] * 2 + [("d", False, False)] * 4 + [("e", False, False)]
    got = {r["detector"]: r for r in labels.evaluate(spark.createDataFrame(rows, "detector string, flagged boolean, is_anomaly boolean")).collect()}
    assert (got["d"]["precision"], got["d"]["recall"]) == (0.75, 0.6)
    assert got["d"]["f1"] == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    assert got["e"]["precision"] is None and got["e"]["f1"] is None


def write_text(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


@pytest.mark.parametrize("multi_line", [False, True])
def test_utf16_csv(spark, tmp_path, multi_line):
    text = "a,\"x, y\",1\r\n\"say \"\"b\"\"\",été,2\r\n"
    write_text(tmp_path / "m.csv", text, "utf-16")
    rows = readers.read_metrics_csv(spark, str(tmp_path / "m.csv"), "p string, q string, n string", "UTF-16", multi_line).collect()
    assert [tuple(r) for r in rows] == [("a", "x, y", "1"), ('say "b"', "été", "2")]


@pytest.mark.parametrize("split_bytes", [64, 1 << 27])
def test_last_line_of_each_file_is_dropped(spark, tmp_path, split_bytes):
    for name, n in (("one", 50), ("two", 3), ("three", 1)):
        write_text(tmp_path / f"{name}.csv", "".join(f"{name},{i}\n" for i in range(n)) + "cut,")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        rows = readers.read_metrics_csv(spark, str(tmp_path), "k string, n int", drop_last_line=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(tuple(r) for r in rows) == sorted((n, i) for n, c in (("one", 50), ("two", 3), ("three", 1)) for i in range(c))


def test_record_with_line_break(spark, tmp_path):
    write_text(tmp_path / "m.csv", 'a,"one\ntwo"\nb,c\ncut')
    rows = readers.read_metrics_csv(spark, str(tmp_path / "m.csv"), "p string, q string", multi_line=True, drop_last_line=True).collect()
    assert [tuple(r) for r in rows] == [("a", "one\ntwo"), ("b", "c")]


def test_schemas():
    assert [len(schemas.columns(s)) for s in (schemas.GAUGE, schemas.SUM, schemas.HISTOGRAM)] == [21, 23, 26]


def test_anomaly_log_appends(spark):
    path = fresh_path(spark, "log")
    row = [(dt.datetime(2024, 1, 1, 1, 2, 3, 4), dt.datetime(2024, 1, 1, 1, 2, 9), "multiple", ["a", "b"])]
    log = spark.createDataFrame(row, "start_ts timestamp_ntz, end_ts timestamp_ntz, anomaly_type string, flags array<string>")
    writers.write_anomaly_log(log, path)
    writers.write_anomaly_log(log, path)
    assert [tuple(r) for r in writers.read_anomaly_log(spark, path).collect()] == row * 2
    raw = spark.read.option("header", True).csv(path).first()
    assert raw["Start Time (UTC)"] == "2024-01-01T01:02:03.000004+00:00" and raw["Flag(s)"] == "a,b"


def test_map_slices_last_pair_wins(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "slice_id string, v int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "slice_id string, w int")
    got = merge.map_slices(a, b, merge.mapping_table(a, [("p", "x"), ("p", "y"), ("q", "gone")])).collect()
    assert sorted((r["slice_id"], r["v"] or 0, r["w"] or 0) for r in got) == [("p_y", 0, 4), ("p_y", 1, 0)]


def test_one_sided_series_and_empty_side(spark):
    m = np.full((6, 3), 1.0)
    m[:3, 1] = np.nan
    m[3:, 2] = np.nan
    grid = grid_frame(spark, {"a": m})
    cut = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    left = quality.prune_one_sided(grid, cut(3)).select("series_id").distinct().collect()
    assert [r[0] for r in left] == [0]
    assert quality.prune_one_sided(grid, cut(0)).count() == 0


def test_utf16_in_either_byte_order(spark, tmp_path):
    text = "a,1\nb\u00e9,2\n"
    for name, mark, codec in (("le", b"\xff\xfe", "utf-16-le"), ("be", b"\xfe\xff", "utf-16-be")):
        (tmp_path / name).write_bytes(mark + text.encode(codec))
    read = lambda name, encoding: readers.read_metrics_csv(spark, str(tmp_path / name), "k string, n string", encoding=encoding)
    want = [("a", "1"), ("b\u00e9", "2")]
    assert sorted(map(tuple, read("le", "UTF-16").collect())) == want
    assert sorted(map(tuple, read("be", "UTF-16BE").collect())) == want
    with pytest.raises(Exception, match="byte order"):
        read("be", "UTF-16").collect()


def test_last_rows_go_whatever_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(2001).coalesce(1).write.csv(path)
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    rows = readers.read_metrics_csv(spark, path, "id string", drop_last_line=True)
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    try:
        assert rows.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)


# --- roots --------------------------------------------------------------------------------

def plain_roots(rows):
    """Follow every chain by hand; a chain that comes back to itself has no root."""
    parent = {}
    for span, up in rows:
        parent.setdefault(span, up)
    out = {}
    for span in parent:
        at, seen = span, [span]
        while parent[at] is not None and parent[at] in parent:
            at = parent[at]
            if at in seen:
                at = None
                break
            seen.append(at)
        out[span] = (at, len(seen) - 1 if at is not None else None)
    return out


@pytest.mark.parametrize("rows", [
    [(1, None), (2, 1), (3, 2), (4, 99), (5, 4)],
    [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None)],
    [(0, None)] + [(i, i - 1) for i in range(1, 200)],
    [(0, None)] + [(i, 0) for i in range(1, 300)] + [(1000 + i, 1 + i % 7) for i in range(300)],
])
def test_span_roots(spark, rows, no_broadcast):
    df = spark.createDataFrame(rows, "span_id bigint, parent_span_id bigint")
    got = {r["span_id"]: (r["root_id"], r["depth"]) for r in traces.span_roots(df, rows_per_task=50).collect()}
    assert got == plain_roots(rows)


def test_span_roots_of_a_long_chain(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("span_id"), F.when(F.col("id") % 500_000 > 0, F.col("id") - 1).alias("parent_span_id"))
    got = traces.span_roots(df)
    worst = got.agg(F.max(F.abs(F.col("span_id") - F.col("root_id") - F.col("depth"))).alias("a"), F.max("depth").alias("d"), F.count_distinct("root_id").alias("n"), F.count("root_id").alias("all")).first()
    assert (worst["a"], worst["d"], worst["n"], worst["all"]) == (0, 499_999, 2, 1_000_000)


def test_span_roots_of_nothing(spark):
    assert traces.span_roots(spark.createDataFrame([], "span_id bigint, parent_span_id bigint")).count() == 0


# --- numbering ----------------------------------------------------------------------------

@pytest.mark.parametrize("order", ["sorted", "first_seen"])
def test_numbering_over_ranges_equals_numbering_in_a_window(spark, monkeypatch, order):
    from driftgrid import spread

    rows = [("a" if i % 3 else "b", f"p{i * 37 % 101}" if i % 11 else None, i * 13 % 7, START + dt.timedelta(minutes=i * 29 % 500)) for i in range(600)]
    df = spark.createDataFrame(rows, "slice_id string, p string, q int, ts timestamp_ntz").repartition(7)
    keys = lambda d: {(r["slice_id"], r["p"], r["q"]): r["series_id"] for r in d.collect()}
    want = keys(shape.series_dictionary(df, ["p", "q"], order))
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert keys(shape.series_dictionary(df, ["p", "q"], order)) == want
    assert sorted(v for (s, *_), v in want.items() if s == "a") == list(range(sum(s == "a" for s, *_ in want)))


# --- alarms as events ---------------------------------------------------------------------

def plain_runs(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
            out[-1][2] += 1
        else:
            out.append([t, t, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bin_,gap", [("minute", 1), ("hour", 7), ("day", 60)])
def test_alarms_cross_the_borders_of_bins(spark, bin_, gap):
    draw = np.random.default_rng(gap)
    times = {d: sorted({START + dt.timedelta(minutes=int(m)) for m in draw.integers(0, 4000, n)}) for d, n in (("x", 900), ("y", 60))}
    rows = [(d, t, True) for d, ts in times.items() for t in ts] + [("x", START + dt.timedelta(minutes=4500), False), ("x", None, True)]
    df = spark.createDataFrame(rows, "detector string, ts timestamp_ntz, flagged boolean")
    if bin_ == "minute":  # a gap of a minute, bins of a minute
        df = df.filter("detector = 'y'")
    got = sorted((r["detector"], r["start_ts"], r["end_ts"], r["n"]) for r in labels.alarms(df, f"{gap} minutes", bin_=bin_).collect())
    want = sorted((d, *run) for d, ts in times.items() if bin_ != "minute" or d == "y" for run in plain_runs(ts, dt.timedelta(minutes=gap)))
    assert got == want


def test_overlaps_of_all_lengths(spark):
    draw = np.random.default_rng(1)

    def intervals(n, seed):
        starts = draw.integers(0, 10**6, n)
        sizes = (10 ** draw.uniform(0, 6, n)).astype(int) * draw.integers(0, 2, n)
        return [(int(i), START + dt.timedelta(seconds=int(s)), START + dt.timedelta(seconds=int(s + d))) for i, (s, d) in enumerate(zip(starts, sizes))]

    one, two = intervals(120, 1), intervals(150, 2) + [(999, START + dt.timedelta(seconds=50), START)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = sorted((r["id"], r["b_id"]) for r in labels.overlaps(frame(one), frame(two)).collect())
    want = sorted((i, j) for i, s, e in one for j, a, b in two if a <= b and s <= b and a <= e)
    assert got == want and len(want) > 500
    assert labels.overlaps(frame(one[:0]), frame(two)).count() == 0


def test_found_intervals_and_judged_alarms(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    log = spark.createDataFrame([(at(10), at(20), "point"), (at(100), at(130), "s_long"), (at(300), at(301), "point")], "start_ts timestamp_ntz, end_ts timestamp_ntz, anomaly_type string")
    found = spark.createDataFrame([("x", at(5), at(12), 3), ("x", at(110), at(111), 2), ("x", at(120), at(121), 2), ("x", at(200), at(210), 4), ("y", at(20), at(20), 1)],
                                  "detector string, start_ts timestamp_ntz, end_ts timestamp_ntz, n bigint")
    got = {(r["detector"], r["start_ts"]): (r["found"], r["alarms"], r["delay_seconds"]) for r in labels.found_intervals(found, log, ["x", "y"]).collect()}
    assert got == {
        ("x", at(10)): (True, 1, 0.0), ("x", at(100)): (True, 2, 600.0), ("x", at(300)): (False, 0, None),
        ("y", at(10)): (True, 1, 600.0), ("y", at(100)): (False, 0, None), ("y", at(300)): (False, 0, None),
    }
    judged = {(r["detector"], r["start_ts"]): r["is_true"] for r in labels.judged_alarms(found, log).collect()}
    assert judged == {("x", at(5)): True, ("x", at(110)): True, ("x", at(120)): True, ("x", at(200)): False, ("y", at(20)): True}
