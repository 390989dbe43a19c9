"""Balanced joins and time positions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftgrid.axis import time_axis, with_halo
from driftgrid.operators import impute, shape, windows
from driftgrid.plans import analyses
from driftgrid.spread import lookup, salted_join
from tests.helpers import START, grid_frame, matrix_of, pandas_impute, sparse_matrix

import numpy as np


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    fact = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("k")
    )
    fact = fact.unionByName(spark.createDataFrame([(9999, None)], "id bigint, k int"))
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    dim = dim.unionByName(dim.filter("k = 7").withColumn("v", F.lit(-1).cast("bigint")))
    plain = fact.join(dim, "k", how)
    salted = salted_join(fact, dim, ["k"], how, rows_per_task=100)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, salted.select(plain.columns).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_salted_join_spreads_a_hot_key(spark):
    fact = spark.range(1000).select("id", F.lit(1).alias("k"))
    dim = spark.createDataFrame([(1, "a")], "k int, v string")
    from driftgrid import spread

    seen = []
    original = spread.store
    spread.store = lambda df: seen.append(original(df)) or seen[-1]
    try:
        assert salted_join(fact, dim, ["k"], rows_per_task=100).count() == 1000
    finally:
        spread.store = original
    assert [tuple(r) for r in seen[0].collect()] == [(1, 10)]


def test_lookup_beyond_the_broadcast_limit(spark):
    fact = spark.range(500).select((F.col("id") % 5).alias("k"), "id")
    dim = spark.range(3).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"))
    small = lookup(fact, dim, "k").count()
    assert small == lookup(fact, dim, "k", broadcast_bytes=2).count() == 300
    assert "BroadcastHashJoin" in lookup(fact, dim, "k")._jdf.queryExecution().toString()


def test_time_axis_positions(spark):
    rows = [("a", START + dt.timedelta(seconds=17 * i)) for i in range(500)] + [("b", START)] + [("a", START)]
    axis = time_axis(spark.createDataFrame(rows, "slice_id string, ts timestamp_ntz"), chunk_rows=64)
    got = axis.filter("slice_id = 'a'").orderBy("ts").collect()
    assert [r["pos"] for r in got] == list(range(500))
    assert [r["chunk"] for r in got] == [i // 64 for i in range(500)]


def test_halo_repeats_the_end_of_each_chunk(spark):
    df = spark.range(20).select(F.col("id").alias("pos"), F.floor(F.col("id") / 8).alias("chunk"))
    rows = with_halo(df, 2, 8).filter("halo").orderBy("pos").collect()
    assert [(r["pos"], r["chunk"]) for r in rows] == [(6, 1), (7, 1), (14, 2), (15, 2)]
    far = with_halo(df, 9, 8).filter("halo")
    assert sorted((r["pos"], r["chunk"]) for r in far.collect()) == sorted(
        (p, c) for p in range(20) for c in range(p // 8 + 1, (p + 9) // 8 + 1)
    )


def test_windows_longer_than_a_chunk(spark):
    rows = [("a", "train", START + dt.timedelta(minutes=i), float(i), i, i // 8) for i in range(50)]
    df = spark.createDataFrame(rows, "slice_id string, split string, ts timestamp_ntz, value double, pos bigint, chunk bigint")
    got = windows.sliding_windows(df, length=20, chunk_rows=8).orderBy("pos").collect()
    assert [(r["pos"], r["x"], r["y"]) for r in got] == [(p, [float(i) for i in range(p - 20, p)], float(p)) for p in range(20, 50)]


def test_long_texts_are_not_broadcast(spark):
    fact = spark.range(1000).select(F.col("id").alias("k"))
    dim = spark.range(1000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100_000).alias("text"))
    joined = lookup(fact, dim, "k")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("text")[0]
    assert joined.count() == 1000


def test_null_keys_of_a_left_join_stay_out_of_it(spark):
    fact = spark.range(5000).select("id", F.when(F.col("id") < 10, F.col("id")).alias("k"))
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = salted_join(fact, dim, ["k"], "left", rows_per_task=100)
    assert joined.count() == 5000 and joined.filter("v = 1").count() == 10
    sizes = joined.rdd.glom().map(len).collect()
    assert max(sizes) < 2500


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from driftgrid import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        session.shared_folder(fake)


@pytest.mark.parametrize("chunk_rows", [2, 5, 4096])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impute_equals_pandas_for_any_chunk_size(spark, seed, chunk_rows):
    slices = {"a": sparse_matrix(seed, 60, 4, 0.3), "b": sparse_matrix(seed + 10, 23, 3, 0.15)}
    slices["a"][:40, 2] = np.nan
    got = matrix_of(impute.impute(grid_frame(spark, slices), chunk_rows=chunk_rows))
    for name, m in slices.items():
        np.testing.assert_allclose(got[name], pandas_impute(m), atol=1e-12)


@pytest.mark.parametrize("rows", [1, 2, 4])
def test_impute_with_other_windows(spark, rows):
    m = sparse_matrix(5, 40, 3, 0.3)
    got = matrix_of(impute.impute(grid_frame(spark, {"a": m}), rows=rows, chunk_rows=6))["a"]
    np.testing.assert_allclose(got, pandas_impute(m, rows), atol=1e-12)


def test_step_by_step_fills_equal_the_joint_one(spark):
    grid = grid_frame(spark, {"a": sparse_matrix(7, 50, 3, 0.25)})
    dense = shape.densify(grid, chunk_rows=7)
    steps = impute.bfill(impute.ffill(impute.impute_sma(dense, 3, chunk_rows=7)))
    np.testing.assert_allclose(matrix_of(steps)["a"], matrix_of(impute.impute(grid))["a"], atol=1e-12)


def test_pipeline_without_broadcasts_gives_the_same(spark, monkeypatch):
    slices = {"a": sparse_matrix(1, 120, 3, 0.6), "b": sparse_matrix(2, 60, 2, 0.6)}
    samples = grid_frame(spark, slices)
    lo, mid, hi = START - dt.timedelta(minutes=1), START + dt.timedelta(minutes=40), START + dt.timedelta(days=1)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    ranges = (at(lo), at(mid)), (at(mid), at(hi))
    order = ["slice_id", "split", "ts"]
    one = analyses.metric_pca(samples, *ranges, k=1).toPandas().sort_values(order)
    from driftgrid import spread

    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 20)
    two = analyses.metric_pca(samples, *ranges, k=1).toPandas().sort_values(order)
    assert one[order].values.tolist() == two[order].values.tolist()
    np.testing.assert_allclose(one["loss"], two["loss"], atol=1e-9)
