"""Mergeable moments, streams against the same work in one batch, and sinks that may be repeated."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import moments, pca, shape, subspace, vectors
from driftgrid.operators.impute import impute
from driftgrid.plans import analyses
from driftgrid.session import fresh_path, store
from driftgrid.sources import writers
from driftgrid.spread import store_measured
from driftgrid.streaming import grid, scoring
from tests.helpers import START, grid_frame


def rows_of(spark, named, parts=5):
    rows = [(name, [float(v) for v in x]) for name, m in named.items() for x in m]
    return spark.createDataFrame(rows, "slice_id string, x array<double>").repartition(parts)


def states(df):
    return {r["slice_id"]: (r["n"], np.array(r["mean"]), moments.square(np.array(r["products"]), len(r["mean"]))) for r in df.collect()}


def check_state(state, m):
    n, mean, products = state
    assert n == len(m)
    np.testing.assert_allclose(mean, m.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(products / n, np.cov(m.T, bias=True).reshape(m.shape[1], -1), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_moments_far_from_zero(spark, shift):
    draw = np.random.default_rng(0)
    named = {"a": draw.normal(size=(300, 4)) + shift, "b": draw.normal(size=(40, 2)) * 5 - shift, "c": draw.normal(size=(1, 3))}
    got = states(moments.moments(rows_of(spark, named)))
    for name, m in named.items():
        n, mean, products = got[name]
        assert n == len(m)
        np.testing.assert_allclose(mean, m.mean(axis=0), rtol=1e-12)
        exact = m - shift * {"a": 1, "b": -1, "c": 0}[name]
        np.testing.assert_allclose(products / n, np.cov(exact.T, bias=True).reshape(m.shape[1], -1), rtol=1e-5, atol=1e-6 if shift else 1e-12)


def test_moments_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(moments, "FAN", 2)
    monkeypatch.setattr(moments, "PARTIAL_CELLS", 5)
    draw = np.random.default_rng(1)
    named = {name: draw.normal(size=(120, 3)) for name in "abc"}
    got = states(moments.moments(rows_of(spark, named, 11)))
    for name, m in named.items():
        check_state(got[name], m)


def test_merging_is_as_good_as_reading_again(spark):
    """States of three parts, one of them without a slice, against the moments of everything."""
    draw = np.random.default_rng(2)
    parts = [{"a": draw.normal(size=(50, 3)) + 100 * i, **({"b": draw.normal(size=(30, 2))} if i != 1 else {})} for i in range(3)]
    merged = states(moments.merge_moments([moments.moments(rows_of(spark, p)) for p in parts]))
    for name in "ab":
        check_state(merged[name], np.concatenate([p[name] for p in parts if name in p]))
    left = moments.merge_moments([moments.moments(rows_of(spark, parts[0])), moments.moments(rows_of(spark, parts[1]))])
    assert states(moments.merge_moments([left, moments.moments(rows_of(spark, parts[2]))]))["a"][0] == 150


def test_states_merge_on_shared_series(spark):
    draw = np.random.default_rng(3)
    one, two = draw.normal(size=(40, 3)), draw.normal(size=(60, 3))
    a = moments.moments(rows_of(spark, {"a": one})).withColumn("series", F.array(F.lit(0), F.lit(1), F.lit(4)))
    b = moments.moments(rows_of(spark, {"a": two})).withColumn("series", F.array(F.lit(1), F.lit(3), F.lit(4)))
    row = moments.merge_moments([a, b]).first()
    assert row["series"] == [1, 4]
    check_state((row["n"], np.array(row["mean"]), moments.square(np.array(row["products"]), 2)), np.concatenate([one[:, [1, 2]], two[:, [0, 2]]]))


def test_model_from_moments_standardises(spark):
    draw = np.random.default_rng(4)
    m = draw.normal(size=(200, 3)) @ draw.normal(size=(3, 3)) * [1, 20, 300] + 1000
    m = np.column_stack([m, np.full(200, 7.3)])  # a constant series counts as deviation 1
    model = pca.pca_of(moments.moments(rows_of(spark, {"a": m})), k=2, standardise=True).first()
    scaled = (m - m.mean(axis=0)) / np.where(m.std(axis=0) > 1e-9, m.std(axis=0), 1)
    values = np.linalg.eigvalsh(np.cov(scaled.T, bias=True))[::-1]
    np.testing.assert_allclose(model["eigenvalues"], values, atol=1e-9)
    np.testing.assert_allclose(model["scale"][:3], m.std(axis=0)[:3])
    assert model["scale"][3] == 1.0 and model["mean"] == [0.0] * 4


# --- streams ------------------------------------------------------------------------------

def minutes(n):
    return START + dt.timedelta(minutes=n)


def write_files(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, grid.SAMPLES).coalesce(1).write.mode("append").parquet(path)


def run_stream(spark, path, out, model, delay="30 minutes"):
    scoring.score_stream(grid.read_samples(spark, path), model, out, f"{out}/checkpoint", delay=delay).awaitTermination()


@pytest.fixture(scope="module")
def fitted(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(90, 2))
    m = {"a": np.hstack([base, base @ draw.normal(size=(2, 2)) + 0.1 * draw.normal(size=(90, 2))]), "b": draw.normal(size=(60, 3))}
    at = lambda n: F.lit(minutes(n)).cast("timestamp_ntz")
    return store_measured(analyses.fit_metric_pca(grid_frame(spark, m), (at(-1), at(1000)), k=1))


def samples(seed, hours, slices=("a", "b", "unknown")):
    draw = np.random.default_rng(seed)
    return [(s, minutes(60 * h + int(draw.integers(0, 60))), int(k), float(draw.normal())) for h in hours for s in slices for k in draw.integers(0, 4, 6)]


def test_stream_equals_batch_and_a_restart_repeats_nothing(spark, fitted):
    path, out = fresh_path(spark, "arrivals"), fresh_path(spark, "streamed")
    files = [samples(i, range(3 * i, 3 * i + 3)) for i in range(5)]
    write_files(spark, path, files[:2])
    run_stream(spark, path, out, fitted)
    first = set(r["run"] for r in writers.runs(spark, f"{out}/loss").collect())
    run_stream(spark, path, out, fitted)  # nothing new
    assert set(r["run"] for r in writers.runs(spark, f"{out}/loss").collect()) == first
    write_files(spark, path, files[2:])
    run_stream(spark, path, out, fitted)
    latest = max(t for f in files for _, t, _, _ in f)
    every = spark.createDataFrame([r for f in files for r in f], grid.SAMPLES)
    cells = grid.tumbling_means(every).filter(F.col("ts") + F.expr("interval 1 hour") <= F.lit(latest - dt.timedelta(minutes=30)).cast("timestamp_ntz"))
    want = sorted((r["slice_id"], r["ts"], round(r["loss"], 9)) for r in scoring.score_cells(cells, fitted).collect())
    rows = writers.read_runs(spark, f"{out}/loss")
    got = sorted((r["slice_id"], r["ts"], round(r["loss"], 9)) for r in rows.collect())
    assert got == want and {r[0] for r in got} == {"a", "b"}
    assert rows.select("run").distinct().count() > 3  # several micro-batches gave something
    streamed = sorted((r["slice_id"], r["ts"], r["series_id"], r["n"]) for r in writers.read_runs(spark, f"{out}/grid").collect())
    assert streamed == sorted((r["slice_id"], r["ts"], r["series_id"], r["n"]) for r in cells.collect())


def test_late_samples_change_open_windows_and_are_counted_behind_the_watermark(spark, fitted):
    path, out = fresh_path(spark, "arrivals"), fresh_path(spark, "streamed")
    row = lambda h, m, v, s=0: ("a", minutes(60 * h + m), s, float(v))
    files = [
        [row(0, 10, 1), row(1, 10, 10)],
        [row(0, 50, 3), row(2, 50, 5)],  # the first hour is still open: its mean changes
        [row(5, 0, 7)],
        [row(0, 20, 100), row(5, 30, 9), row(6, 0, 1)],  # hour 0 is long behind the watermark
        [row(9, 0, 1)],
        [row(1, 5, 50, s=2), row(12, 0, 1)],  # a window that is late as a whole
    ]
    write_files(spark, path, files)
    run_stream(spark, path, out, fitted)
    cells = writers.read_runs(spark, f"{out}/grid").drop("run")
    got = {(r["ts"], r["series_id"]): (r["value"], r["n"]) for r in cells.collect()}
    assert got[(minutes(0), 0)] == (2.0, 2) and got[(minutes(300), 0)] == (8.0, 2) and (minutes(60), 2) not in got
    arrived = spark.read.schema(grid.SAMPLES).parquet(path)
    late = {(r["ts"], r["series_id"]): (r["n"], r["late"]) for r in grid.late_counts(arrived, cells).collect()}
    assert late[(minutes(0), 0)] == (2, 1) and late[(minutes(60), 2)] == (0, 1) and late[(minutes(300), 0)] == (2, 0)
    assert sum(n + k for n, k in late.values()) == arrived.filter(F.col("ts") < minutes(60 * 10)).count()


def test_scored_cells_against_numpy(spark, fitted):
    model = {r["slice_id"]: r for r in fitted[0].collect()}
    cells = spark.createDataFrame([("a", minutes(0), 0, 1.0, 1), ("a", minutes(0), 2, -2.0, 1), ("a", minutes(60), 9, 5.0, 1), ("x", minutes(0), 0, 1.0, 1)],
                                  "slice_id string, ts timestamp_ntz, series_id int, value double, n bigint")
    got = {r["ts"]: r["loss"] for r in scoring.score_cells(cells, fitted).collect()}
    m = model["a"]
    z = np.zeros(4)
    z[0], z[2] = (1.0 - m["center"][0]) / m["scale"][0], (-2.0 - m["center"][2]) / m["scale"][2]
    axes = np.array(m["loadings"]).reshape(m["k"], 4)
    assert got[minutes(0)] == pytest.approx(((z - axes.T @ (axes @ z)) ** 2).sum()) and got[minutes(60)] == 0.0 and len(got) == 2


# --- sinks --------------------------------------------------------------------------------

def test_runs_count_once_and_only_when_finished(spark):
    path = fresh_path(spark, "runs")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    writers.write_run(frame(1, 2), path, "007")
    writers.write_run(frame(3), path, "7")
    writers.write_run(frame(4, 5, 6), path, "007")
    frame(9).write.parquet(f"{path}/data/half-written")  # an attempt that never reached the manifest
    got = sorted((r["run"], r["x"]) for r in writers.read_runs(spark, path).collect())
    assert got == [("007", 4), ("007", 5), ("007", 6), ("7", 3)]
    assert [r["x"] for r in writers.read_runs(spark, path, ["7"]).collect()] == [3]
    assert writers.read_runs(spark, path, ["none"]).count() == 0
    with pytest.raises(Exception):
        writers.write_run(frame(1).select(F.raise_error(F.lit("lost")).cast("int").alias("x")), path, "7")
    assert [r["x"] for r in writers.read_runs(spark, path, ["7"]).collect()] == [3]


def test_moments_of_one_range_fit_like_the_samples_themselves(spark):
    draw = np.random.default_rng(9)
    m = draw.normal(size=(80, 3)) @ draw.normal(size=(3, 3))
    at = lambda n: F.lit(minutes(n)).cast("timestamp_ntz")
    frame = grid_frame(spark, {"a": m})
    means = store(shape.to_grid(frame))
    parts = []
    for lo, hi in ((-1, 30), (30, 100)):
        v = vectors.to_vectors(impute(means)).filter((F.col("ts") > at(lo)) & (F.col("ts") <= at(hi)))
        parts.append(analyses.vector_moments(v, shape.series_lists(means)))
    one = analyses.fit_metric_pca(frame, (at(-1), at(100)), k=2).first()
    two = analyses.fit_from_moments(moments.merge_moments(parts), k=2).first()
    for c in ("eigenvalues", "loadings", "center", "scale"):
        np.testing.assert_allclose(one[c], two[c], atol=1e-9)


# --- wide slices --------------------------------------------------------------------------

def test_leading_components_of_wide_slices(spark, monkeypatch):
    """200 series with a falling spectrum, far from zero, against the exact decomposition."""
    draw = np.random.default_rng(11)
    spectrum = 0.5 ** np.arange(200) + 1e-3
    named = {name: draw.normal(size=(n, 200)) * np.sqrt(spectrum) @ np.linalg.qr(draw.normal(size=(200, 200)))[0] + 1e4 for name, n in (("a", 600), ("b", 400))}
    rows = store(rows_of(spark, named, 6))
    model = {r["slice_id"]: r for r in subspace.fit_wide_pca(rows, k=5).collect()}
    for name, m in named.items():
        values, axes = np.linalg.eigh(np.cov(m.T, bias=True))
        np.testing.assert_allclose(model[name]["eigenvalues"], values[::-1][:5], rtol=1e-6)
        assert model[name]["variance"] == pytest.approx(values.sum(), rel=1e-9) and model[name]["n"] == len(m)
        found = np.array(model[name]["loadings"]).reshape(5, 200)
        inside = np.linalg.svd(found @ axes[:, ::-1][:, :5])[1]
        assert inside.min() > 1 - 1e-6  # all directions of the exact subspace were found
        np.testing.assert_allclose(model[name]["mean"], m.mean(axis=0), rtol=1e-13)
    monkeypatch.setattr(subspace, "FAN", 2)
    apart = {r["slice_id"]: r for r in subspace.fit_wide_pca(rows, k=5, round_bytes=5000).collect()}
    np.testing.assert_allclose(apart["a"]["eigenvalues"], model["a"]["eigenvalues"], rtol=1e-9)


def test_number_of_leading_components_follows_the_variance(spark):
    draw = np.random.default_rng(12)
    rows = store(rows_of(spark, {"a": draw.normal(size=(300, 40)) * np.sqrt(0.5 ** np.arange(40)), "flat": np.ones((10, 5))}))
    got = {r["slice_id"]: r["k"] for r in subspace.fit_wide_pca(rows, target=0.9).collect()}
    want = {r["slice_id"]: r["k"] for r in pca.fit_pca(rows, target=0.9).collect()}
    assert got == want
