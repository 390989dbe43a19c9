"""Model operators against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import buckets, iforest, pca, scale, shape, thresholds, vectors, wavelet, windows
from driftgrid.operators.impute import impute
from driftgrid.plans import analyses, saved
from driftgrid.session import store
from tests.helpers import START, grid_frame, matrix_of, numpy_pca_loss, pandas_impute, sparse_matrix


def dense_slices(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(80, 2))
    a = np.hstack([base, base @ rng.normal(size=(2, 3)) + 0.1 * rng.normal(size=(80, 3))])
    return {"a": a, "b": rng.normal(size=(60, 3)) * [1, 5, 10]}


def tagged_vectors(spark, slices, train_rows=50):
    grid = impute(grid_frame(spark, slices), chunk_rows=16)
    edge = START + dt.timedelta(minutes=train_rows)
    grid = grid.withColumn("split", F.when(F.col("ts") < F.lit(edge), "train").otherwise("test"))
    return store(vectors.to_vectors(grid))


def losses(df):
    pdf = df.toPandas().sort_values(["slice_id", "ts"])
    return {name: g["loss"].to_numpy() for name, g in pdf.groupby("slice_id")}


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_pca_loss(spark, k):
    slices = dense_slices()
    v = tagged_vectors(spark, slices)
    model = pca.fit_pca(v.filter("split = 'train'"), k=k)
    got = losses(pca.score_losses(v, model))
    for name, m in slices.items():
        np.testing.assert_allclose(got[name], numpy_pca_loss(m[:50], m, k), atol=1e-8)


def test_full_rank_has_no_loss_and_loss_falls_with_k(spark):
    v = tagged_vectors(spark, dense_slices(3))
    totals = []
    for k in (1, 2, 3, None):
        model = pca.fit_pca(v, k=k, full_rank=k is None)
        totals.append(sum(x.sum() for x in losses(pca.score_losses(v, model)).values()))
    assert totals == sorted(totals, reverse=True)
    assert totals[-1] < 1e-9


@pytest.mark.parametrize("target,plus", [(0.8, 1), (0.9, 1), (0.9, 0), (0.2, 0)])
def test_number_of_components(spark, target, plus):
    slices = dense_slices(4)
    model = pca.fit_pca(tagged_vectors(spark, slices, 1000), target=target, plus=plus)
    again = {r["slice_id"]: r["n_components"] for r in pca.num_components(model, target, plus).collect()}
    for row in model.collect():
        values = np.linalg.eigvalsh(np.cov(slices[row["slice_id"]].T))[::-1]
        want = int(np.argmax(np.cumsum(values) / values.sum() >= target)) + plus
        assert row["k"] == want == again[row["slice_id"]]


def test_contributions_sum_to_the_loss_and_rank_by_it(spark):
    slices = dense_slices(5)
    v = tagged_vectors(spark, slices)
    series = shape.series_lists(grid_frame(spark, slices))
    model = store(pca.fit_pca(v, k=1))
    scored = pca.score_vectors(v, model)
    contrib = pca.contributions(scored, series).toPandas()
    total = contrib.groupby(["slice_id", "ts"])["sq_error"].sum().sort_index()
    loss = pca.loss_sse(scored).toPandas().set_index(["slice_id", "ts"])["loss"].sort_index()
    np.testing.assert_allclose(total, loss, atol=1e-10)
    got = pca.explain(v, model, series, threshold=3.0, k=2).toPandas()
    by_window = pca.top_k(pca.contributions(scored, series), 2).toPandas()
    flagged = set(loss[loss > 3.0].index)
    assert set(zip(got["slice_id"], got["ts"])) == flagged
    want = by_window[[t in flagged for t in zip(by_window["slice_id"], by_window["ts"])]]
    key = ["slice_id", "ts", "rank"]
    assert got.sort_values(key)["series_id"].tolist() == want.sort_values(key)["series_id"].tolist()


def test_root_causes_scale_and_fit_on_train(spark):
    slices = dense_slices(6)
    at = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    got = analyses.metric_root_causes(
        grid_frame(spark, slices), (at(-1), at(49)), (at(49), at(1000)), threshold=1.0, k=5, components=2
    ).toPandas()
    for name, m in slices.items():
        scaled = (m - m[:50].mean(axis=0)) / m[:50].std(axis=0)
        loss = numpy_pca_loss(scaled[:50], scaled[50:], 2)
        mine = got[(got["slice_id"] == name) & (got["rank"] == 1)].sort_values("ts")["loss"].to_numpy()
        np.testing.assert_allclose(mine, loss[loss > 1.0], atol=1e-8)


def test_models_fitted_once_score_later_samples(spark):
    """Scaler and components of train; a series without samples counts as its train mean, an unknown one not at all."""
    m = dense_slices(6)["a"]
    at = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    model = store(analyses.fit_metric_pca(grid_frame(spark, {"a": m}), (at(-1), at(49)), k=2))
    later = np.hstack([m, m[:, :1] * 100])
    later[:, 1] = np.nan
    got = analyses.score_metric_pca(grid_frame(spark, {"a": later, "b": m}), model, (at(49), at(1000)))
    centred = (np.where(np.isnan(later), 0, later)[:, :5] - m[:50].mean(axis=0)) / m[:50].std(axis=0)
    centred[:, 1] = 0
    want = numpy_pca_loss((m[:50] - m[:50].mean(axis=0)) / m[:50].std(axis=0), centred[50:], 2)
    np.testing.assert_allclose(losses(got)["a"], want, atol=1e-8)
    assert set(losses(got)) == {"a"}


def test_covariance(spark):
    slices = dense_slices(8)
    got = vectors.covariance(tagged_vectors(spark, slices, 1000)).toPandas()
    for name, m in slices.items():
        want = np.cov(m.T, bias=True)
        for row in got[got["slice_id"] == name].itertuples():
            assert row.cov == pytest.approx(want[row.i, row.j], abs=1e-9)


def window_input(spark, slices, ratio=0.8, chunk_rows=16):
    rows = []
    for name, x in slices.items():
        cut = int(len(x) * ratio)
        for i, v in enumerate(x):
            split, pos = ("train", i) if i < cut else ("test", i - cut)
            rows.append((name, split, START + dt.timedelta(minutes=i), float(v), pos, pos // chunk_rows))
    return spark.createDataFrame(rows, "slice_id string, split string, ts timestamp_ntz, value double, pos bigint, chunk bigint")


def numpy_windows(x, length):
    return np.array([x[i:i + length] for i in range(len(x) - length)]), x[length:]


@pytest.mark.parametrize("length,chunk_rows", [(1, 4), (5, 7), (5, 5), (12, 4096)])
def test_sliding_windows(spark, length, chunk_rows):
    x = np.arange(60.0)
    got = windows.sliding_windows(window_input(spark, {"a": x, "b": x[:4]}, chunk_rows=chunk_rows), length, chunk_rows).toPandas()
    for name, full in {"a": x, "b": x[:4]}.items():
        cut = int(len(full) * 0.8)
        for split, part in {"train": full[:cut], "test": full[cut:]}.items():
            mine = got[(got["slice_id"] == name) & (got["split"] == split)].sort_values("ts")
            assert len(mine) == max(0, len(part) - length)
            if len(mine):
                want_x, want_y = numpy_windows(part, length)
                np.testing.assert_array_equal(np.stack(mine["x"]), want_x)
                np.testing.assert_array_equal(mine["y"], want_y)


@pytest.mark.parametrize("against", ["window", "target"])
def test_forecast_loss(spark, against):
    rng = np.random.default_rng(0)
    slices = {"a": np.sin(np.arange(150) / 5) + 0.1 * rng.normal(size=150), "b": rng.normal(size=120)}
    found = store(windows.sliding_windows(window_input(spark, slices), 6, 16))
    got = windows.forecast_loss(found, windows.fit_forecast(found), against).toPandas()
    for name, x in slices.items():
        cut = int(len(x) * 0.8)
        tx, ty = numpy_windows(x[:cut], 6)
        coef, *_ = np.linalg.lstsq(np.hstack([np.ones((len(tx), 1)), tx]), ty, rcond=None)
        for split, part in {"train": x[:cut], "test": x[cut:]}.items():
            px, py = numpy_windows(part, 6)
            guess = coef[0] + px @ coef[1:]
            want = ((px - guess[:, None]) ** 2).mean(axis=1) if against == "window" else (py - guess) ** 2
            mine = got[(got["slice_id"] == name) & (got["split"] == split)].sort_values("ts")["loss"]
            np.testing.assert_allclose(mine, want, atol=1e-8)


def test_window_reconstruction(spark):
    rng = np.random.default_rng(1)
    slices = {"a": np.sin(np.arange(150) / 5) + 0.2 * rng.normal(size=150)}
    found = store(windows.sliding_windows(window_input(spark, slices), 10, 16))
    got = windows.window_reconstruction_loss(found, windows.fit_window_autoencoder(found, 4)).toPandas()
    tx, _ = numpy_windows(slices["a"][:120], 10)
    sx, _ = numpy_windows(slices["a"][120:], 10)
    for split, part in {"train": tx, "test": sx}.items():
        mine = got[got["split"] == split].sort_values("ts")["loss"]
        np.testing.assert_allclose(mine, numpy_pca_loss(tx, part, 4) / 10, atol=1e-9)


def direct_smooth(x, taps):
    """Decomposition and reconstruction by plain loops over a mirrored signal."""
    h, width = np.array(taps), len(taps)
    lengths, a = [len(x)], np.asarray(x, dtype=float)
    levels = int(np.floor(np.log2(len(x) / (width - 1)))) if len(x) >= width - 1 else 0
    for _ in range(levels):
        n = len(a)
        mirrored = np.concatenate([a[::-1], a, a[::-1]])
        a = np.array([sum(h[j] * mirrored[n + 2 * k + 1 - j] for j in range(width)) for k in range((n + width - 1) // 2)])
        lengths.append(len(a))
    for n in reversed(lengths[:-1]):
        out = np.zeros(n)
        for i in range(n):
            for k in range(len(a)):
                q = i + width - 2 - 2 * k
                if 0 <= q < width:
                    out[i] += a[k] * h[width - 1 - q]
        a = out
    return a


def test_wavelet_smooth(spark):
    rng = np.random.default_rng(2)
    slices = {"long": rng.normal(size=130), "short": rng.normal(size=35), "tiny": rng.normal(size=5), "flat": np.full(57, 3.0)}
    got = wavelet.wavelet_smooth(window_input(spark, slices, ratio=0.7)).toPandas()
    taps = wavelet.LOW_PASS["db4"]
    for name, x in slices.items():
        cut = int(len(x) * 0.7)
        for split, part in {"train": x[:cut], "test": x[cut:]}.items():
            mine = got[(got["slice_id"] == name) & (got["split"] == split)].sort_values("pos")["value"].to_numpy()
            np.testing.assert_allclose(mine, direct_smooth(part, taps), atol=1e-9)
    np.testing.assert_allclose(got[got["slice_id"] == "flat"]["value"], 3.0, atol=1e-9)


@pytest.mark.parametrize("block,levels", [(16, 2), (64, 1), (64, 3)])
def test_wavelet_smooth_in_blocks(spark, block, levels):
    """Series of many blocks, cut twice on the way down, with borders at every level."""
    rng = np.random.default_rng(4)
    slices = {"long": rng.normal(size=1501), "short": rng.normal(size=40), "odd": rng.normal(size=block * 5 + 1)}
    got = wavelet.wavelet_smooth(window_input(spark, slices, ratio=0.8), block=block, levels=levels).toPandas()
    taps = wavelet.LOW_PASS["db4"]
    for name, x in slices.items():
        cut = int(len(x) * 0.8)
        for split, part in {"train": x[:cut], "test": x[cut:]}.items():
            mine = got[(got["slice_id"] == name) & (got["split"] == split)].sort_values("pos")["value"].to_numpy()
            np.testing.assert_allclose(mine, direct_smooth(part, taps), atol=1e-9)


@pytest.mark.parametrize("n", [5, 7, 13, 14, 15, 28, 57, 101, 333])
def test_smoothing_of_arrays_at_every_border(n):
    x = np.random.default_rng(n).normal(size=n)
    levels = int(np.floor(np.log2(n / 7))) if n >= 7 else 0
    taps = np.array(wavelet.LOW_PASS["db4"])
    np.testing.assert_allclose(wavelet.smoothed(x, levels, taps), direct_smooth(x, taps), atol=1e-10)


def test_low_pass_taps_are_orthonormal():
    h = np.array(wavelet.LOW_PASS["db4"])
    assert h.sum() == pytest.approx(np.sqrt(2))
    for shift in range(4):
        assert h[2 * shift:] @ h[:len(h) - 2 * shift] == pytest.approx(1.0 if shift == 0 else 0.0, abs=1e-10)


def test_bucket_pca(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 20, size=(40, 3, 4))
    rows = [
        ("a", START + dt.timedelta(minutes=i), s, str(counts[i, s].tolist())) for i in range(40) for s in range(3)
    ]
    df = spark.createDataFrame(rows, "slice_id string, ts timestamp_ntz, series_id int, bucket_counts string")
    at = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    loss, overall = analyses.histogram_pca(df, (at(0), at(24)), (at(25), at(60)), k=1)
    per_bucket = [numpy_pca_loss(counts[:25, :, b].astype(float), counts[:, :, b].astype(float), 1) for b in range(4)]
    want = sum(per_bucket) / 12
    got = loss.toPandas().sort_values("ts")["loss"].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)
    mse = {r["split"]: r["mse"] for r in overall.collect()}
    assert mse["train"] == pytest.approx(want[:25].mean()) and mse["test"] == pytest.approx(want[25:].mean())


def test_ragged_buckets_are_padded_before_the_split(spark):
    rows = [("a", START + dt.timedelta(minutes=i), 0, "[1, 2]" if i % 2 else "[1, 2, 3]") for i in range(10)]
    df = spark.createDataFrame(rows, "slice_id string, ts timestamp_ntz, series_id int, bucket_counts string")
    sizes = buckets.bucket_grid(df).select(F.size("bucket_counts")).distinct().collect()
    assert [r[0] for r in sizes] == [3]


def walk(x, nodes, n):
    node = nodes[(n, 1)]
    at = 1
    while node["feature"] >= 0:
        at = 2 * at + int(x[node["feature"]] >= node["threshold"])
        node = nodes[(n, at)]
    depth = at.bit_length() - 1
    size = node["size"]
    extra = 0.0 if size <= 1 else 1.0 if size == 2 else 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size
    return depth + extra


def test_forest_scores_against_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    model = store(iforest.fit_iforest(df, ["a", "b"], "id", trees=20, sample=64))
    nodes = {(r["tree"], r["node"]): r.asDict() for r in model.collect()}
    assert all(nodes[(t, 1)]["size"] == 64 for t in range(20))
    got = iforest.score_iforest(df, model, ["a", "b"], sample=64).toPandas().sort_values("id")["score"].to_numpy()
    normal = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** -(np.mean([walk(p, nodes, t) for t in range(20)]) / normal) for p in x[-40:]]
    np.testing.assert_allclose(got[-40:], want, atol=1e-12)
    assert got.argmax() == 300


def test_forest_sample_is_whole_whatever_the_prefilter(spark):
    df = spark.range(5000).select(F.col("id"), F.rand(1).alias("a"))
    rows = iforest.tree_samples(df, ["a"], "id", trees=5, sample=32)
    assert [r["count"] for r in rows.groupBy("tree").count().collect()] == [32] * 5
    every = df.select("id").toPandas()["id"].to_numpy()
    m = iforest.MODULUS
    for tree in range(5):
        mixed = ((every % m) * (iforest.ROW_FACTOR + iforest.TREE_FACTOR * tree) + iforest.NODE_FACTOR * (tree + 42)) % m
        best = every[np.lexsort((every, (mixed * mixed + every) % m))][:32]
        want = df.filter(F.col("id").isin([int(i) for i in best])).select("a").toPandas()["a"]
        got = rows.filter(F.col("tree") == tree).toPandas()["a"]
        assert sorted(got) == sorted(want)


def test_scalers_treat_constant_series(spark):
    m = np.array([[1.0, 5.0], [3.0, 5.0], [5.0, 5.0]])
    grid = grid_frame(spark, {"a": m})
    got = matrix_of(scale.apply_scaler(grid, scale.fit_standard(grid)))["a"]
    np.testing.assert_allclose(got, np.column_stack([(m[:, 0] - 3) / m[:, 0].std(), [0, 0, 0]]))
    got = matrix_of(scale.apply_scaler(grid, scale.fit_minmax(grid)))["a"]
    np.testing.assert_allclose(got, [[0, 0], [0.5, 0], [1, 0]])


def test_sigma_threshold(spark):
    rng = np.random.default_rng(5)
    rows = [("a", s, i, float(v)) for s in ("train", "test") for i, v in enumerate(rng.exponential(size=50))]
    df = spark.createDataFrame(rows, "slice_id string, split string, ts bigint, loss double")
    got = thresholds.sigma_threshold(df).toPandas()
    for split, group in got.groupby("split"):
        limit = group["loss"].mean() + 3 * group["loss"].std(ddof=0)
        np.testing.assert_allclose(group["threshold"], limit)
        assert (group["is_anomaly"] == (group["loss"] > limit)).all()


def test_prepared_grid_drops_short_slices(spark):
    rng = np.random.default_rng(6)
    slices = {"short": rng.normal(size=(49, 2)), "enough": rng.normal(size=(50, 2))}
    got = analyses.prepared_grid(grid_frame(spark, slices)).select("slice_id").distinct().collect()
    assert [r[0] for r in got] == ["enough"]


def test_wavelet_forecast_runs_on_ranges(spark):
    x = np.sin(np.arange(200) / 7).reshape(-1, 1)
    at = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    got = analyses.wavelet_forecast(grid_frame(spark, {"a": x}), (at(10), at(109)), (at(110), at(189)), length=20).toPandas()
    assert dict(got["split"].value_counts()) == {"train": 80, "test": 60}
    assert got["ts"].min() == pd.Timestamp(START + dt.timedelta(minutes=30))


def test_stored_window_models_score_later_samples(spark):
    """Scaler and forecast of the train range alone; later values may leave its range, and unknown slices have no loss."""
    x = np.cumsum(np.random.default_rng(13).normal(size=120))
    at = lambda minutes: F.lit(START + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    samples = grid_frame(spark, {"a": x.reshape(-1, 1), "b": x[:70].reshape(-1, 1)})
    model = store(saved.fit_window_model(samples.filter("slice_id = 'a'"), (at(-1), at(79)), length=3))
    got = saved.score_window_model(samples, model, (at(79), at(200)), length=3, against="target").toPandas().sort_values("ts")
    scaled = (x - x[:80].min()) / (x[:80].max() - x[:80].min())
    w, y = numpy_windows(scaled[:80], 3)
    coef = np.linalg.lstsq(np.column_stack([np.ones(len(w)), w]), y, rcond=None)[0]
    later, want = numpy_windows(scaled[80:], 3)
    np.testing.assert_allclose(got["loss"], (want - coef[0] - later @ coef[1:]) ** 2, atol=1e-9)
    assert set(got["slice_id"]) == {"a"}


def test_impute_leaves_no_gap(spark):
    m = sparse_matrix(9, 70, 4, 0.1)
    got = matrix_of(impute(grid_frame(spark, {"a": m}), chunk_rows=8))["a"]
    assert not np.isnan(got).any()
    np.testing.assert_allclose(got, pandas_impute(m), atol=1e-12)


def test_second_moments_far_from_zero(spark):
    """Covariance, components and forecast at 1e9 with deviations near 1."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2000, 2)) @ np.array([[1.0, 0.45], [0.0, 1.0]])
    rows = [("a", i % 7, i, [float(v) for v in x + 1e9]) for i, x in enumerate(base)]
    df = spark.createDataFrame(rows, "slice_id string, chunk int, ts int, x array<double>").repartition(5)
    want = np.cov((base + 1e9 - 1e9).T, bias=True)
    cov = {(r["i"], r["j"]): r["cov"] for r in vectors.covariance(df).collect()}
    np.testing.assert_allclose([cov[0, 0], cov[0, 1], cov[1, 1]], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-5)
    model = pca.fit_pca(df, k=2).first()
    np.testing.assert_allclose(model["eigenvalues"], np.linalg.eigvalsh(want)[::-1], rtol=1e-5)
    np.testing.assert_allclose(model["mean"], (base + 1e9).mean(axis=0), rtol=1e-12)
    target = base @ [0.5, -0.25] + 3e8 + rng.normal(size=2000) * 1e-3
    joint = spark.createDataFrame(
        [("a", "train", [float(v) for v in x + 1e9], float(y)) for x, y in zip(base, target)], "slice_id string, split string, x array<double>, y double"
    )
    coef = windows.fit_forecast(joint).first()["coef"]
    np.testing.assert_allclose(coef[1:], [0.5, -0.25], atol=1e-3)
