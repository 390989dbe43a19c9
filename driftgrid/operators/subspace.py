"""Leading principal components of wide slices, without their covariance matrix.

A block of ``k + EXTRA`` directions per slice is multiplied by the covariance in passes over the rows: a task adds up
(x - mean) ((x - mean)' Q) for its rows, Spark sums the blocks by slice, and the sum, beside the block it comes from, is made orthogonal for
the next pass.  A task holds d x 2 (k + EXTRA) numbers per slice instead of d x d.  Passes end when the leading eigenvalues stand still (Halko, Martinsson, Tropp 2011);
directions are then right to about the square root of that, where their eigenvalues lie apart from the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftgrid import spread
from driftgrid.operators.moments import FAN, typed
from driftgrid.session import store

#: Directions beyond the wanted ones; passes at most; change of the leading eigenvalues that ends them.
EXTRA, PASSES, TOLERANCE = 8, 60, 1e-10
SEED = 13
FIELDS = ("n bigint", "square double", "block array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame, of_rows, shared=None) -> DataFrame:
    """(slice_id, part, n, square, block): what ``of_rows`` (state, matrix) gives, added up per task and slice."""
    schema = ", ".join([*typed(rows, ["slice_id"]), "part bigint", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, kind = TaskContext.get().partitionId(), {}, None
        for batch in batches:
            kind = batch.schema.field("slice_id").type
            names = batch.column("slice_id").to_pandas()
            for name, at in names.groupby(names, sort=False).indices.items():
                if shared is not None and name not in shared.value:
                    continue
                n, square, block = of_rows(None if shared is None else shared.value[name], matrix(batch.column("x").take(pa.array(at))))
                if name in held:
                    held[name] = (held[name][0] + n, held[name][1] + square, held[name][2] + block)
                else:
                    held[name] = (n, square, block)
        if held:
            ns, squares, blocks = zip(*held.values())
            columns = [pa.array(list(held), kind), pa.array([part] * len(held)), pa.array(ns), pa.array(squares, pa.float64()), pa.array([b.ravel() for b in blocks], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["slice_id", "part", "n", "square", "block"])

    return rows.select("slice_id", "x").mapInArrow(run, schema)


def added(parts: DataFrame, tasks: list[int]) -> dict:
    """The sums of each slice, added up ``FAN`` at a time; they fit the driver, as slices come in rounds of bounded size.

    ``tasks`` remembers from the first pass over the rows how many tasks read them.
    """

    def total(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        return group.iloc[:1].assign(n=group["n"].sum(), square=group["square"].sum(), block=[np.sum(np.stack(group["block"].to_numpy()), axis=0)])

    if not tasks:
        seen = Observation()
        parts = store(parts.observe(seen, F.max("part").alias("last")))
        tasks.append((seen.get["last"] or 0) + 1)
    count = tasks[0]
    while True:
        count = -(-count // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint")).groupBy("slice_id", "part").applyInPandas(total, parts.schema)
        if count <= 1:
            return {r["slice_id"]: (r["n"], r["square"], np.array(r["block"])) for r in parts.collect()}
        parts = store(parts)


def _means(_, x: np.ndarray):
    # Far from zero this mean is a little off; a second pass adds the mean of what it leaves.
    return len(x), 0.0, x.sum(axis=0)


def _refined(state, x: np.ndarray):
    return len(x), 0.0, (x - state[0]).sum(axis=0)


def _multiplied(state, x: np.ndarray):
    mean, q = state
    centred = x - mean
    return len(x), float((centred * centred).sum()), centred.T @ (centred @ q)


def fit_wide_pca(
    vectors: DataFrame, k: int | None = None, target: float = 0.8, plus: int = 1, most: int = 16, extra: int = EXTRA, passes: int = PASSES,
    tolerance: float = TOLERANCE, round_bytes: int | None = None,
) -> DataFrame:
    """Models as ``pca.fit_pca`` gives them, with the leading eigenvalues alone, and ``variance``, the sum of all.

    The number of components is ``k``, or the smallest count (``plus`` = 1, or one less with 0) whose share of the variance
    reaches ``target``, ``most`` at most.  ``vectors`` are read several times and should be stored.
    """
    spark = vectors.sparkSession
    limit = spread.BROADCAST_BYTES if round_bytes is None else round_bytes
    wanted = k if k is not None else most
    sizes = vectors.groupBy("slice_id").agg(F.max(F.size("x")).alias("d"))
    total = sizes.agg(F.coalesce(F.sum(F.col("d") * (2 * (wanted + extra) + 1) * 8), F.lit(0))).first()[0]
    rounds = max(1, -(-total // max(limit, 1)))
    schema = ", ".join([*typed(vectors, ["slice_id"]), "n bigint", "k int", "mean array<double>", "eigenvalues array<double>", "loadings array<double>", "variance double"])
    tables = []
    for i in range(rounds):
        models, tasks = [], []
        rows = vectors if rounds == 1 else vectors.filter(F.pmod(F.xxhash64("slice_id"), F.lit(rounds)) == i)
        means = {s: (b / n,) for s, (n, _, b) in added(sums(rows, _means), tasks).items()}
        shared = spark.sparkContext.broadcast(means)
        state = {}
        for s, (n, _, b) in added(sums(rows, _refined, shared), tasks).items():
            mean = means[s][0] + b / n
            width = min(wanted + extra, len(mean))
            start = np.random.default_rng(SEED).normal(size=(len(mean), width))
            state[s] = (mean, np.linalg.qr(start)[0])
        shared.unpersist()
        values: dict = {s: np.full(state[s][1].shape[1], np.inf) for s in state}
        done = []
        for turn in range(passes):
            if not state:
                break
            shared = spark.sparkContext.broadcast(state)
            got = added(sums(rows, _multiplied, shared), tasks)
            shared.unpersist()
            ahead = {}
            for s, (n, square, block) in got.items():
                mean, q = state[s]
                y = block.reshape(q.shape) / n
                # Eigenvalues and directions within the block (Rayleigh, Ritz).
                small, turned = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
                small, turned = np.maximum(small[::-1], 0.0), turned[:, ::-1]
                lead = min(wanted, len(small))
                still = np.abs(small[:lead] - values[s][:lead]).max(initial=0) <= tolerance * max(small.max(initial=0), 1e-300)
                if still or turn == passes - 1 or q.shape[0] == q.shape[1]:
                    done.append((s, n, square / n, mean, small[:lead], (q @ turned)[:, :lead].T))
                else:
                    # The best directions, and those they come from: two steps of a Krylov space find more than one.
                    width = min(wanted + extra, len(small))
                    both = np.hstack([y @ turned[:, :width], q @ turned[:, :width]])
                    values[s], ahead[s] = small, (mean, np.linalg.qr(both)[0][:, : len(mean)])
            state = ahead
        for s, n, variance, mean, small, axes in done:
            count = k if k is not None else plus
            if k is None and variance > 0:
                reached = np.cumsum(small) / variance >= target - 1e-12
                count = (int(reached.argmax()) if reached.any() else len(small) - 1) + plus
            count = min(count, len(small))
            axes = axes[:count]
            if count:
                axes = axes * np.sign(axes[np.arange(count), np.abs(axes).argmax(axis=1)])[:, None]
            models.append((s, int(n), count, mean.tolist(), small.tolist(), axes.ravel().tolist(), float(variance)))
        tables.append(store(spark.createDataFrame(models, schema)))
    return reduce(DataFrame.union, tables)
