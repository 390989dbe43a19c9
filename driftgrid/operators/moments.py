"""Second moments of vectors as a state that can be added to: count, mean and centred products per key.

One pass: every task sums up its own vectors around their own mean, and what the tasks hand over is merged
pairwise by the parallel formula, at most ``FAN`` matrices in a task at a time.  A stored state merges with the state
of later vectors in the same way, so that a model is fitted again without reading what it has seen before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftgrid.session import store

#: A task hands over its matrices when they reach this many cells.
PARTIAL_CELLS = 4_000_000
#: Matrices of one key that are merged in one task.
FAN = 16
STATE = "n bigint, mean array<double>, products array<double>"


def typed(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {types[c]}" for c in cols]


def square(products: np.ndarray, d: int) -> np.ndarray:
    """The symmetric matrix of a state's upper triangle, which is kept row by row."""
    out = np.zeros((d, d))
    at = np.triu_indices(d)
    out[at] = products
    out.T[at] = products
    return out


def add(a: tuple, b: tuple) -> tuple:
    """(n, mean, products) of the rows of both: no digits cancel, however far the means lie from zero."""
    (n, mean, products), (m, other, more) = a, b
    if n == 0 or m == 0:
        return b if n == 0 else a
    apart = other - mean
    cross = np.outer(apart, apart)[np.triu_indices(len(mean))]
    return n + m, mean + apart * (m / (n + m)), products + more + cross * (n * m / (n + m))


def of_rows(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, (centred.T @ centred)[np.triu_indices(x.shape[1])]


def on_series(state: tuple, own: Sequence[int], wanted: Sequence[int]) -> tuple:
    """The part of a state that concerns the wanted series."""
    n, mean, products = state
    place = {s: i for i, s in enumerate(own)}
    at = np.array([place[s] for s in wanted], int)
    return n, mean[at], square(products, len(mean))[np.ix_(at, at)][np.triu_indices(len(at))]


def partials(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(part, keys, state): what each task has seen of each key."""
    names = [*keys, "part", "n", "mean", "products"]
    schema = ", ".join([*typed(vectors, keys), "part bigint", STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums, cells = TaskContext.get().partitionId(), {}, 0

        def out() -> pa.RecordBatch:
            frame = pd.DataFrame([(*key, part, *state) for key, state in sums.items()], columns=names)
            return pa.RecordBatch.from_pandas(frame, schema=shape, preserve_index=False)

        shape = None
        for batch in batches:
            if shape is None:
                own = [batch.schema.field(k) for k in keys]
                lists = pa.list_(pa.float64())
                shape = pa.schema([*own, ("part", pa.int64()), ("n", pa.int64()), ("mean", lists), ("products", lists)])
            if not len(batch):
                continue
            x = batch.column("x")
            heads = pa.Table.from_batches([batch.select(keys)]).to_pandas()
            for key, at in heads.groupby(list(keys), sort=False, dropna=False).indices.items():
                rows = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                key = key if isinstance(key, tuple) else (key,)
                if key in sums:
                    sums[key] = add(sums[key], of_rows(rows))
                else:
                    sums[key] = of_rows(rows)
                    cells += len(sums[key][2])
            if cells > PARTIAL_CELLS:
                yield out()
                sums, cells = {}, 0
        if sums:
            yield out()

    return vectors.select(*keys, "x").mapInArrow(run, schema)


def merged(parts: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """One state per key from states numbered by ``part`` below ``count``, ``FAN`` of them at a time.

    With a column ``series`` states are merged on the series that they share.
    """
    keys, labelled = list(keys), "series" in parts.columns
    also = ["series"] if labelled else []
    schema = ", ".join([*typed(parts, keys), "part bigint", STATE, *typed(parts, also)])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        states = [(int(n), np.asarray(m, float), np.asarray(p, float)) for n, m, p in zip(group["n"], group["mean"], group["products"])]
        last = group.iloc[:1][[*keys, "part"]]
        if labelled:
            lists = [list(s) for s in group["series"]]
            shared = sorted(set(lists[0]).intersection(*lists[1:]))
            if any(s != shared for s in lists):
                states = [on_series(state, own, shared) for state, own in zip(states, lists)]
            last = last.assign(series=[shared])
        n, mean, products = reduce(add, states)
        return last.assign(n=n, mean=[mean], products=[products])[[*keys, "part", "n", "mean", "products", *also]]

    while True:
        count = -(-count // FAN)
        placed = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("bigint"))
        parts = placed.groupBy(*keys, "part").applyInPandas(merge, schema)
        if count <= 1:
            return parts.drop("part")
        parts = store(parts)


def moments(vectors: DataFrame, keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """(keys, n, mean, products) of the vectors ``x`` of every key, one row each.

    ``products`` holds the sums of products of the deviations from the mean, its upper triangle row by row.  All
    vectors of a key have one length.  A key without vectors has no row.
    """
    seen = Observation()
    parts = store(partials(vectors, keys).observe(seen, F.max("part").alias("last")))
    return merged(parts, keys, (seen.get["last"] or 0) + 1)


def merge_moments(states: Sequence[DataFrame], keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """The state of everything that the given states have seen; a key may be missing from some of them.

    States with a column ``series`` are merged on the series that all of a key's states have.
    """
    parts = [s.withColumn("part", F.lit(i).cast("bigint")) for i, s in enumerate(states)]
    return merged(reduce(DataFrame.unionByName, parts), keys, len(parts))


def triangle(width: Column) -> Column:
    """Pairs (i, j), i <= j, in the order of ``products``."""
    row = lambda i: F.transform(F.sequence(i, width - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))
    return F.flatten(F.transform(F.sequence(F.lit(0), width - 1), row))


def covariances(state: DataFrame, keys: Sequence[str] = ("slice_id",)) -> DataFrame:
    """Population covariance of each pair of positions i <= j (from 0)."""
    pairs = F.arrays_zip(F.col("products").alias("s"), triangle(F.size("mean")).alias("at"))
    rows = state.filter(F.size("mean") > 0).select(*keys, "n", F.explode(pairs).alias("_c"))
    return rows.select(*keys, F.col("_c.at.i").alias("i"), F.col("_c.at.j").alias("j"), (F.col("_c.s") / F.col("n")).alias("cov"))
