"""Isolation forest (Liu, Ting, Zhou 2008) with arithmetic in place of a random generator.

A tree needs only a sample of 256 rows, so growing it is a bounded step; the passes over
all rows, sampling and scoring, are narrow Spark operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.split import integer_key
from driftgrid.operators.thresholds import quantile_threshold
from driftgrid.session import store

# Fixed values of the sampling and splitting arithmetic: primes, products stay within 64 bits.
MODULUS = 2147483647
ROW_FACTOR = 16807
TREE_FACTOR = 7919
NODE_FACTOR = 104729
FRACTION_STEPS = 10007
EULER_GAMMA = 0.5772156649
# Rows that are tried against all trees at once.
TRIED_ROWS = 8192


def sample_rank(small: np.ndarray, tree: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random order of the rows for one tree; ``small`` is a key below MODULUS."""
    mixed = (small * (ROW_FACTOR + TREE_FACTOR * tree) + NODE_FACTOR * (tree + seed)) % MODULUS
    return (mixed * mixed + small) % MODULUS


def tree_samples(
    df: DataFrame, features: Sequence[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """The ``sample`` rows of lowest rank for every tree.

    Rows are tried against all trees in place, a block of them at once, and repeated only for the trees under whose rank limit they
    lie, about four samples' worth per tree however large the table is.  The key is an integer or a text.  Should some tree end up short,
    the limit is raised and the step repeated.
    """
    total = df.count()
    need = min(sample, total)
    share = min(1.0, 4.0 * sample / max(total, 1))
    keyed = df.select(F.col(key).alias("_key"), F.pmod(integer_key(df, key), F.lit(MODULUS)).alias("_small"), *features)
    names = ["_key", *features, "tree", "_rank"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name != "_small"] + ["tree int", "_rank bigint"])
    while True:
        below = MODULUS if share >= 1.0 else int(MODULUS * share)

        def tried(batches: Iterator[pa.RecordBatch], below: int = below) -> Iterator[pa.RecordBatch]:
            each = np.arange(trees)
            for batch in batches:
                for i in range(0, len(batch), TRIED_ROWS):
                    rows = batch.slice(i, TRIED_ROWS)
                    rank = sample_rank(rows.column("_small").to_numpy()[:, None], each[None, :], seed)
                    at, tree = np.nonzero(rank < below)
                    kept = rows.take(pa.array(at))
                    columns = [kept.column(c) for c in names[:-2]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(tree.astype(np.int32)), pa.array(rank[at, tree])], names=names)

        near = store(keyed.mapInArrow(tried, schema))
        counts = near.groupBy("tree").agg(F.count("*").alias("n")).agg(
            F.count("*").alias("trees"), F.min("n").alias("least")
        ).first()
        if share >= 1.0 or (counts["trees"] == trees and counts["least"] >= need):
            break
        share = min(1.0, share * 4)
    pick = F.slice(F.array_sort(F.collect_list(F.struct("_rank", "_key", *features))), 1, sample)
    return near.groupBy("tree").agg(pick.alias("_rows")).select("tree", F.inline("_rows")).select("tree", *features)


def _hash(tree: int, node: int, seed: int) -> int:
    mixed = (tree * TREE_FACTOR + node * NODE_FACTOR + seed * 31 + 17) % MODULUS
    return mixed * mixed % MODULUS


def split_choice(tree: int, node: int, seed: int, n_features: int) -> tuple[int, float]:
    """Preferred feature of a node and the share of its range at which it splits."""
    mixed = _hash(tree, node, seed)
    return mixed % n_features, (mixed // n_features % FRACTION_STEPS + 0.5) / FRACTION_STEPS


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def fit_iforest(
    df: DataFrame, features: Sequence[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Tree nodes (tree, node, feature, threshold, size); leaves have feature -1.

    Children of node n are 2n and 2n + 1; a row goes left when it is below the threshold.
    """
    features = list(features)
    rows = tree_samples(df, features, key, trees, sample, seed)
    levels = math.ceil(math.log2(max(sample, 2)))

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = group[features].to_numpy(dtype=float)
        nodes, todo = [], [(1, np.arange(len(x)))]
        while todo:
            node, members = todo.pop()
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            depth = node.bit_length() - 1
            open_features = [f for f in range(len(features)) if high[f] > low[f]]
            if depth >= levels or len(members) <= 1 or not open_features:
                nodes.append((tree, node, -1, 0.0, len(members)))
                continue
            feature, part = split_choice(tree, node, seed, len(features))
            while feature not in open_features:
                feature = (feature + 1) % len(features)
            threshold = low[feature] + part * (high[feature] - low[feature])
            nodes.append((tree, node, feature, threshold, len(members)))
            left = x[members, feature] < threshold
            todo.append((2 * node, members[left]))
            todo.append((2 * node + 1, members[~left]))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "size"])

    return rows.groupBy("tree").applyInPandas(grow, "tree int, node bigint, feature int, threshold double, size bigint")


def score_iforest(
    df: DataFrame, model: DataFrame, features: Sequence[str], sample: int = 256, train_rows: int | None = None
) -> DataFrame:
    """Add ``score`` between 0 and 1; the closer to 1, the easier the row is to isolate.

    The model has at most trees x 2 x sample nodes whatever the size of the data, and goes to
    every task once; rows are walked through it a batch at a time.
    """
    nodes = model.toPandas()
    psi = min(sample, train_rows) if train_rows is not None else int(nodes.loc[nodes["node"] == 1, "size"].max())
    walk = []
    for _, tree in nodes.groupby("tree"):
        size = int(tree["node"].max()) + 1
        feature = np.full(size, -1, dtype=np.int64)
        threshold, extra = np.zeros(size), np.zeros(size)
        at = tree["node"].to_numpy()
        feature[at], threshold[at] = tree["feature"], tree["threshold"]
        depth = np.floor(np.log2(at))
        extra[at] = depth + average_path(tree["size"].to_numpy())
        walk.append((feature, threshold, extra))
    shared = df.sparkSession.sparkContext.broadcast((walk, float(average_path(psi))))
    features = list(features)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, normal = shared.value
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            total = np.zeros(len(x))
            for feature, threshold, extra in trees:
                node = np.ones(len(x), dtype=np.int64)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    at = np.nonzero(inner)[0]
                    right = x[at, f[at]] >= threshold[node[at]]
                    node[at] = 2 * node[at] + right
                total += extra[node]
            yield pd.Series(np.power(2.0, -(total / len(trees)) / normal))

    walker = F.pandas_udf(score, "double")
    return df.withColumn("score", walker(*[F.col(f).cast("double") for f in features]))


def score_limit(train: DataFrame, contamination: float = 0.1) -> float:
    """The score that a share of ``contamination`` of the train rows exceeds."""
    return quantile_threshold(train, 1.0 - contamination).first()["threshold"]


def label_scores(scored: DataFrame, train: DataFrame, contamination: float = 0.1) -> DataFrame:
    """-1 for rows scoring above the train split's (1 - contamination) quantile, else 1."""
    limit = score_limit(train, contamination)
    return scored.withColumn("anomaly", F.when(F.col("score") > F.lit(limit), -1).otherwise(1))
