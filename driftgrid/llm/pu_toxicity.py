"""Toxicity by non-negative positive-unlabelled learning.

Logistic classifiers are trained in numpy from confirmed toxic texts and unlabelled texts.  Their
risk is  prior * R_pos(+)  +  max(0, R_unl(-) - prior * R_pos(-)): unlabelled texts count as
negative, less the share that the class prior says is toxic, and that part never falls below
zero.  Training rows are a bounded sample (``MOST_POSITIVE``, ``MOST_UNLABELLED``); every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.llm.common import ready

#: Expected sample sizes; rows are chosen by a hash of their id.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 10_000
#: Hashed features of a text: its distinct words, and their first letters, which inflected forms share.
SLOTS, PREFIXES = 1 << 20, (4, 5, 6)
#: Features that training looks at: those most frequent in positive texts beyond chance, in at least LEAST_TEXTS of them.
FEATURES, LEAST_TEXTS = 500, 5
#: Standard deviations by which the share of a feature in positive texts must stand out.
TELLING = 5.0
MODELS, STEPS, RATE, DECAY = 3, 400, 0.1, 1e-4
CACHED = 300_000
WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[int, ...]:
    starts = {word[:n] for n in PREFIXES if n < len(word)}
    return zlib.crc32(word.encode()) % SLOTS, *(zlib.crc32(f"{x}*".encode()) % SLOTS for x in starts)


class Slots:
    """Text -> the sorted slots of its distinct lower-case words and their first letters."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(WORDS.findall(text.lower())) if text else set()
        if len(self.known) + len(words) > CACHED:
            self.known = {}
        known, out = self.known, set()
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = features(w)
            out.update(at)
        return np.sort(np.fromiter(out, np.int32, len(out)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def slots_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    slots = Slots()
    for part in texts:
        yield pd.Series([slots(t) for t in part], dtype=object)


def chosen(rows: DataFrame, most: int, count: int, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` rows by a hash of the id; all where there are no more."""
    if count <= most:
        return rows
    grain = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), F.col(doc_id)), F.lit(grain)) < int(grain * most / count))


def gathered(sample: DataFrame) -> list[np.ndarray]:
    """The slots of a bounded sample, as views of one Arrow column."""
    column = sample.select(slots_of("text").alias("slots")).toArrow().column(0)
    return [c.values.to_numpy()[a:b] for c in column.chunks for o in [c.offsets.to_numpy()] for a, b in zip(o, o[1:])]


def risk_gradient(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk and its derivative by the margins of positive and unlabelled texts (logistic loss).

    Where the negative part is below zero, the step goes against it, as in the published
    algorithm, so that the classifier gives up what it overfits.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    n_p, n_u = max(len(margin_p), 1), max(len(margin_u), 1)
    positive = prior * loss(margin_p).sum() / n_p
    negative = loss(-margin_u).sum() / n_u - prior * loss(-margin_p).sum() / n_p
    by_u, by_p = sigmoid(margin_u) / n_u, -prior * sigmoid(margin_p) / n_p
    if negative >= 0:
        return positive + negative, by_p - prior * sigmoid(-margin_p) / n_p, by_u
    return positive, -by_p, -by_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the mean of MODELS classifiers, each on its part of the unlabelled texts."""
    flat = lambda rows: np.concatenate([*rows, np.empty(0, np.int32)])
    in_p, in_u = (np.bincount(flat(rows), minlength=SLOTS) for rows in (positive, unlabelled))
    share_p, share_u = (in_p + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(unlabelled) + 1)
    telling = (share_p - share_u) / np.sqrt(share_u * (1 - np.minimum(share_u, 0.999)) / max(len(positive), 1))
    telling[(in_p < LEAST_TEXTS) | (telling < TELLING)] = 0
    slots = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    slots = slots[telling[slots] != 0]
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [place[r] for r in rows]
        at = [a[a >= 0] for a in at]
        return np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)

    total, bias = np.zeros(len(slots)), 0.0
    row_p, col_p = matrix(positive)
    for k in range(MODELS):
        mine = unlabelled[k::MODELS] or unlabelled
        row_u, col_u = matrix(mine)
        w = np.zeros(len(slots) + 1)
        w[-1] = np.log(prior / (1 - prior))
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            margin = lambda rows, cols, n, w=w: np.bincount(rows, w[cols], n) + w[-1]
            _, by_p, by_u = risk_gradient(margin(row_p, col_p, len(positive)), margin(row_u, col_u, len(mine)), prior)
            grad = DECAY * w
            grad[:-1] += np.bincount(col_p, by_p[row_p], len(slots)) + np.bincount(col_u, by_u[row_u], len(slots))
            grad[-1] = by_p.sum() + by_u.sum()
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        total, bias = total + w[:-1] / MODELS, bias + w[-1] / MODELS
    return slots, total, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Dense weights over the slots, and the bias.

    ``labels`` holds (doc_id, 1 or 0); null ids and null labels are passed over, an id with several
    labels takes the largest.  The class prior is the share of positives among the labelled ids.
    A sample of all rows of ``docs``, labels unseen, is the unlabelled text.  Without positives every text
    gets the same low score.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    n, toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    weights = np.zeros(SLOTS, np.float32)
    if not toxic:
        return weights, -10.0
    prior = min(max(toxic / n, 1e-4), 0.9)
    confirmed = marks.filter("label = 1").select("doc_id")
    n_docs = rows.count()
    # The sample of ids is bounded, so it goes to the texts and not the texts to it.
    positive = rows.join(F.broadcast(chosen(confirmed, MOST_POSITIVE, toxic)), "doc_id", "left_semi")
    unlabelled = chosen(rows, MOST_UNLABELLED, n_docs)  # the confirmed ones among them too: the prior holds for all text
    one, other = gathered(positive), gathered(unlabelled)
    if not one or not other:
        return weights, -10.0
    slots, w, bias = train(one, other, prior)
    weights[slots] = w
    return weights, float(bias)


def toxicity(spark, model: tuple[np.ndarray, float]) -> Column:
    """A function of the text column that gives the score."""
    shared = spark.sparkContext.broadcast(model)  # SLOTS floats

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (weights, bias), slots = shared.value, Slots()
        for part in texts:
            margin = np.array([weights[slots(t)].sum(dtype=np.float64) + bias for t in part])
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row per input row; null and empty texts get the score of no words.  Only the text is looked at."""
    spark = ready(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), toxicity(spark, model)(F.col(text)).alias("score"))
