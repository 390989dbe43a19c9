"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation.

Words are counted over the whole learning corpus.  The output is factored: the most frequent words are classes of
their own, every other word is in a cluster given by its ending, and the clusters are classes too.  A context
of two words predicts the next class: the sum of the two context vectors times the class vector, plus a bias.
Every task trains on all its texts from the same start with noise samples, and Spark averages the weights by
the number of tokens.  The normaliser of every pair of context classes comes from one matrix product.

A word of a cluster has its share of the counts of the cluster, each raised by one; a word that was never counted has
the share of one count more.  So the probabilities of all words after any context add up to one.  Counts of frequent words
go to the tasks; those of all others stay in a table and are joined on the word.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import ready
from driftgrid.session import store

#: Words with at least this share of all tokens are sent to every task: at most 1 / HEAD_SHARE words.
HEAD_SHARE = 2e-6
#: One more than the words with a class of their own; length of a vector; noise samples and tokens per step.
CLASSES, WIDTH, NOISE, STEP_TOKENS = 2048, 16, 48, 8192
RATE = 0.15
#: Clusters of all other words, the bytes of a word's end that name its cluster.
CLUSTERS, ENDING = 256, 3
HELD = 300_000
COUNTS = "token binary, uses long"
END = b""  # no word is empty, so the end of a text is counted as the empty word


def words_of(text: bytes | None) -> list[bytes]:
    """The words and the end; bytes.lower and bytes.split touch ASCII letters and blanks alone."""
    return [*(text or b"").lower().split(), END]


def cluster(word: bytes) -> int:
    return crc32(word[-ENDING:]) % CLUSTERS


class Places(dict):
    """Classes of words: those of their own, else the cluster."""

    def __missing__(self, word: bytes) -> int:
        return cluster(word)


def count_words(batches):
    seen = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "uses"])

    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(words_of(text))
            if len(seen) > HELD:
                yield out()
                seen.clear()
    yield out()


class Net:
    """The weights: two context tables, the class table (each classes + 1 rows; the last row is the time before a text) and the bias."""

    def __init__(self, bias: np.ndarray, table: np.ndarray | None = None):
        self.k = len(bias)
        if table is None:
            draw = np.random.default_rng(5)
            table = draw.normal(0, 0.1, (3, self.k + 1, WIDTH)).astype(np.float32)
        self.table, self.bias = table, bias.astype(np.float32)

    def train(self, streams, noise: np.ndarray, seed: int):
        """One pass over (before last, last, next) class arrays; gives the tokens of each."""
        draw, log_noise = np.random.default_rng(seed), np.log(noise * NOISE).astype(np.float32)
        steps, sums = np.cumsum(noise), np.full(self.table.shape, 1e-2, np.float32)
        bias_sums = np.full(self.k, 1e-2, np.float32)
        one, two, out = self.table
        for c1, c2, w in streams:
            for a in range(0, len(w), STEP_TOKENS):
                i, j, y = c1[a : a + STEP_TOKENS], c2[a : a + STEP_TOKENS], w[a : a + STEP_TOKENS]
                fake = np.minimum(np.searchsorted(steps, draw.random(NOISE)), self.k - 1)
                context = one[i] + two[j]
                target, noises = out[y], out[fake]
                right = np.einsum("ij,ij->i", context, target) + self.bias[y] - log_noise[y]
                wrong = context @ noises.T + (self.bias[fake] - log_noise[fake])
                up = 1 / (1 + np.exp(np.clip(right, -30, 30)))  # derivative by the true word's margin
                down = 1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
                by_context = up[:, None] * target - down @ noises
                size = np.float32(1 / len(y))
                grads = [self.scatter(i, by_context), self.scatter(j, by_context), self.scatter(y, up[:, None] * context)]
                np.subtract.at(grads[2], fake, down.T @ context)
                by_bias = np.bincount(y, up, self.k) - np.bincount(fake, down.sum(axis=0), self.k)
                for m, g in enumerate(grads):
                    g *= size
                    sums[m] += g * g
                    self.table[m] += RATE * g / np.sqrt(sums[m])
                by_bias = (by_bias * size).astype(np.float32)
                bias_sums += by_bias**2
                self.bias += RATE * 0.2 * by_bias / np.sqrt(bias_sums)
            yield len(w)

    def scatter(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        flat = (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        return np.bincount(flat, values.ravel(), (self.k + 1) * WIDTH).reshape(-1, WIDTH).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, normaliser): log P(w | i, j) = first[i, w] + second[j, w] - normaliser[i, j]."""
        one, two, out = self.table
        first = one @ out[:-1].T
        second = two @ out[:-1].T + self.bias
        top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        total = np.exp(first - top1) @ np.exp(second - top2).T
        return first, second, (np.log(total) + top1 + top2.T).astype(np.float32)


def contexts(texts, places: Places, k: int, rows: int = 200_000):
    """Class arrays (before last, last, next) of many texts at once."""
    i, j, y, size = [], [], [], 0
    get = places.__getitem__
    for text in texts:
        ids = np.array([k, k, *map(get, words_of(text))], np.int64)
        i.append(ids[:-2])
        j.append(ids[1:-1])
        y.append(ids[2:])
        size += len(ids) - 2
        if size >= rows:
            yield np.concatenate(i), np.concatenate(j), np.concatenate(y)
            i, j, y, size = [], [], [], 0
    if y:
        yield np.concatenate(i), np.concatenate(j), np.concatenate(y)


class Model:
    """Counts (a stored table, and its head of words with at least ``least`` uses), totals, and the neural tables.

    weights: logarithm of the summed weights of the words of each cluster.
    """

    def __init__(self, counts: DataFrame, tokens: int, types: int, least: float, head: dict[bytes, int], classes: list[bytes], tables, weights: np.ndarray):
        self.counts, self.tokens, self.types, self.least = counts, tokens, types, least
        self.head, self.classes, self.tables, self.weights = head, classes, tables, weights


def fit(docs: DataFrame, text: str = "text", classes: int = CLASSES, head_share: float = HEAD_SHARE) -> Model:
    """Count all words of ``docs`` and train on all of them.  An empty table gives a model without words."""
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    counts = store(texts.mapInArrow(count_words, COUNTS).groupBy("token").agg(F.sum("uses").alias("uses")))
    tokens, types = counts.agg(F.coalesce(F.sum("uses"), F.lit(0)), F.count("*")).first()
    least = max(1, head_share * tokens)
    head = counts.filter(F.col("uses") >= least).toArrow() if tokens else None
    known = dict(zip(*(c.to_pylist() for c in head.columns))) if tokens else {}
    top = sorted(known, key=lambda w: (-known[w], w))[: classes - 1]
    # Of each cluster: uses, and words; words with a class of their own are not in it.
    shares, types_in = np.ones(CLUSTERS), np.ones(CLUSTERS)
    if tokens:
        named = F.crc32(F.substring("token", -ENDING, ENDING))
        for r in counts.groupBy((named % CLUSTERS).cast("int").alias("cluster")).agg(F.sum("uses").alias("uses"), F.count("*").alias("types")).collect():
            shares[r["cluster"]] += r["uses"]
            types_in[r["cluster"]] += r["types"]
        for w in top:
            shares[cluster(w)] -= known[w]
            types_in[cluster(w)] -= 1
    weights = np.log(shares - 1 + types_in)
    noise = np.concatenate([shares, np.array([known[w] for w in top], np.float64)])
    noise /= noise.sum()
    net = Net(np.log(noise))
    if not tokens:
        return Model(counts, tokens, types, least, known, top, net.tables(), weights)
    start = spark.sparkContext.broadcast((top, noise))
    values = [f"v{d}" for d in range(WIDTH)]

    def run(batches):
        from pyspark import TaskContext

        top, noise = start.value
        places = Places({w: n + CLUSTERS for n, w in enumerate(top)})
        net, seen = Net(np.log(noise)), 0
        for n in net.train(contexts((t for b in batches for t in b.column(0).to_pylist()), places, net.k), noise, TaskContext.get().partitionId()):
            seen += n
        if seen:
            rows = np.concatenate([net.table.reshape(-1, WIDTH), np.pad(net.bias[:, None], ((0, 0), (0, WIDTH - 1)))])
            # Sums of weight times value: Spark adds them up per row.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), float(seen)))] + [pa.array(rows[:, d].astype(np.float64) * seen) for d in range(WIDTH)],
                names=["row", "seen", *values],
            )

    shape = "row int, seen double, " + ", ".join(f"{v} double" for v in values)
    learned = texts.mapInArrow(run, shape).groupBy("row").agg(F.sum("seen").alias("seen"), *(F.sum(v).alias(v) for v in values))
    got = learned.orderBy("row").toArrow()
    rows = np.stack([got[v].to_numpy() for v in values], axis=1) / got["seen"].to_numpy()[:, None]
    cut = 3 * (net.k + 1)
    net = Net(rows[cut:, 0], rows[:cut].astype(np.float32).reshape(3, net.k + 1, WIDTH))
    return Model(counts, tokens, types, least, known, top, net.tables(), weights)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per input row.

    base_score: log10 probability by add-one word counts; score: by the neural model.  A null or empty
    text has one token, its end.  Only the text is looked at, a null id stays null.
    """
    spark = ready(docs.sparkSession)
    base_total, k = np.log10(model.tokens + model.types + 1), len(model.classes) + CLUSTERS
    shared = spark.sparkContext.broadcast((model.head, model.classes, model.tables, model.weights))  # bounded by 1 / HEAD_SHARE, CLASSES and CLUSTERS

    def run(batches):
        head, classes, (first, second, normal), weights = shared.value
        place = {w: n for n, w in enumerate(head)}
        used = np.log10(np.array([*head.values(), 0], np.float64) + 1)
        places = Places({w: n + CLUSTERS for n, w in enumerate(classes)})
        kinds = np.array([*(places[w] for w in head), 0], np.int64)
        inside = np.where(kinds < CLUSTERS, used, 0)  # logarithms of the weights of the words of clusters
        of_class = np.concatenate([weights, np.zeros(k - CLUSTERS)])
        other, get = len(head), place.get
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(2).to_pylist():
                words = words_of(text)
                at = np.array([get(w, other) for w in words], np.int64)
                cls = np.concatenate([[k, k], kinds[at]])
                far = np.flatnonzero(at == other).tolist()
                for n in far:
                    cls[n + 2] = cluster(words[n])
                tail = Counter(words[n] for n in far)
                i, j, y = cls[:-2], cls[1:-1], cls[2:]
                neural = float((first[i, y] + second[j, y] - normal[i, j] - of_class[y]).sum(dtype=np.float64)) / np.log(10) + float(inside[at].sum())
                row = (len(words), len(words) - len(far), float(used[at].sum()) - len(words) * base_total, neural, list(tail), list(tail.values()))
                for o, x in zip(out, row):
                    o.append(x)
            kinds_out = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(o, t) for o, t in zip(out, kinds_out))],
                names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail", "tail_uses"],
            )

    shape = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, tail array<binary>, tail_uses array<long>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    scored = store(numbered.mapInArrow(run, shape))
    # Words outside the head: their counts are met in a join on the word, none of which has more than HEAD_SHARE of the learning tokens.
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_uses")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.tail_uses").alias("times"))
    met = tail.join(model.counts.filter(F.col("uses") < model.least), "token").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("uses") + 1)).alias("more"), F.sum("times").alias("also_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tail", "tail_uses").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
