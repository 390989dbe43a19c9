"""Hard negatives of anchors, with bounds along a spanning tree of the anchors.

A score is the inner product of integer vectors.  Anchors come in waves of bounded size, in groups; the
anchors of a group are joined by the spanning tree with the shortest edges.  For a candidate x, the score at a child is the score
at its parent plus or minus edge length times the length of x; where the score at the parent is itself only bounded, so is
the child's, by a wider margin.  A candidate is scored at an anchor only if its bounds overlap the window of scores
that can still matter there.  Bounds never decide a result, so results are exact.

Every wave reads the rows where they lie; each task keeps the best few per anchor (and window), and only those are
shuffled.  The first pass finds the positives, the second the negatives inside the windows that the positives set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.vector_rows import by_length, gathered, numbered, waves
from driftgrid.session import store

#: Anchors of a tree, rows that are scored at once.
GROUP, ROWS = 256, 4096
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score in percent of the positive's.
LOW, HIGH = 30, 90
#: Components beyond this count as it, so that they stay integers in double precision.
LARGEST = 2.0**53
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def spanning_tree(x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, parent, length of the edge to it): parents come before their children; the first has parent -1."""
    n = len(x)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    order, open_ = [0], np.ones(n, bool)
    edge = np.zeros(n)
    open_[0] = False
    for _ in range(n - 1):
        last = order[-1]
        far = np.sqrt(((x - x[last]) ** 2).sum(axis=1))
        closer = open_ & (far < near)
        near[closer], parent[closer] = far[closer], last
        nxt = int(np.where(open_, near, np.inf).argmin()) if np.isfinite(near[open_]).any() else int(np.flatnonzero(open_)[0])
        order.append(nxt)
        edge[nxt], open_[nxt] = near[nxt], False
    return order, parent, edge


class Group:
    """Anchors of one tree with what their rows must fulfil."""

    def __init__(self, part: pa.Table, x: np.ndarray):
        self.x, self.rows, self.ids = x, part["row"].to_numpy(), part["id"].to_numpy()
        self.labels = part["label"].to_pylist()
        self.order, self.parent, self.edge = spanning_tree(x)
        #: (positive id, positive row, score, least and most score of a negative), for the second pass.
        self.windows = [
            [(p["id"], p["other"], p["score"], -(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in ps]
            for ps in (part["positives"].to_pylist() if "positives" in part.column_names else [[]] * len(x))
        ]


def products(x: np.ndarray, vector: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles with integers of any length, cut to the range of a long."""
    if exact:
        return (x @ vector).astype(np.int64)
    whole = [int(v) for v in vector]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), LEAST_LONG), MOST_LONG) for row in x.tolist()], np.int64)


class Best:
    """The k rows with the highest score so far, ties to the smaller id, then row."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.rows = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        """A lower score than this is out."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.score) == self.k:
            some = score >= self.score[-1]
            score, ids, rows = score[some], ids[some], rows[some]
        if not len(score):
            return
        score, ids, rows = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        top = np.lexsort((rows, ids, np.negative(score.astype(object)) if score.min() == LEAST_LONG else -score))[: self.k]
        self.score, self.ids, self.rows = score[top], ids[top], rows[top]


def sweep(group: Group, kept: list, windows: bool, part: pa.Table, x: np.ndarray) -> int:
    """Take a block of rows into ``kept``: per anchor one ``Best``, or one per window; gives the number of rows scored."""
    rows, ids = part["row"].to_numpy(), part["id"].to_numpy()
    labels = part["label"].to_numpy()
    size = np.sqrt((x * x).sum(axis=1))
    exact = np.abs(x).max(initial=0) * np.abs(group.x).max(initial=0) * max(1, x.shape[1]) < 2.0**53
    low, high = np.empty((len(group.x), len(x))), np.empty((len(group.x), len(x)))
    scored = 0
    for a in group.order:
        own = labels == group.labels[a]
        fits = ~own if windows else own & (rows != group.rows[a])
        if windows:
            spans = group.windows[a]
            least = min((max(lo, best.least()) for (_, _, _, lo, _), best in zip(spans, kept[a])), default=np.inf)
            most = max((hi for *_, hi in spans), default=-np.inf)
        else:
            least, most = kept[a].least(), np.inf
        if group.parent[a] < 0 or not exact:
            at = np.arange(len(x))
        else:
            reach = group.edge[a] * size * (1 + 1e-9) + 1
            p = group.parent[a]
            low[a], high[a] = low[p] - reach, high[p] + reach
            at = np.flatnonzero(fits & (high[a] >= least) & (low[a] <= most))
            if 2 * len(at) > len(x):  # one product of the whole block is cheaper than picking most of it
                at = np.arange(len(x))
        score = products(x if len(at) == len(x) else x[at], group.x[a], exact)
        low[a, at] = high[a, at] = score
        scored += len(at)
        some = fits[at] & (score >= least) & (score <= most)
        at, score = at[some], score[some]
        if not windows:
            kept[a].add(score, ids[at], rows[at])
            continue
        for (_, _, _, lo, hi), best in zip(spans, kept[a]):
            inside = (score >= lo) & (score <= hi)
            if inside.any():
                best.add(score[inside], ids[at[inside]], rows[at[inside]])
    return scored


#: Rows that a task hands over.
SHAPE = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, score long, id long, other long"


def groups_of(wave: pa.Table) -> list[Group]:
    out = []
    for part, x in by_length(wave):
        near = np.lexsort(((x[:, :24] > 0).T)[::-1]) if x.shape[1] else np.arange(len(x))
        for i in range(0, len(near), GROUP):
            take = near[i : i + GROUP]
            out.append(Group(part.take(take).combine_chunks(), x[take]))
    return out


def scan(rows: DataFrame, anchors: DataFrame, k: int, windows: bool, wave_bytes: int | None) -> DataFrame:
    """The k best rows of every task for each anchor, or each window of one, over all waves."""
    spark, parts = rows.sparkSession, []
    fields = [f.split()[0] for f in SHAPE.split(", ")]
    for wave in waves(anchors, wave_bytes):
        shared = spark.sparkContext.broadcast([vars(g) for g in groups_of(wave)])

        def run(batches, shared=shared):
            groups = []
            for held in shared.value:
                g = Group.__new__(Group)
                g.__dict__.update(held)
                groups.append(g)
            kept = [[[Best(k) for _ in w] if windows else Best(k) for w in g.windows] for g in groups]
            for table in gathered(batches, ROWS):
                for part, x in by_length(table):
                    for g, own in zip(groups, kept):
                        if g.x.shape[1] == x.shape[1]:
                            sweep(g, own, windows, part, x)
            out = []
            for g, own in zip(groups, kept):
                for a, found in enumerate(own):
                    for (pid, prow, pscore, *_), best in zip(g.windows[a], found) if windows else [((None,) * 5, found)]:
                        out += [(g.rows[a], g.ids[a], prow, pid, pscore, *x) for x in zip(best.score.tolist(), best.ids.tolist(), best.rows.tolist())]
            for i in range(0, len(out), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out[i : i + ROWS])], names=fields)

        parts.append(store(rows.mapInArrow(run, SHAPE)))
        shared.unpersist()
    found = spark.createDataFrame([], SHAPE) if not parts else parts[0]
    for p in parts[1:]:
        found = found.union(p)
    keys = ["anchor", *(["positive"] if windows else [])]
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: Column,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    wave_bytes: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchors`` holds.

    ``anchors`` is a condition on the column ``id``.  Components become floor(scale * x).  The positives of an anchor are its
    ``POSITIVES`` best other rows with its label; the negatives of a positive are the ``NEGATIVES`` best rows with another label
    and a score from ``LOW`` to ``HIGH`` percent of the positive's.  Higher scores come first, ties go to the smaller id.
    Rows with a null id, a null label, a null vector, or null or non-finite components take no part; repeated rows are
    rows of their own and find each other; vectors of another length than the anchor's are no candidates.  Scores
    beyond the range of a long are cut to it.  An anchor without positives, or a positive with nothing in its window, has no row;
    an empty table gives none.
    """
    whole = F.transform("vec", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)))
    rows = numbered(vectors.filter(F.col(label).isNotNull()), vec_id, embedding, F.col(label).alias("label"))
    rows = store(rows.withColumn("vec", whole))
    chosen = store(rows.filter(anchors))
    positives = scan(rows, chosen, POSITIVES, False, wave_bytes)
    positives = positives.groupBy("anchor").agg(F.collect_list(F.struct("id", "other", "score")).alias("positives"))  # POSITIVES at most
    found = scan(rows, store(chosen.join(positives, chosen["row"] == positives["anchor"]).drop("anchor")), NEGATIVES, True, wave_bytes)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
